"""Tiny hand-written catalogues for edge cases."""

from __future__ import annotations

from decimal import Decimal

from marquee.catalog import SCHEMAS, Catalog


def d(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def make_catalog(spark, **tables) -> Catalog:
    return Catalog(**{name: spark.createDataFrame(tables.get(name, []), SCHEMAS[name]) for name in SCHEMAS})


def movie(i, year=2000, title=None, kind="movie", end=None, runtime=100, adult=False, original=None):
    return (f"tt{i}", kind, title or f"Movie {i}", original, year, end, runtime, adult)
