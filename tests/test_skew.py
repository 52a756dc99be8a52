"""Every job on a skewed catalogue equals its SQL twin run by DuckDB over the same tables.

One director holds a third of all director credits and one movie holds a third of all acting
credits, so the hot-key paths (range-split running windows and rankings, group-limited top-k,
map-side aggregation, skewed joins) carry real weight.
"""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from marquee import oracle, registry
from marquee.catalog import PARTITION_COLUMNS, SCHEMAS, read_catalog, write_catalog
from oracle_harness import _norm

NAMES = [n for n in registry.queries() if n not in ("import_catalog", "reimport_catalog", "check_incremental")]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    base = registry.catalog_snapshot(spark, SF_SMALL)
    hot_title = base.titles.where(F.col("title_type") == "movie").agg(F.min("id")).first()[0]
    hot_person = base.people.agg(F.min("id")).first()[0]
    tp = base.title_people
    bucket = F.abs(F.hash("title_id", "person_id")) % 3 == 0
    person = F.when((F.col("category") == "director") & bucket, F.lit(hot_person)).otherwise(F.col("person_id"))
    # the hot movie's cast are people of their own, so that its credits stay distinct
    moved = F.col("category").isin("actor", "actress") & bucket
    title = F.when(moved, F.lit(hot_title)).otherwise(F.col("title_id"))
    person = F.when(moved, F.concat_ws("_", F.lit("nmh"), "title_id", "person_id")).otherwise(person)
    credits = (tp.select(title.alias("title_id"), person.alias("person_id"), "category", "job", "characters")
               .dropDuplicates(["title_id", "person_id", "category"]))
    extras = credits.where(F.col("person_id").startswith("nmh_")).select("person_id").distinct().select(
        F.col("person_id").alias("id"), F.concat(F.lit("Extra "), "person_id").alias("name"),
        F.lit(1950).alias("birth_year"), F.lit(None).cast("int").alias("death_year"))
    path = str(tmp_path_factory.mktemp("skewed") / "catalog")
    write_catalog(base.replace(title_people=credits, people=base.people.unionByName(extras)), path)
    con = duckdb.connect()
    for name in SCHEMAS:
        hive = "true" if name in PARTITION_COLUMNS else "false"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}/**/*.parquet', "
                    f"hive_partitioning = {hive})")
    cat = read_catalog(spark, path)
    hot_share = cat.title_people.where(F.col("person_id") == hot_person).count() / max(
        1, cat.title_people.where(F.col("category") == "director").count())
    assert hot_share > 0.25
    acting = cat.title_people.where(F.col("category").isin("actor", "actress"))
    assert acting.where(F.col("title_id") == hot_title).count() > 0.25 * acting.count()
    return cat, con


@pytest.mark.parametrize("name", NAMES)
def test_job_on_skewed_catalog_matches_sql(spark, skewed, name):
    cat, con = skewed
    if name == "check_catalog":
        from marquee.plans.checks import check_catalog
        df = registry.plain_types(check_catalog(cat))
    elif name == "search_many":
        df = registry.search_many_prefixes(cat)
    elif name in registry.LISTINGS:
        job, params, _ = registry.LISTINGS[name]
        df = registry.plain_types(job(cat, **params))
    else:
        job, params = registry.JOBS[name]
        df = registry.plain_types(job(cat, **params))
    statement = oracle.body(registry.oracle_sql()[name])
    rel = con.execute(statement)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    s_cols = df.columns
    assert sorted(s_cols) == sorted(d_cols)
    order = sorted(s_cols)
    s = sorted((tuple(_norm(r[s_cols.index(c)]) for c in order) for r in df.collect()), key=repr)
    d = sorted((tuple(_norm(r[d_cols.index(c)]) for c in order) for r in d_rows), key=repr)
    assert len(s) == len(d)
    assert s == d
