"""Ranks and pages by counting, and running windows with border carry, against sorted lists."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from marquee.operators.order import ascending, descending, page, page_after, page_start, sort_key, with_ranks
from marquee.operators.running import running_aggregates
from marquee.registry import catalog_snapshot


def KEY():
    return sort_key(descending("v"), ascending("id"))


@pytest.fixture(scope="module")
def numbers(spark):
    v = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 7919 % 1000)
    return spark.range(20_000).select("id", v.alias("v")).repartition(8).cache()


@pytest.fixture(scope="module")
def ordered(numbers):
    return [r.id for r in sorted(numbers.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.id))]


@pytest.mark.parametrize("offset", [0, 5, 49, 50, 1234, 9_999, 17_140, 19_995, 20_000, 30_000])
def test_page_by_counting(numbers, ordered, offset):
    got = page(numbers, KEY(), 10, offset, shallow=50, splits=16)
    assert [r.id for r in got.collect()] == ordered[offset:offset + 10]
    assert got.columns == numbers.columns


def test_deep_offset_keeps_few_rows_in_a_task(spark):
    rows = spark.range(1_200_000).withColumn("v", F.xxhash64("id") % 100)
    key = sort_key(descending("v"), ascending("id"))
    _, skip = page_start(rows, key, 1_000_000)
    assert skip <= 20_000
    got = page(rows, key, 5, 1_000_000)
    ids = [r.id for r in got.collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    kept = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert kept and max(kept) <= 20_005, plan
    whole = [r.id for r in rows.orderBy(F.desc("v"), "id").offset(1_000_000).limit(5).collect()]
    assert ids == whole


def test_keyset_pages_follow_each_other(numbers, ordered):
    last, ids = None, []
    for _ in range(4):
        rows = page_after(numbers, KEY(), last, 25).withColumn("key", KEY()).collect()
        ids += [r.id for r in rows]
        last = rows[-1]["key"]
    assert ids == ordered[:100]


def test_page_of_nothing(numbers):
    assert page(numbers.limit(0), KEY(), 10, 1000, shallow=50).count() == 0


def test_listing_pages_by_key_equal_pages_by_offset(spark):
    from marquee.plans.listings import listing_key, movie_listing, series_listing
    cat = catalog_snapshot(spark, SF_SMALL)
    for job, sort in ((movie_listing, "title"), (series_listing, "rating"), (series_listing, None)):
        first = job(cat, sort=sort, limit=7)
        last = first.select(listing_key(sort).alias("key")).collect()[-1]["key"]
        assert job(cat, sort=sort, limit=7, after=last).collect() == job(cat, sort=sort, limit=7, offset=7).collect()


def test_ranks_by_counting(spark, numbers, ordered):
    picks = numbers.where("id % 997 = 3 or id = 0")
    got = with_ranks(picks, numbers, "id", {"a": KEY(), "b": sort_key(ascending("v"), ascending("id"))})
    up = [r.id for r in sorted(numbers.collect(), key=lambda r: (r.v is None, r.v or 0, r.id))]
    rows = got.collect()
    assert len(rows) == picks.count()
    assert all((r.a, r.b) == (ordered.index(r.id) + 1, up.index(r.id) + 1) for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_windows_carry_over_borders_only(spark, partitions):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        "id", F.when(F.col("id") % 11 > 0, F.col("id") * 31 % 97).alias("v")).repartition(5)
    run = running_aggregates(rows, "key", [F.col("id").asc()], {"v": F.col("v")}, {"hit": F.col("v") > 80}, partitions)
    got = {(r.key, r.id): r for r in run.collect()}
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert len(got) == 3000
    by_key: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        by_key.setdefault(r.key, []).append(r)
    for members in by_key.values():
        values = [m.v for m in members]
        last = None
        for i, m in enumerate(members):
            known = [x for x in values[:i + 1] if x is not None]
            last = i + 1 if m.v is not None and m.v > 80 else last
            r = got[m.key, m.id]
            assert (r.pos, r.v_sum, r.v_count, r.v_max, r.hit_last) == (
                i + 1, sum(known) if known else None, len(known), max(known, default=None), last)
            assert (r.v_total_sum, r.v_total_count) == (sum(x or 0 for x in values), sum(x is not None for x in values))
