"""Physical-plan guards for the scale rules: no cartesian or nested-loop joins, no Python in the
plans, single-partition exchanges only over bounded frames, partition pruning on typed scans."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMALL
from marquee import registry

QUERIES = registry.queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def executed_plan(spark, name: str) -> str:
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()  # runs the frame's own plan (a write would plan anew)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("AdaptiveSparkPlan isFinalPlan=true") or "AdaptiveSparkPlan" not in plan.split("\n")[0]
    return plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_nested_loop_or_python(spark, name):
    plan = executed_plan(spark, name)
    assert not [p for p in FORBIDDEN if p in plan], plan


# (jobs whose final plan reads a checkpoint ran their scans in the checkpoint job, so they are
# not listed here)
@pytest.mark.parametrize("name", ["movie_summary", "series_summary", "genre_performance", "featured_movies",
                                  "featured_series", "movie_top_cast", "genre_popularity", "episode_cast"])
def test_typed_title_scans_prune_partitions(spark, name):
    plan = executed_plan(spark, name)
    scans = re.findall(r"FileScan parquet \S*titles[^\n]*", plan) or re.findall(
        r"FileScan parquet [^\n]*title_type[^\n]*", plan)
    assert any("PartitionFilters: [isnotnull(title_type" in s or "PartitionFilters: [(title_type" in s
               for s in scans), scans


def test_search_many_equals_search_for_any_term(spark):
    from marquee.plans.listings import search, search_many
    from marquee.registry import catalog_snapshot
    cat = catalog_snapshot(spark, SF_SMALL)
    words = ["title 1", "T%1_", "a\\ctor 1", "12", "\\%", "per\\son\\ 1", "%%%", "\\"]
    batch = search_many(cat, spark.createDataFrame([(w,) for w in words * 2], "term string"), limit=4).collect()
    for w in words:
        one = [r.id for r in search(cat, w, limit=4).collect()]
        assert [r.id for r in sorted((r for r in batch if r.term == w), key=lambda r: r.rank)] == one, w


def test_search_many_checks_few_rows_in_vain(spark):
    from pyspark.sql import functions as F
    from marquee.plans.listings import TITLE_TEXTS, search_index
    from marquee.registry import catalog_snapshot
    cat = catalog_snapshot(spark, SF_SMALL)
    terms = cat.titles.select(F.substring("primary_title", 1, 8).alias("term"))
    index = search_index(cat, terms)
    candidates, matches = (f(cat.titles, TITLE_TEXTS).count() for f in (index.candidates, index.matches))
    assert 0 < matches <= candidates <= 2 * matches, (candidates, matches)


@pytest.mark.parametrize("cell, small", [(4096, 100_000), (7, 0)])
def test_search_many_joins_on_keys_without_broadcast(spark, monkeypatch, cell, small):
    """Short, wildcard-only and shared terms too; the second case deals every hot gram to a grid of cells."""
    from marquee.operators import grams
    from marquee.plans.listings import search, search_many
    from marquee.registry import catalog_snapshot
    monkeypatch.setattr(grams, "CELL", cell)
    monkeypatch.setattr(grams, "SMALL", small)
    cat = catalog_snapshot(spark, SF_SMALL)
    words = ["title 1", "t", "%", "", "_", "1_", "12", "zz", "nowhere", "İ", "le 4%son"] + [f"itle {i}" for i in range(20)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = search_many(cat, spark.createDataFrame([(w,) for w in words * 2], "term string"), limit=3)
        rows = batch.collect()
        plan = batch._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for w in words[:11]:
        one = [r.id for r in search(cat, w, limit=3).collect()]
        assert [r.id for r in sorted((r for r in rows if r.term == w), key=lambda r: r.rank)] == one, w


def test_check_catalog_uses_the_real_keys(spark):
    from pyspark.sql import functions as F
    from marquee.plans.checks import check_catalog
    from marquee.registry import catalog_snapshot
    cat = catalog_snapshot(spark, SF_SMALL)
    row = cat.title_people.limit(1)
    glued = [row.withColumns({"title_id": F.lit(a), "person_id": F.lit(b)}) for a, b in (("x|y", "z"), ("x", "y|z"))]
    people = cat.title_people.unionByName(glued[0]).unionByName(glued[1])
    report = {r.rule: r for r in check_catalog(cat.replace(title_people=people)).where("table = 'title_people'").collect()}
    assert next(r for k, r in report.items() if k.startswith("primary key")).violations == 0
    assert sum(r.violations for k, r in report.items() if "references" in k) == 4


@pytest.mark.parametrize("name", ["movie_summary", "movie_top_cast", "series_top_cast", "episode_cast"])
def test_credit_scans_prune_categories(spark, name):
    plan = executed_plan(spark, name)
    scans = [s for s in re.findall(r"FileScan parquet [^\n]*", plan) if "title_people" in s or "category" in s]
    assert any("PartitionFilters: [" in s and "category" in s.split("PartitionFilters: [")[1].split("]")[0]
               for s in scans), scans
