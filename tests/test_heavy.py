"""Heavy keys: join chains stay balanced, pairs on a huge title are not emitted; results equal the plain ones."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marquee.operators.pairs import prune, threshold_pairs
from marquee.operators.skew import HeavyKeys, join_chain


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("-1", "32", "false")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_task(df) -> float:
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_join_chain_splits_a_hot_title(spark, no_broadcast):
    hot = F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 3000))
    credits = spark.range(60_000).select(hot.alias("title"), F.col("id").alias("person"))
    assert credits.where("title = 'hot'").count() == 0.4 * credits.count()
    names = [("hot",), *((f"t{i}",) for i in range(3000))]
    titles = spark.createDataFrame(names, "title string").withColumn("year", F.length("title"))
    ratings = titles.where("title <> 't1'").select("title", F.lit(7).alias("rating"))
    genres = titles.where("title <> 't2'").select("title", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("genre"))
    others = [(titles, "inner"), (ratings, "left"), (genres, "inner"), (titles.where("year > 2"), "left_semi")]
    heavy = HeavyKeys(credits, "title", share=100, least=100)
    assert [r[0] for r in heavy.table.collect()] == ["hot"]
    salted = join_chain(credits, "title", others, heavy, ["person"])
    plain = join_chain(credits, "title", others, HeavyKeys(credits, "title", least=10**9), ["person"])
    salted_rows, plain_rows = salted.cache(), plain.cache()
    assert salted_rows.columns == plain_rows.columns
    assert salted_rows.exceptAll(plain_rows).isEmpty() and plain_rows.exceptAll(salted_rows).isEmpty()
    assert largest_task(plain) > 0.4
    assert largest_task(salted) < 0.1  # 32 tasks; one row in 100 per (title, salt)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_heavy_keys_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1)] * 5, "title string, person long")
    heavy = HeavyKeys(rows, "title", least=1)
    assert not heavy.any
    assert not HeavyKeys(rows.limit(0), "title", least=0).any


def plain_pairs(lefts, rights, values, min_count):
    count, total, rated = Counter(), Counter(), Counter()
    for key, a in lefts:
        for k, b, w in rights:
            if k == key and a != b:
                count[a, b] += w
                if values.get(key) is not None:
                    total[a, b] += w * values[key]
                    rated[a, b] += w
    return sorted((a, b, n, total[a, b] if rated[a, b] else None, rated[a, b] or None)
                  for (a, b), n in count.items() if n >= min_count)


@pytest.mark.parametrize("seed, block, min_count", [(1, 1000, 3), (2, 3, 3), (3, 2, 2), (4, 3, 5), (5, 1, 1)])
def test_threshold_pairs_equal_the_plain_count(spark, seed, block, min_count):
    rng = random.Random(seed)
    people = [f"p{i}" for i in range(30)]
    lefts, rights, values = set(), {}, {}
    for key in range(25):
        size = rng.choice([1, 2, 3, 15])
        lefts |= {(key, p) for p in rng.sample(people, size)}
        rights.update({(key, p): rng.choice([1, 1, 2]) for p in rng.sample(people, size)})
        if rng.random() < .8:
            values[key] = rng.choice([None, Decimal("7.5"), Decimal("3.1")])
    rights = [(k, p, w) for (k, p), w in rights.items()]
    got = threshold_pairs(spark.createDataFrame(sorted(lefts), "key long, left string"),
                          spark.createDataFrame(rights, "key long, right string, weight long"),
                          spark.createDataFrame(list(values.items()), "key long, value decimal(3,1)"),
                          min_count, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_pairs(lefts, rights, values, min_count)


def test_a_huge_title_emits_no_pairs_below_the_count(spark):
    """10,000 directors and cast on one title; two of each meet on two more."""
    crowd = [("big", f"d{i}") for i in range(10_000)], [("big", f"a{i}", 1) for i in range(10_000)]
    more = [(t, d) for t in ("x", "y") for d in ("d1", "d2")], [(t, a, 1) for t in ("x", "y") for a in ("a1", "a2")]
    lefts = spark.createDataFrame(crowd[0] + more[0], "key string, left string")
    rights = spark.createDataFrame(crowd[1] + more[1], "key string, right string, weight long")
    values = spark.createDataFrame([("big", Decimal("6.0")), ("x", None)], "key string, value decimal(3,1)")
    a, b = prune(lefts, rights, 3)
    assert (a.count(), b.count()) == (6, 6)
    got = sorted(tuple(r) for r in threshold_pairs(lefts, rights, values, 3).collect())
    assert got == [(d, p, 3, Decimal("6.0"), 1) for d in ("d1", "d2") for p in ("a1", "a2")]


def test_a_huge_title_of_busy_people_is_counted_in_blocks(spark):
    """Everyone is busy enough to survive the pruning, but hardly any pair meets three times."""
    n = 2000
    lefts = [("big", f"d{i}") for i in range(n)] + [(f"l{i}_{j}", f"d{i}") for i in range(n) for j in range(2)]
    rights = [("big", f"a{i}", 1) for i in range(n)] + [(f"l{(i + j) % n}_{j}", f"a{i}", 1) for i in range(n) for j in range(2)]
    got = threshold_pairs(spark.createDataFrame(lefts, "key string, left string"),
                          spark.createDataFrame(rights, "key string, right string, weight long"),
                          spark.createDataFrame([], "key string, value decimal(3,1)"), 2, block=200)
    rows = got.collect()
    assert len(rows) == 2 * n  # each a meets d on `big` and one light title, twice
    assert {r["count"] for r in rows} == {2} and {r["total"] for r in rows} == {None}
