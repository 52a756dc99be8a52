"""Operators against their plain-Spark definitions."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators.position import with_global_position, with_ntile
from marquee.operators.topk import top_k_per_key
from marquee.operators.upsert import insert_if_absent, keep_first


def frame(spark, n, skew=False):
    # value has many ties; with skew a third of all rows share one value
    value = F.when(F.lit(skew) & (F.col("id") % 3 == 0), F.lit(7)).otherwise(F.col("id") * 7919 % 13)
    return spark.range(n).select(F.col("id"), value.alias("v"))


@pytest.mark.parametrize("n,tiles,parts,skew", [(0, 4, 3, False), (3, 4, 2, False), (1001, 4, 7, False),
                                                (997, 5, 4, True), (64, 4, 1, False)])
def test_ntile_equals_window_ntile(spark, n, tiles, parts, skew):
    df = frame(spark, n, skew)
    order = [F.col("v").asc(), F.col("id").asc()]
    ours = with_ntile(df, order, tiles, name="t", partitions=parts)
    ref = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order)))
    assert sorted(ours.collect()) == sorted(ref.collect())


def test_global_position_equals_row_number(spark):
    df = frame(spark, 2000, skew=True)
    order = [F.col("v").desc(), F.col("id").asc()]
    ours = with_global_position(df, order, name="p", partitions=6, total_name="n")
    ref = df.withColumn("p", F.row_number().over(Window.orderBy(*order))).withColumn("n", F.lit(2000))
    assert sorted(ours.select("id", "v", "p", "n").collect()) == sorted(
        ref.select("id", "v", F.col("p").cast("bigint"), F.col("n").cast("bigint")).collect())


def test_top_k_per_key_with_a_hot_key(spark):
    df = frame(spark, 3000, skew=True).withColumn("k", F.col("v") % 4)
    got = top_k_per_key(df, ["k"], [F.col("id").desc()], 3).select("k", "id", "pos")
    expected = []
    for k in range(4):
        ids = sorted((r["id"] for r in df.where(F.col("k") == k).collect()), reverse=True)[:3]
        expected += [(k, i, p + 1) for p, i in enumerate(ids)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_keep_first_and_insert_if_absent(spark):
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "b"), ("c", 1, "c")],
                                "k string, o int, val string")
    first = keep_first(new, ["k"], [F.col("o")])
    assert sorted((r["k"], r["val"]) for r in first.collect()) == [("a", "early"), ("b", "b"), ("c", "c")]
    existing = spark.createDataFrame([("b", 0, "kept")], "k string, o int, val string")
    merged = insert_if_absent(new, existing, ["k"], [F.col("o")])
    assert sorted((r["k"], r["val"]) for r in merged.collect()) == [("a", "early"), ("b", "kept"), ("c", "c")]


@pytest.mark.parametrize("parts", [1, 5])
def test_running_aggregates_equal_plain_windows_with_a_hot_key(spark, parts):
    from decimal import Decimal
    from marquee.operators.running import running_aggregates

    rows = [(("hot" if i % 3 else f"k{i % 7}"), i, (None if i % 11 == 0 else Decimal(str((i * 37) % 50 / 10))))
            for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, x decimal(3,1)")
    order = [F.col("i").asc()]
    got = running_aggregates(df, "k", order, {"x": F.col("x")}, {"big": F.col("x") > 3}, partitions=parts)
    w = Window.partitionBy("k").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = df.select(
        "k", "i", "x", F.row_number().over(w).alias("pos"),
        F.sum("x").over(upto).alias("x_sum"), F.count("x").over(upto).alias("x_count"),
        F.max("x").over(upto).alias("x_max"),
        F.sum("x").over(Window.partitionBy("k")).alias("x_total_sum"),
        F.count("x").over(Window.partitionBy("k")).alias("x_total_count"),
        F.max(F.when(F.col("x") > 3, F.row_number().over(w))).over(upto).alias("big_last"))
    cols = ["k", "i", "x", "pos", "x_sum", "x_count", "x_max", "x_total_sum", "x_total_count", "big_last"]
    norm = lambda df: sorted(tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.select(cols).collect())
    assert norm(got) == norm(ref)


def test_run_concurrently_returns_in_order_and_reraises(spark):
    from marquee.session import run_concurrently
    assert run_concurrently(lambda: spark.range(3).count(), lambda: spark.range(5).count()) == [3, 5]

    def boom():
        raise RuntimeError("write failed")

    with pytest.raises(RuntimeError, match="write failed"):
        run_concurrently(lambda: spark.range(2).count(), boom)
