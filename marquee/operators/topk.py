"""Top-k operators.

* `top_k_per_key`: `row_number() <= k` per key. Spark plans it with a partial `WindowGroupLimit`
  before the shuffle, so every map task forwards at most k rows per key: a key holding a third of
  the input still ships only k rows per task (a combiner for top-k).
* `top_k`: a global ORDER BY ... LIMIT k [OFFSET m], planned as TakeOrderedAndProject (each task
  keeps its k+m best rows; the driver merges at most tasks x (k+m) rows).
* `top_k_table`: the same, materialised once (reliable checkpoint of at most k rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir


def top_k_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int,
                  name: str = "pos") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(k)


def top_k_table(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """`top_k` computed once and checkpointed (at most k rows), for a report that later steps read
    several times (restricting other frames to its ids, then joining it): Spark does not reuse the
    upstream work across those readers, so without this each of them would recompute it."""
    scratch_dir(df.sparkSession)
    return top_k(df, order, k, offset).checkpoint(eager=True)
