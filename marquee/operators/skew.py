"""Heavy-light joins: several joins on one key stay balanced when a few values of the key hold most rows.

Adaptive execution splits a skewed partition of a single join, but not where the next operator relies on the
partitioning, as in a chain of joins on the same key. Here the heavy values are found once (`HeavyKeys`): those
with more than one row in `share`, so there are fewer than `share` of them, and their table may be broadcast
whatever the data. Rows are counted per hash bucket of the value first; only the values of buckets that hold more
rows than the limit are counted one by one, so without heavy values the rows themselves are never shuffled. Rows of a heavy value are dealt to as many salts as it takes to get below that count; the
other sides of the chain are copied to every salt of their value. All joins of the chain are then on
(key, salt): the large side is shuffled once, its salt is carried along, and no (key, salt) group of it holds
more than about one row in `share`. Without heavy values the chain is the plain one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

SHARE = 1000
LEAST = 10_000      # a value with fewer rows is never heavy
BUCKETS = 1 << 16   # far more than `share`, so that a bucket of light values stays below the limit
_SALT, _KEY, _COPIES = "_salt", "_heavy_key", "_salts"


class HeavyKeys:
    """The values of `key` that hold more than one row in `share` of `rows` (and more than `least` rows)."""

    def __init__(self, rows: DataFrame, key: str, share: int = SHARE, least: int = LEAST):
        scratch_dir(rows.sparkSession)
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        sizes = (rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
                 .checkpoint(eager=True))   # at most BUCKETS rows
        limit = max(least, (sizes.agg(F.sum("_n")).first()[0] or 0) // share)
        self.crowded = [r["_bucket"] for r in sizes.where(F.col("_n") > limit).select("_bucket").collect()]  # < share
        counts = (rows.where(F.col(key).isNotNull() & bucket.isin(self.crowded))
                  .groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
        self.table = (counts.where(F.col("_n") > limit)
                      .select(F.col(key).alias(_KEY), F.ceil(F.col("_n") / limit).cast("int").alias(_COPIES))
                      .checkpoint(eager=True))
        self.any = not self.table.isEmpty()

    def _marked(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(self.table), F.col(key) == F.col(_KEY), "left")

    def deal(self, rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
        """`rows` with a salt: rows of a heavy value are spread by a hash of the columns `by`."""
        salt = F.pmod(F.xxhash64(*by), F.coalesce(_COPIES, F.lit(1)).cast("long")).cast("int")
        return self._marked(rows, key).withColumn(_SALT, salt).drop(_KEY, _COPIES)

    def copy(self, rows: DataFrame, key: str) -> DataFrame:
        """`rows` once per salt of their value."""
        salts = F.explode(F.sequence(F.lit(0), F.coalesce(_COPIES, F.lit(1)) - 1))
        return self._marked(rows, key).withColumn(_SALT, salts).drop(_KEY, _COPIES)


def join_chain(rows: DataFrame, key: str, others: Sequence[tuple[DataFrame, str]], heavy: HeavyKeys,
               by: Sequence[str]) -> DataFrame:
    """`rows` joined on `key` with each (frame, how) of `others`, which have the column `key` too.

    `how`: inner, left, left_semi or left_anti. The columns `by` tell the rows of one value apart (they need
    not be unique); rows that agree in all of them share a salt."""
    if not heavy.any:
        for other, how in others:
            rows = rows.join(other, key, how)
        return rows
    out = heavy.deal(rows, key, by)
    for other, how in others:
        out = out.join(heavy.copy(other, key), [key, _SALT], how)
    return out.drop(_SALT)
