"""Helpers shared by the text operators: tables, scratch tables, Arrow batches, skew-safe joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_scratch_path

# White space of every contract: [\x20\x09-\x0D]. `bytes.split()` splits at exactly these bytes.
WHITE_SPACE = "[ \t-\r]+"

# A key with more than one row in HOT_KEYS is joined by broadcast: there are fewer than HOT_KEYS of them,
# and no shuffle partition gets more than that share from any other key.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table in the shared scratch folder and read it back: cuts the lineage, so a
    lost executor never recomputes what came before, and several readers share one computation."""
    path = new_scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_column(text: Column) -> Column:
    """The words of a text as an array, in the JVM; an empty array for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_SPACE))


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row even where `use` refers to it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose `column` holds about `max_bytes` each (one row at least),
    so that the Python objects made from a slice stay small whatever the batch size is."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; empty for null."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def flat_lists(lists: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(lists, type=pa.list_(kind))


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str], min_rows: int = 1) -> Iterator[pa.Table]:
    """Re-cut batches of a partition that is sorted by `keys` into tables that end where a key ends,
    each with at least `min_rows` rows (but the last)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < min_rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = _last_run(whole, keys)
        if last:
            yield whole.slice(0, last)
        rest = whole.slice(last)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_run(whole: pa.Table, keys: list[str]) -> int:
    """Row at which the last run of equal keys begins."""
    same = np.ones(whole.num_rows, dtype=bool)
    for k in keys:
        values = whole.column(k)
        same &= pc.fill_null(pc.equal(values, values[-1]), False).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if other.size else 0


def smallest_hashes(df: DataFrame, key: str, k: int) -> DataFrame:
    """The `k` rows with the smallest hashes of `key`. Rows that cannot be among them are left out before
    the sort, so no task passes on more than its share."""
    share = min(1.0, 1.2 * k / max(1, df.count()))
    order = F.xxhash64(key)
    few = df if share == 1.0 or share * df.count() < 1000 else df.where(F.shiftrightunsigned(order, 32) < int(share * (1 << 32)))
    return few.orderBy(F.shiftrightunsigned(order, 32), order, key).limit(k)


def join_hot(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left join to a `right` side with unique keys, safe for skewed `left` keys.

    Keys with more than one row in HOT_KEYS of `left` (fewer than HOT_KEYS keys, whatever the data) are
    looked up in `right`, written, and joined by broadcast; all other keys are joined by shuffle. `key`
    must not be null."""
    least = max(1, left.count() // HOT_KEYS)
    hot = left.groupBy(key).count().where(F.col("count") > least).select(key)
    hot = materialise(hot.join(right, key, "left"), f"{name}-hot")
    frequent = left.join(F.broadcast(hot), key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, "left")
    return frequent.unionByName(others)
