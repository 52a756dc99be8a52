"""Ranks and pages by counting, without sorting the whole input.

Both rest on one step: given a small sorted array of bounds, every row finds how many bounds are not above its
key, and a histogram of that number (as many cells as bounds, plus one) is all that leaves the tasks.

* `with_ranks`: the global ROW_NUMBER of a few picked rows in several orders, from one counting pass. A row
  precedes a pick if its number is not above the pick's place among the bounds.
* `page`: ORDER BY ... LIMIT ... OFFSET for any offset. A few hundred keys drawn by hash split the rows; the
  histogram tells between which two the offset falls; that range is split again until it holds few rows. Only
  then is anything sorted: the rows from that range's start on, cut to what is left of the offset plus the page.
  A shallow offset is a plain top-k. `page_after` is the keyset form: it starts behind a given last row.

Keys are structs that sort ascending (`sort_key`), unique among the rows (end them with an id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = 256        # bounds of one round
STEP = 16
SHALLOW = 10_000    # rows a task may hold beyond the page


def ascending(column: str) -> list[Column]:
    """Ascending, nulls last."""
    return [F.col(column).isNull(), F.col(column)]


def descending(column: str, nulls_first: bool = False) -> list[Column]:
    """Descending numbers, nulls last unless told otherwise."""
    null = F.col(column).isNull()
    return [~null if nulls_first else null, -F.col(column)]


def sort_key(*parts: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(c for p in parts for c in p)])


def _chunks(bounds: Column) -> Column:
    """A sorted array in chunks of STEP, so that a row looks at one chunk and the chunks' first bounds only."""
    count = F.ceil(F.size(bounds) / STEP).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                                         lambda i: F.slice(bounds, i * STEP + 1, F.lit(STEP))))


def _not_above(chunks: Column, key: Column) -> Column:
    """How many of the bounds are not above the key."""
    full = F.size(F.filter(chunks, lambda c: F.get(c, F.lit(0)) <= key)) - 1
    rest = F.size(F.filter(F.get(chunks, full), lambda b: b <= key))
    return F.when(full >= 0, full * STEP + rest).otherwise(F.lit(0))


def with_ranks(picks: DataFrame, rows: DataFrame, id_col: str, keys: Mapping[str, Column]) -> DataFrame:
    """`picks` (a bounded number of the `rows`) with a column per entry of `keys`: its 1-based position among
    all rows in that order."""
    bounds = {name: picks.agg(F.array_sort(F.collect_list(key)).alias("b")).select(_chunks(F.col("b"))).scalar()
              for name, key in keys.items()}

    def places(frame: DataFrame) -> DataFrame:
        frame = frame.withColumns({f"_bounds_{n}": b for n, b in bounds.items()})
        each = F.array(*[F.struct(F.lit(n).alias("order"), _not_above(F.col(f"_bounds_{n}"), k).alias("place"))
                         for n, k in keys.items()])
        return frame.select(id_col, F.explode(each).alias("_p")).select(id_col, "_p.*")

    cells = places(rows).groupBy("order", "place").agg(F.count(F.lit(1)).alias("n"))
    # a pick counts itself among the bounds not above it
    mine = places(picks).select(id_col, F.col("order").alias("_order"), (F.col("place") - 1).alias("_own"))
    before = (mine.join(cells, (F.col("order") == F.col("_order")) & (F.col("place") <= F.col("_own")), "left")
              .groupBy(id_col).agg(*[
                  (F.coalesce(F.sum(F.when(F.col("_order") == n, F.col("n"))), F.lit(0)) + 1).alias(n) for n in keys]))
    return picks.join(before, id_col)


def _between(keyed: DataFrame, lower: DataFrame | None, upper: DataFrame | None) -> DataFrame:
    if lower is not None:
        keyed = keyed.where(F.col("_key") >= lower.scalar())
    return keyed if upper is None else keyed.where(F.col("_key") < upper.scalar())


def _one(keyed: DataFrame, value: Row) -> DataFrame:
    """A frame of one key, for use as a scalar."""
    return keyed.sparkSession.createDataFrame([(value,)], T.StructType([keyed.schema["_key"]]))


def page_start(rows: DataFrame, key: Column, offset: int, shallow: int = SHALLOW,
               splits: int = SPLITS) -> tuple[Row | None, int]:
    """(first key, rows left to skip from it on), with at most about `shallow` rows left to skip; the first
    key is None for the start of the rows."""
    keyed = rows.select(key.alias("_key"))
    lower = upper = start = None
    while offset > shallow:
        here = _between(keyed, lower, upper)
        drawn = here.orderBy(F.xxhash64("_key"), "_key").limit(splits)
        drawn = drawn.agg(F.array_sort(F.collect_list("_key")).alias("b")).first().b
        if not drawn:
            break
        array = keyed.sparkSession.createDataFrame([(drawn,)], T.StructType(
            [T.StructField("b", T.ArrayType(keyed.schema["_key"].dataType))]))
        here = here.withColumn("_bounds", array.select(_chunks(F.col("b"))).scalar())
        cells = {r.place: r["count"] for r in here.groupBy(
            _not_above(F.col("_bounds"), F.col("_key")).alias("place")).count().collect()}
        place = 0
        while place < len(drawn) and offset >= cells.get(place, 0):
            offset -= cells.get(place, 0)
            place += 1
        if place == len(drawn) and offset >= cells.get(place, 0) and upper is None:
            return drawn[-1], offset        # past the last row
        if place > 0:
            start, lower = drawn[place - 1], _one(keyed, drawn[place - 1])
        if place < len(drawn):
            upper = _one(keyed, drawn[place])
        if cells.get(place, 0) <= shallow:
            break
    return start, offset


def page(rows: DataFrame, key: Column, limit: int, offset: int = 0, shallow: int = SHALLOW,
         splits: int = SPLITS) -> DataFrame:
    """The rows at `offset` + 1 to `offset` + `limit` in the order of `key`."""
    start, skip = page_start(rows, key, offset, shallow, splits)
    return page_after(rows, key, None, limit, start, skip)


def page_after(rows: DataFrame, key: Column, last: Row | None, limit: int, start: Row | None = None,
               skip: int = 0) -> DataFrame:
    """The first `limit` rows behind the row whose key is `last` (its `sort_key`, as collected); or `skip` rows
    behind the key `start`, that row counted."""
    keyed = rows.withColumn("_key", key)
    if start is not None:
        keyed = keyed.where(F.col("_key") >= _one(keyed, start).scalar())
    if last is not None:
        keyed = keyed.where(F.col("_key") > _one(keyed, last).scalar())
    ordered = keyed.orderBy("_key")
    if skip:
        ordered = ordered.offset(skip)
    return ordered.limit(limit).drop("_key")
