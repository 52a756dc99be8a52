"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each bucket.

1. The global histogram of lengths (words per text) is counted in Spark: one cell per length that occurs, so
   their number is bounded by the longest text. A cell carries its rows and its tokens.
2. Every text is padded to the largest length of its bucket. Padding of a bucket = rows * largest length -
   tokens. Dynamic programming over the cells finds the `n_buckets` buckets of least total padding
   (divide and conquer over the optimal cuts, which move one way only: cells * log(cells) * buckets, in
   whole numbers, all cells of one depth at once).
3. A batch of a bucket holds floor(budget / bucket length) texts, one at least. Rows of a bucket are dealt
   to shards of about `SHARD` rows by a hash of id and text and numbered inside the shard in the order of
   the hash, so that no window holds a whole bucket; only a shard's last batch may be partly filled.

Edge cases: a null or empty text has length 0; texts longer than the budget get batches of their own, never
cut; repeated rows and ties are numbered one after the other, each with a place of its own; fewer distinct
lengths than buckets give as many buckets as lengths; an empty table gives no rows; input columns named
like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words_column

N_BUCKETS = 16
TOKEN_BUDGET = 16_384
EXACT = 4096
NEVER = np.int64(1 << 61)    # padding of what cannot be
SHARD = 1 << 16


def length_cell(n) -> F.Column:
    """A rough histogram cell: a number's own up to EXACT, above that its leading seven bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)))) - 6, F.lit(0)))
    return F.when(n <= EXACT, n).otherwise((F.floor(n / step) * step).cast("long"))


def optimal_buckets(rows: np.ndarray, tokens: np.ndarray, largest: np.ndarray, n_buckets: int) -> list[int]:
    """Last cell of each bucket, for the least total padding with at most `n_buckets` buckets.

    Cells are in order of length. Ties take the partition with fewer buckets, then earlier cuts."""
    m = rows.size
    if not m:
        return []
    r = np.concatenate(([0], np.cumsum(rows, dtype=np.int64)))
    t = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))

    def cost(i, j):  # cells i..j-1 as one bucket
        return largest[j - 1] * (r[j] - r[i]) - (t[j] - t[i])

    best = np.concatenate(([0], cost(np.zeros(m, np.int64), np.arange(1, m + 1))))
    cuts = [np.zeros(m + 1, np.int64)]
    totals = [best[m]]
    for _ in range(1, min(n_buckets, m)):
        new, cut = np.full(m + 1, NEVER), np.zeros(m + 1, np.int64)
        lo, hi, first, last = (np.array([x]) for x in (1, m, 0, m - 1))
        while lo.size:
            mid = (lo + hi) // 2
            sizes = np.minimum(last, mid - 1) - first + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) + np.repeat(first - starts, sizes)
            c = best[i] + cost(i, np.repeat(mid, sizes))
            least = np.minimum.reduceat(c, starts)
            ties = np.flatnonzero(c == np.repeat(least, sizes))
            k = i[ties[np.searchsorted(ties, starts)]]
            new[mid], cut[mid] = least, k
            lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, k), (k, last)))
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        best = new
        cuts.append(cut)
        totals.append(best[m])
    k, end, ends = int(np.argmin(totals)), m, []
    while end > 0:
        ends.append(int(end) - 1)
        end, k = cuts[k][end], k - 1
    return ends[::-1]


def length_histogram(sized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rows, length) by length, in order; at most as many cells as the longest text has words."""
    cells = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).toArrow()
    length, rows = (cells.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "rows"))
    order = np.argsort(length)
    return rows[order], length[order]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS,
         token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD) -> DataFrame:
    """(id, n_tokens, bucket, padded_len, shard, batch, slot) per row of `docs`; a batch is named by
    (bucket, shard, batch), `slot` is the place in it."""
    sized = materialise(docs.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("_llm_order"),
                                    F.size(words_column(F.col(text_col))).cast("long").alias("n_tokens")), "lengths")
    rows, largest = length_histogram(sized)
    ends = optimal_buckets(rows, rows * largest, largest, n_buckets)
    if not ends:
        return sized.select(id_col, "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in _PLACE]).limit(0)
    total = np.concatenate(([0], np.cumsum(rows)))
    bucket = padded = shards = None
    for b in range(len(ends) - 1, -1, -1):
        top = int(largest[ends[b]])
        members = int(total[ends[b] + 1] - total[ends[b - 1] + 1 if b else 0])
        here = [F.lit(b), F.lit(top).cast("long"), F.lit(max(1, -(-members // shard_rows)))]
        if bucket is None:
            bucket, padded, shards = here
        else:
            fits = F.col("n_tokens") <= top
            bucket, padded, shards = (F.when(fits, x).otherwise(y) for x, y in zip(here, (bucket, padded, shards)))
    placed = (sized.withColumn("bucket", bucket).withColumn("padded_len", padded)
              .withColumn("shard", F.pmod(F.col("_llm_order"), shards.cast("long")).cast("int")))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("padded_len", F.lit(1))))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("_llm_order", id_col, "n_tokens")) - 1
    return (placed.withColumn("_llm_number", number)
            .select(id_col, "n_tokens", "bucket", "padded_len", "shard",
                    F.floor(F.col("_llm_number") / per_batch).cast("long").alias("batch"),
                    F.pmod(F.col("_llm_number"), per_batch).cast("long").alias("slot")))


_PLACE = (("bucket", "int"), ("padded_len", "long"), ("shard", "int"), ("batch", "long"), ("slot", "long"))
