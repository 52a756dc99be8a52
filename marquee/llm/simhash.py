"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Fingerprints: `[^\\x20\\x09-\\x0D]+` words, A-Z lower-cased, shingles of `shingle` words joined by one
space (repeats count; fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if it is set in
over half of the hashes. A text without words, empty or null, has fingerprint 0 and is linked like any
other.

Self-join: equal fingerprints collapse first (hot groups of copies become one row). The distinct
fingerprints are leaves of a binary trie. Its top `depth` levels are cut off: every pair of nodes at that
depth whose prefixes differ in no more bits than allowed is one unit of work, dealt over the cluster by
the smaller prefix; below, one task walks the two subtrees of a unit together, adds up differing bits and
drops a pair of nodes as soon as the sum is over the budget. A task emits a spanning forest of the links
it found, so a dense group costs no more rows than it has fingerprints.

Edge cases: rows are kept one to one; repeated rows and repeated ids are linked like any others; null ids
never become a component id unless all ids of the component are null; an empty table gives no rows;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, key_runs, materialise, raw_texts, slices
from .components import LocalForest, connected_components

SEED = 42
LEAF = 1024          # fingerprints per node of the cut-off trie level, on average
MAX_DEPTH = 24
FRONTIER = 200_000   # node pairs held at once while walking
SMALL = 32           # a node pair with at most so many leaf pairs is compared directly


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text given as UTF-8."""
    words = raw.split()
    if not words:
        return 0
    text = b" ".join(words).lower()  # bytes.lower() changes A-Z only
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in spans], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, hashes.size, 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) per row; the long holds the 64 fingerprint bits."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, fp long"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                fps = np.array([fingerprint(t, shingle) for t in raw_texts(part.column("body"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, schema)


def _expand(f, lo1, hi1, lo2, hi2, budget):
    """All leaf pairs under node pairs, compared directly."""
    width = hi2 - lo2
    total = (hi1 - lo1) * width
    pair = np.repeat(np.arange(total.size), total)
    at = np.arange(pair.size) - np.repeat(np.cumsum(total) - total, total)
    i, j = lo1[pair] + at // width[pair], lo2[pair] + at % width[pair]
    near = (i < j) & (np.bitwise_count(f[i] ^ f[j]) <= budget)
    return i[near], j[near]


def trie_pairs(f: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, budget: int):
    """Walk pairs of trie nodes together. `f`: sorted distinct uint64; `nodes`: arrays (lo1, hi1, lo2,
    hi2, differing bits so far) of index ranges that share their top `depth` bits. Yields index arrays
    (i, j), i < j, of all leaf pairs within `budget` differing bits."""
    stack = [(depth, nodes)]
    while stack:
        depth, (lo1, hi1, lo2, hi2, diff) = stack.pop()
        if lo1.size > FRONTIER:  # half at a time, so that memory stays bounded
            cut = lo1.size // 2
            stack.append((depth, (lo1[cut:], hi1[cut:], lo2[cut:], hi2[cut:], diff[cut:])))
            lo1, hi1, lo2, hi2, diff = lo1[:cut], hi1[:cut], lo2[:cut], hi2[:cut], diff[:cut]
        few = (hi1 - lo1) * (hi2 - lo2) <= (SMALL if depth < 64 else np.iinfo(np.int64).max)
        if few.any():
            yield _expand(f, lo1[few], hi1[few], lo2[few], hi2[few], budget)
        if few.all():
            continue
        lo1, hi1, lo2, hi2, diff = (x[~few] for x in (lo1, hi1, lo2, hi2, diff))
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64((~((1 << (64 - depth)) - 1)) & ((1 << 64) - 1))
        mid1 = np.clip(np.searchsorted(f, (f[lo1] & above) | bit), lo1, hi1)
        mid2 = np.clip(np.searchsorted(f, (f[lo2] & above) | bit), lo2, hi2)
        same = lo1 == lo2  # a node paired with itself: its mixed pair once
        parts = []
        for a, b, keep, more in (((lo1, mid1), (lo2, mid2), None, 0), ((mid1, hi1), (mid2, hi2), None, 0),
                                 ((lo1, mid1), (mid2, hi2), None, 1), ((mid1, hi1), (lo2, mid2), ~same, 1)):
            ok = (a[1] > a[0]) & (b[1] > b[0]) & (diff + more <= budget)
            ok = ok if keep is None else ok & keep
            parts.append((a[0][ok], a[1][ok], b[0][ok], b[1][ok], diff[ok] + more))
        stack.append((depth + 1, tuple(np.concatenate(x) for x in zip(*parts))))


def _link_run(fps: np.ndarray, bucket: int, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one bucket: its own fingerprints with each other and with those
    whose larger prefix differs in at most `budget` bits."""
    f = np.sort(fps)
    prefix = (f >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(f.size, np.int64)
    values, starts = np.unique(prefix, return_index=True)
    ends = np.append(starts[1:], f.size)
    own = int(np.searchsorted(values, bucket))
    if own == values.size or values[own] != bucket:  # nobody lives here, only visitors came
        return f[:0], f[:0]
    diff = np.bitwise_count(values.astype(np.uint64) ^ np.uint64(bucket)).astype(np.int64)
    nodes = (np.full(values.size, starts[own]), np.full(values.size, ends[own]), starts, ends, diff)
    forest = LocalForest(f.size)
    for i, j in trie_pairs(f, nodes, depth, budget):
        forest.add(i, j)
    a, b = forest.edges()
    return f[a], f[b]


def near_links(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Links (u, v) that join the distinct fingerprints (column fp) into the same components as all
    pairs within `max_bits` differing bits would."""
    depth = min(MAX_DEPTH, max(0, ceil(log2(max(1, n / LEAF)))))
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    masks = [sum(1 << b for b in bits) for k in range(max_bits + 1) for bits in combinations(range(depth), k)]
    visits = (fps.select("fp", prefix.alias("own"))
              .select("fp", "own", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
              .select(F.col("own").bitwiseXOR(F.col("mask")).alias("bucket"), "fp", "own")
              .where(F.col("bucket") <= F.col("own")).select("bucket", "fp"))

    def run(batches):
        for whole in key_runs(batches, ["bucket"], min_rows=1 << 15):
            bucket = whole.column("bucket").to_numpy()
            fp = whole.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for part, b in zip(np.split(fp, cuts), bucket[np.concatenate(([0], cuts))]):
                u, v = _link_run(part, int(b), depth, max_bits)
                if u.size:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                                     ["u", "v"])

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (visits.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "u long, v long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """(id column, fp long, fingerprint hex string, component_id) for every row of `docs`."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    links = near_links(nodes, nodes.count(), max_bits)
    labels = connected_components(links, "simhash")
    labelled = materialise(nodes.join(labels, nodes.fp == labels.node, "left")
                           .select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = join_hot(labelled.select("fp", "label"), smallest, "label", "simhash-label").select("fp", "component_id")
    return join_hot(rows, materialise(of_fp, "simhash-classes"), "fp", "simhash-fp").select(
        F.col("id").alias(id_col), "fp",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                        max_bits: int = 2) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, one row for each id (of rows that
    repeat an id, the one with the smallest text hash). Rows without an id cannot be named as a keeper
    or as a copy; they stay."""
    classes = simhash_components(docs, id_col, text_col, shingle, max_bits)
    chosen = classes.groupBy(F.col("component_id").alias(id_col)).agg(F.count(F.lit(1)).alias("size")).select(id_col)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))
    kept = docs.where(F.col(id_col).isNotNull()).join(chosen, id_col, "left_semi").withColumn("_llm_rank", rank)
    return (kept.where("_llm_rank = 1").select(*docs.columns)
            .unionByName(docs.where(F.col(id_col).isNull())))
