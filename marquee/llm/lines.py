"""Line dedup with two Bloom filters: hashes seen once and hashes seen twice.

A line's key is the line without white space at both ends, A-Z lower-cased. A key of at least `min_chars`
code points that occurs in two documents or more loses all its lines except those in the document with
the smallest id that holds it.

1. Every task hashes the keys of its documents (each key once per document) and sets two bits per hash in
   a blocked bit array. Filters are merged block by block: a bit set by two tasks, or twice by one, goes to
   the second filter. Only bit positions are shuffled. The arrays have `BITS_PER_LINE` bits per line.
2. Lines whose two bits are both set in the second filter are suspected repeats. No repeated key can be
   missed; a few single keys may be suspected. While the second filter is within `broadcast_bits`, tasks
   look it up locally; beyond, line hashes are sent to the filter's blocks instead.
3. Only suspected lines are shuffled, grouped by the key itself: the smallest document id, and whether there
   are two documents.
4. Dropped line numbers go back to their documents.

Edge cases: null text is one empty line (the kept text is empty); rows with equal ids are one document;
a null id is one document that comes last; repeated rows each lose the same lines; an empty table gives
no rows; internal names carry a prefix, and input columns named like an output column are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, materialise, slices

BITS_PER_LINE = 8
BLOCK_BITS = 1 << 20
MAX_BLOCKS = 1 << 14
BROADCAST_BITS = 1 << 29
SPACE = " \t\n\x0b\x0c\r"


class Layout:
    """Where a 64-bit hash sets its two bits: a block, and two positions in it."""

    def __init__(self, n_lines: int):
        bits = max(BLOCK_BITS, 1 << max(0, BITS_PER_LINE * n_lines - 1).bit_length())
        self.block_bits = max(BLOCK_BITS, bits // MAX_BLOCKS)
        self.blocks = bits // self.block_bits
        self.bits = bits

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = (h & np.uint64(self.blocks - 1)).astype(np.int64)
        first = ((h >> np.uint64(14)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        second = ((h >> np.uint64(14)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        inside = np.uint64(self.block_bits - 1)
        return block, (first & inside).astype(np.int64), (second & inside).astype(np.int64)


def _keys(column: pa.Array, min_chars: int):
    """(row of each line, line number in its row, key) of all lines with long enough keys."""
    lists = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), "\n")
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=SPACE))
    starts = np.searchsorted(row, np.arange(len(column)))
    number = np.arange(row.size) - starts[row]
    long_enough = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    return row[long_enough], number[long_enough], keys.filter(pa.array(long_enough))


def _hashes(keys: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k) for k in keys.cast(pa.large_binary()).to_pylist()), np.uint64, len(keys))


def _pack(positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(positions, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64))


def twice_filter(lines: DataFrame, layout: Layout, min_chars: int) -> DataFrame:
    """(block, bits): the second filter, one row per block that has a bit set."""

    def build(batches):
        seen = []
        for batch in batches:
            for part in slices(batch, "body"):
                row, _, keys = _keys(part.column("body"), min_chars)
                pairs = np.empty(row.size, dtype=[("r", np.int64), ("h", np.uint64)])
                pairs["r"], pairs["h"] = row, _hashes(keys)
                seen.append(np.unique(pairs)["h"])
        if not seen:
            return
        h, times = np.unique(np.concatenate(seen), return_counts=True)
        block, first, second = layout.place(h)
        order = np.argsort(block, kind="stable")
        block, first, second, times = block[order], first[order], second[order], times[order]
        at = np.unique(block, return_index=True)
        for b, lo, hi in zip(at[0], at[1], np.append(at[1][1:], block.size)):
            both = np.concatenate([first[lo:hi], second[lo:hi]])
            again = np.tile(times[lo:hi] > 1, 2)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([int(b)], pa.int64()), "once": pa.array([_pack(np.unique(both))], pa.binary()),
                "twice": pa.array([_pack(np.unique(both[again]))], pa.binary())})

    def merge(batches):
        once = twice = current = None

        def done():
            return pa.RecordBatch.from_pydict({
                "block": pa.array([current], pa.int64()),
                "bits": pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())})

        for batch in batches:
            for b, of_once, of_twice in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice"))):
                if b != current:
                    if current is not None:
                        yield done()
                    current = b
                    once, twice = np.zeros(layout.block_bits, bool), np.zeros(layout.block_bits, bool)
                at = _unpack(of_once)
                twice[at[once[at]]] = True
                once[at] = True
                twice[_unpack(of_twice)] = True
        if current is not None:
            yield done()

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sparse = lines.select("body").mapInArrow(build, "block long, once binary, twice binary")
    return (sparse.repartition(min(parts, layout.blocks), "block").sortWithinPartitions("block")
            .mapInArrow(merge, "block long, bits binary"))


def _suspect_rows(part: pa.RecordBatch, row, number, keys, keep) -> pa.RecordBatch:
    """One record per document row and suspected key, with the numbers of its lines."""
    row, number, keys = row[keep], number[keep], keys.filter(pa.array(keep))
    codes = keys.dictionary_encode()
    pair = row * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(pair, kind="stable")
    starts = np.flatnonzero(np.diff(pair[order], prepend=-1)) if order.size else order
    names = codes.dictionary.take(codes.indices.take(pa.array(order[starts])))
    digest = xxhash.xxh3_128_digest
    return pa.RecordBatch.from_arrays([
        pa.array([digest(k) for k in names.cast(pa.large_binary()).to_pylist()], pa.binary()),
        names.cast(pa.string()),
        part.column("id").take(pa.array(row[order[starts]])),
        part.column("thash").take(pa.array(row[order[starts]])),
        pa.ListArray.from_arrays(pa.array(np.append(starts, order.size), pa.int32()),
                                 pa.array(number[order], pa.int32())),
    ], ["kid", "key", "id", "thash", "at"])


def suspected_lines(lines: DataFrame, filter_: DataFrame, layout: Layout, min_chars: int,
                    broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(kid, key, id, thash, at): per document row, its suspected keys and the numbers of their lines."""
    schema = f"kid binary, key string, id {lines.schema['id'].dataType.simpleString()}, thash long, at array<int>"
    if layout.bits <= broadcast_bits:
        bits = np.zeros(layout.bits // 8, np.uint8)
        for r in filter_.collect():  # no more than `broadcast_bits` in all
            start = r.block * layout.block_bits // 8
            bits[start:start + layout.block_bits // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
        shared = lines.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))

        def probe(batches):
            twice = np.frombuffer(zlib.decompress(shared.value), np.uint8)

            def is_set(position):
                return (twice[position >> 3] >> (7 - (position & 7)).astype(np.uint8)) & 1 == 1

            for batch in batches:
                for part in slices(batch, "body"):
                    row, number, keys = _keys(part.column("body"), min_chars)
                    block, first, second = layout.place(_hashes(keys))
                    base = block * layout.block_bits
                    yield _suspect_rows(part, row, number, keys, is_set(base + first) & is_set(base + second))

        return lines.mapInArrow(probe, schema)
    return _suspected_far(lines, filter_, layout, min_chars, schema)


def _suspected_far(lines, filter_, layout, min_chars, schema) -> DataFrame:
    """The same for a filter too large to broadcast: hashes travel to the filter's blocks, and the
    suspected ones come back to their documents."""
    id_type = lines.schema["id"].dataType.simpleString()

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                row, _, keys = _keys(part.column("body"), min_chars)
                h = _hashes(keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array(layout.place(h)[0]), pa.array(h.view(np.int64)), part.column("id").take(pa.array(row)),
                    part.column("thash").take(pa.array(row))], ["block", "h", "id", "thash"])

    def test(batches):
        twice = current = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            for start, stop in zip(*(lambda c: (np.append(0, c), np.append(c, block.size)))(
                    np.flatnonzero(np.diff(block)) + 1)):
                run = batch.slice(start, stop - start)
                if block[start] != current:  # its bits, if it has any, come first
                    current, data = block[start], run.column("bits")[0].as_py()
                    twice = None if data is None else np.unpackbits(
                        np.frombuffer(zlib.decompress(data), np.uint8)).view(bool)
                    run = run if data is None else run.slice(1)
                if twice is not None and run.num_rows:
                    _, first, second = layout.place(run.column("h").to_numpy().view(np.uint64))
                    yield run.select(["h"]).filter(pa.array(twice[first] & twice[second]))

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = materialise(lines.mapInArrow(emit, f"block long, h long, id {id_type}, thash long"), "line-hashes")
    asked = hashes.select("block", "h").distinct().select("block", "h", F.lit(None).cast("binary").alias("bits"))
    blocks = filter_.select("block", F.lit(0).cast("long").alias("h"), "bits")
    repeated = (asked.unionByName(blocks).repartition(parts, "block")
                .sortWithinPartitions("block", F.col("bits").isNull()).mapInArrow(test, "h long"))
    found = (join_hot(hashes, materialise(repeated.withColumn("hit", F.lit(True)), "line-hits"), "h", "line-hash")
             .where("hit"))
    per_doc = found.groupBy("id", "thash").agg(F.collect_set("h").alias("hs"))
    back = lines.join(per_doc, lines.id.eqNullSafe(per_doc.id) & (lines.thash == per_doc.thash)).select(
        lines.id, lines.thash, "body", "hs")

    def pick(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                row, number, keys = _keys(part.column("body"), min_chars)
                h = _hashes(keys).view(np.int64)
                wanted = part.column("hs").to_pylist()
                keep = np.array([int(x) in w for x, w in zip(h, (set(wanted[r]) for r in row))], dtype=bool)
                yield _suspect_rows(part, row, number, keys, keep)

    return back.mapInArrow(pick, schema)


LINES_OUT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()),
                          T.StructField("n_dropped", T.LongType())])


@F.arrow_udf(LINES_OUT)
def _without_lines(body: pa.Array, dropped: pa.Array) -> pa.Array:
    kept, totals, drops = [], [], []
    for text, out in zip(body.to_pylist(), dropped.to_pylist()):
        lines = (text or "").split("\n")
        gone = set(out or ())
        kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text or "")
        totals.append(len(lines))
        drops.append(len(gone))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(totals, pa.int64()),
                                       pa.array(drops, pa.int64())], ["kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """`docs` with the columns kept_text, n_lines (before dropping) and n_dropped."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).alias("body"))
    n_lines = docs.select(F.sum(F.size(F.split(text_col, "\n")))).first()[0] or 0
    layout = Layout(n_lines)
    filter_ = materialise(twice_filter(lines, layout, min_chars), "line-filter")
    suspects = materialise(suspected_lines(lines, filter_, layout, min_chars, broadcast_bits), "line-suspects")
    confirmed = (suspects.groupBy("key")
                 .agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.min("kid").alias("kid"),
                      F.max(F.col("id").isNull()).alias("unnamed"))
                 .where((F.col("keeper") < F.col("last")) | (F.col("unnamed") & F.col("keeper").isNotNull()))
                 .select("kid", "keeper"))
    held = suspects.select("kid", "id", "thash", "at")
    lost = (join_hot(held, materialise(confirmed, "line-repeats"), "kid", "line")
            .where(F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("keeper"))))
            .groupBy(F.col("id").alias("_llm_id"), F.col("thash").alias("_llm_thash"))
            .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("_llm_at")))
    tagged = docs.withColumn("_llm_key", F.xxhash64(text_col))
    joined = tagged.join(lost, F.col(id_col).eqNullSafe(F.col("_llm_id"))
                         & (F.col("_llm_key") == F.col("_llm_thash")), "left")
    done = joined.withColumn("_llm_out", _without_lines(F.col(text_col), F.col("_llm_at")))
    rest = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    return done.select(*rest, F.col("_llm_out.kept").alias("kept_text"), F.col("_llm_out.n_lines").alias("n_lines"),
                       F.col("_llm_out.n_dropped").alias("n_dropped"))
