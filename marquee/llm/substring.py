"""Substring dedup: passages of `window` words that occur more than once, found with FM-indexes.

Words are `[^\\x20\\x09-\\x0D]+`. Every word covered by a window of `window` consecutive words of one
document whose word sequence also starts anywhere else (same document included) is removed; windows are
judged on the input. Kept words are joined by one space.

Routing. A window's anchor is its 8-word gram with the smallest hash (the last of equals), a function of
the window's words alone, so equal windows have equal anchors and meet in one shard. Consecutive windows
with one anchor form a segment (62 words at most). Only segments whose anchor was chosen at two places or
more can hold a repeated window; a bit array of those anchors (`FILTER_BITS` at most; a full array passes
more segments on, never fewer) selects them in the second scan.

Counting. Equal segments collapse, so copies cost one row each in the first step only. A shard holds the
distinct segments of a range of anchors: its FM-index is the Burrows-Wheeler transform of the segments in a
wavelet matrix with packed bits and popcount directories. Segments are streamed through it by backward
search, all windows of a shard at once; a window stops as soon as its matching interval holds one
occurrence, and those whose matching statistic reaches `window` with two occurrences or more are reported
as intervals. A window's occurrences count with the multiplicity of their segment. Anchors with over
`HOT_BYTES` of distinct segments (a passage in very many contexts) would overfill a shard; their windows
are counted by a 128-bit hash of their words instead, pre-aggregated in every task.

Edge cases: a null text has no words and an empty result; texts shorter than a window keep all words;
repeated rows are copies of each other and lose everything a window covers; null and repeated ids are
allowed (rows are matched by id and text); an empty table gives no rows; input columns named like an output
column are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, key_runs, materialise, raw_texts, slices

WINDOW = 35
GRAM = 8
STEP = 1 << 19               # windows handled at once; positions take 20 bits
LOW = np.uint64((1 << 20) - 1)
FILTER_BITS = 1 << 29
BLOCK = 1 << 20
SHARD_BYTES = 16 << 20
SHARD_ROWS = 30_000          # distinct segments per FM-index, about
HOT_BYTES = 4 << 20
PRIME = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segments(h: np.ndarray, doc: np.ndarray, window: int = WINDOW):
    """(first window, last window, anchor) of every segment. `h`: word hashes of several documents one
    after the other, `doc`: number of the document of each word; window i covers words i..i+window-1."""
    spare, grams = window - 1, window - GRAM + 1
    out = []
    for s in range(0, max(h.size - spare, 0), STEP):
        x = h[s:s + STEP + spare]
        g = np.zeros(x.size - GRAM + 1, np.uint64)
        for j in range(GRAM):
            g += x[j:j + g.size] * np.uint64(pow(PRIME, j, 1 << 64))
        g = _mix(g)
        key = (g & ~LOW) | (LOW - np.arange(g.size, dtype=np.uint64))
        width = 1
        while 2 * width <= grams:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < grams:
            key = np.minimum(key[:key.size - (grams - width)], key[grams - width:])
        at = (LOW - (key & LOW)).astype(np.int64)
        n = at.size
        valid = doc[s:s + n] == doc[s + spare:s + spare + n]
        start = valid & np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
        first = np.flatnonzero(start)
        stops = np.append(np.flatnonzero(start | ~valid), n)
        last = stops[np.searchsorted(stops, first, side="right")] - 1
        out.append((first + s, last + s, g[at[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _batch_segments(part: pa.RecordBatch, cache: WordHashes, window: int):
    texts = [t.split() for t in raw_texts(part.column("body"))]
    counts = np.array([len(t) for t in texts], np.int64)
    words = [w for t in texts for w in t]
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), counts)
    return words, doc, np.cumsum(counts) - counts, segments(h, doc, window)


class FMIndex:
    """FM-index of a sequence of symbols >= 1 cut by 0, searched backwards for many patterns at once.

    Suffixes are sorted by their first `depth` symbols, which is all that patterns up to `depth` - 1 long
    can tell apart."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        n = text.size
        rank, k = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while k < depth:
            key = rank * (n + 1) + np.roll(rank, -k)
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            k *= 2
        sigma = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))  # smaller symbols
        self.weights = np.concatenate(([0], np.cumsum(weight[order])))
        bwt = text[order - 1].astype(np.int64)
        self.levels, symbols = [], np.arange(sigma)
        start = np.zeros(sigma, np.int64)
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (bwt >> bit) & 1
            packed = np.packbits(np.append(ones.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)),
                                 bitorder="little").view(np.uint64)
            level = (bit, packed, np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))),
                     int(n - ones.sum()))
            self.levels.append(level)
            start = self._down(level, symbols, start)
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        self.start = start

    @staticmethod
    def _down(level, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        bit, packed, ranks, zeros = level
        word = i >> 6
        inside = packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        ones = ranks[word] + np.bitwise_count(inside)
        return np.where((symbol >> bit) & 1, zeros + ones, i - ones)

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Interval border after one more symbol to the left: smaller symbols, plus this symbol's rank."""
        at = i
        for level in self.levels:
            at = self._down(level, symbol, at)
        return self.before[symbol] + at - self.start[symbol]

    def occurrences(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Weighted occurrences of text[s:s+length] for each start s, counted up to 1 exactly: a search
        stops early once a suffix of the pattern is left with a single occurrence."""
        found = np.ones(starts.size, np.int64)
        live = np.arange(starts.size)
        last = text[starts + length - 1]
        lo, hi = self.before[last], self.before[last + 1]
        for j in range(length - 2, -1, -1):
            symbol = text[starts[live] + j]
            lo, hi = self.step(symbol, lo), self.step(symbol, hi)
            more = self.weights[hi] - self.weights[lo] > 1
            live, lo, hi = live[more], lo[more], hi[more]
            if not live.size:
                return found
        found[live] = self.weights[hi] - self.weights[lo]
        return found


def _spans(starts: np.ndarray, window: int) -> list[int]:
    """Flat [from, to, from, to ...] of the words covered by windows at the sorted `starts`."""
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.column_stack([starts[np.append(0, cut + 1)], starts[np.append(cut, starts.size - 1)] + window]
                           ).ravel().tolist()


def _shard_spans(run: pa.Table, window: int) -> pa.RecordBatch:
    """(sid, spans) of the repeated windows among the distinct segments of a shard."""
    texts = [t.split(b" ") for t in raw_texts(run.column("seg").combine_chunks())]
    n = run.column("n").to_numpy()
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(text.size, bool)
    inside[ends - 1] = False
    text[inside] = flat.indices.to_numpy() + 1
    index = FMIndex(text, np.repeat(n, sizes + 1), 2 * window)
    wins = sizes - window + 1
    single = n == 1
    owner = np.repeat(np.flatnonzero(single), wins[single])
    starts = begins[owner] + np.arange(owner.size) - np.repeat(np.cumsum(wins[single]) - wins[single], wins[single])
    hit = index.occurrences(text, starts, window) > 1
    owner, starts = owner[hit], starts[hit]
    found = np.split(starts, np.flatnonzero(np.diff(owner)) + 1) if owner.size else []
    who = owner[np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))] if owner.size else owner
    whole = np.flatnonzero(~single)
    spans = [_spans(s - begins[k], window) for k, s in zip(who, found)] + [[0, int(sizes[k])] for k in whole]
    sids = run.column("sid").combine_chunks().take(pa.array(np.concatenate([who, whole])))
    return pa.RecordBatch.from_arrays([sids, pa.array(spans, pa.list_(pa.int32()))], ["sid", "spans"])


def _anchor_filter(lines: DataFrame, window: int):
    """Broadcast bit array of the anchors chosen at two places or more, and its number of bits."""

    def count(batches):
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                anchors, n = np.unique(_batch_segments(part, cache, window)[3][2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 ["anchor", "n"])

    repeated = materialise(lines.select("body").mapInArrow(count, "anchor long, n long").groupBy("anchor")
                           .agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    bits = min(FILTER_BITS, max(BLOCK, 1 << (16 * repeated.count()).bit_length()))

    def build(batches):
        held = [np.zeros(0, np.int64)]
        for batch in batches:
            held.append(batch.column("at").to_numpy())
        at = np.sort(np.concatenate(held))
        blocks, starts = np.unique(at // BLOCK, return_index=True)
        for b, part in zip(blocks, np.split(at % BLOCK, starts[1:])):
            block = np.zeros(BLOCK, bool)
            block[part] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array(
                [zlib.compress(np.packbits(block).tobytes(), 1)], pa.binary())], ["block", "bits"])

    at = F.pmod(F.col("anchor"), F.lit(bits)).alias("at")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (repeated.select(at).withColumn("block", (F.col("at") / BLOCK).cast("long"))
            .repartition(min(parts, bits // BLOCK), "block").select("at").mapInArrow(build, "block long, bits binary"))
    array = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # FILTER_BITS bits at most
        array[r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return lines.sparkSession.sparkContext.broadcast(zlib.compress(array.tobytes(), 1)), bits


def _occurrences(lines: DataFrame, window: int) -> DataFrame:
    """(sid, anchor, seg, id, thash, at) for the segments with a repeated anchor: seg is the text, null
    where the task has sent it before; at is the segment's first word."""
    shared, bits = _anchor_filter(lines, window)

    def emit(batches):
        cache, seen = WordHashes(), set()
        wanted = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "body"):
                words, doc, begins, (first, last, anchor) = _batch_segments(part, cache, window)
                at = (anchor & np.uint64(bits - 1)).astype(np.int64)
                keep = (wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                first, last, anchor = first[keep], last[keep], anchor[keep]
                texts = [b" ".join(words[a:b]) for a, b in zip(first.tolist(), (last + window).tolist())]
                sids = [digest(t) for t in texts]
                if len(seen) > 200_000:
                    seen.clear()
                for k, sid in enumerate(sids):
                    if sid in seen:
                        texts[k] = None
                    else:
                        seen.add(sid)
                row = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays([
                    pa.array(sids, pa.binary()), pa.array(anchor.view(np.int64)),
                    pa.array(texts, pa.binary()).cast(pa.string()), part.column("id").take(row),
                    part.column("thash").take(row), pa.array((first - begins[doc[first]]).astype(np.int32))],
                    ["sid", "anchor", "seg", "id", "thash", "at"])

    id_type = lines.schema["id"].dataType.simpleString()
    return lines.mapInArrow(emit, f"sid binary, anchor long, seg string, id {id_type}, thash long, at int")


def _hot_spans(hot: DataFrame, window: int) -> DataFrame:
    """(sid, spans) for segments of overfull anchors, by counting window hashes."""

    def windows(batches):
        for batch in batches:
            for part in slices(batch, "seg", 256 << 10):
                sid, at, wid, n = [], [], [], []
                for s, t, k in zip(part.column("sid").to_pylist(), raw_texts(part.column("seg")),
                                   part.column("n").to_pylist()):
                    words = t.split(b" ")
                    for i in range(len(words) - window + 1):
                        sid.append(s)
                        at.append(i)
                        wid.append(xxhash.xxh3_128_digest(b" ".join(words[i:i + window])))
                        n.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(at, pa.int32()),
                                                  pa.array(wid, pa.binary()), pa.array(n, pa.int64())],
                                                 ["sid", "at", "wid", "n"])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def spans(starts: pa.Array) -> pa.Array:
        return pa.array([_spans(np.sort(np.array(s)), window) for s in starts.to_pylist()], pa.list_(pa.int32()))

    rows = materialise(hot.mapInArrow(windows, "sid binary, at int, wid binary, n long"), "hot-windows")
    again = materialise(rows.groupBy("wid").agg(F.sum("n").alias("n")).where("n > 1")
                        .select("wid", F.lit(True).alias("again")), "hot-repeats")
    return (join_hot(rows.select("sid", "at", "wid"), again, "wid", "hot-window").where("again")
            .groupBy("sid").agg(spans(F.collect_list("at")).alias("spans")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """(id, thash, spans): per document (id and text hash) the flat [from, to) word ranges to remove;
    ranges may overlap."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).alias("body"))
    found = materialise(_occurrences(lines, window), "segments")
    distinct = materialise(found.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.max("seg").alias("seg"),
                                                    F.min("anchor").alias("anchor")), "distinct-segments")
    sizes = distinct.groupBy("anchor").agg(F.sum(F.octet_length("seg")).alias("bytes"))
    hot = materialise(sizes.where(F.col("bytes") > HOT_BYTES).select("anchor"), "hot-anchors")
    total = distinct.agg(F.sum(F.octet_length("seg"))).first()[0] or 0

    def search(batches):
        for run in key_runs(batches, ["anchor"], min_rows=SHARD_ROWS):
            yield _shard_spans(run, window)

    normal = distinct.join(hot, "anchor", "left_anti") if not hot.isEmpty() else distinct
    indexed = (normal.repartition(max(8, total // SHARD_BYTES), "anchor").sortWithinPartitions("anchor")
               .mapInArrow(search, "sid binary, spans array<int>"))
    if not hot.isEmpty():
        indexed = indexed.unionByName(_hot_spans(distinct.join(hot, "anchor", "left_semi"), window))
    spans = materialise(indexed, "segment-spans")
    moved = F.transform("spans", lambda x: x + F.col("at"))
    return (join_hot(found.select("sid", "id", "thash", "at"), spans, "sid", "segment").where("spans is not null")
            .groupBy("id", "thash").agg(F.flatten(F.collect_list(moved)).alias("spans")))


WORDS_OUT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()),
                          T.StructField("n_removed", T.LongType())])


@F.arrow_udf(WORDS_OUT)
def _without_words(body: pa.Array, spans: pa.Array) -> pa.Array:
    kept, totals, removed = [], [], []
    for text, out in zip(raw_texts(body), spans.to_pylist()):
        words = text.split()
        totals.append(len(words))
        if out:
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, np.array(out[0::2]), 1)
            np.add.at(edges, np.array(out[1::2]), -1)
            stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
            removed.append(len(words) - len(stay))
            words = [words[i] for i in stay]
        else:
            removed.append(0)
        kept.append(b" ".join(words))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()),
                                       pa.array(removed, pa.int64())], ["kept", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """`docs` with the columns kept_text, n_words and n_removed."""
    spans = repeated_spans(docs, id_col, text_col, window).select(
        F.col("id").alias("_llm_id"), F.col("thash").alias("_llm_thash"), F.col("spans").alias("_llm_spans"))
    tagged = docs.withColumn("_llm_key", F.xxhash64(text_col))
    joined = tagged.join(spans, F.col(id_col).eqNullSafe(F.col("_llm_id"))
                         & (F.col("_llm_key") == F.col("_llm_thash")), "left")
    done = joined.withColumn("_llm_out", _without_words(F.col(text_col), F.col("_llm_spans")))
    rest = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    return done.select(*rest, F.col("_llm_out.kept").alias("kept_text"), F.col("_llm_out.n_words").alias("n_words"),
                       F.col("_llm_out.n_removed").alias("n_removed"))
