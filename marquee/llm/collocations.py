"""Phrase collocation mining: the best phrases of two and three words of each language, by best-first growth.

Texts are lower-cased (A-Z) and cut at `[.,;:!?\\x0A-\\x0D]` into pieces, pieces into words `[^\\x20\\x09]+`.
f(p) counts all contiguous occurrences of p within pieces, n all words. A candidate has a = f >= `min_count`.
Cut after its first words it scores floor(SCALE * a * a / (l * r)), l and r being the counts of both parts; the
cut of lowest score counts, ties to the first. A candidate is dropped if a longer candidate holds it and has
at least `overlap` percent of its count. The first `k` survivors of each language are returned.

1. One pass counts words, one counts pairs of words that both reach `min_count` (no other pair can). A bit
   array of at most `FILTER_BITS` tells a task which words do; where it errs it lets more through.
2. Growth by best-first branch and bound. The frontier is the pairs "x y" with a count; a third word makes
   triples. With m = min(f(x y), highest f(y z)), no triple from "x y" has a count above m, so none scores
   above SCALE * m / f(x). In each round the best part of the frontier is expanded at once, language by
   language: down to the score t that `GROWTH` * k pairs reach (more in later rounds). One pass counts the
   triples that begin with an expanded pair, or that hold a pair of score t or more (these decide whether the
   pair survives). Everything of score t or more is then known: a language with k survivors there is settled,
   ties included, and is left out of later rounds; the others go on with a lower t, at last with t = 0.

Scores are integers up to SCALE, so the thresholds come from one histogram per language; counts are multiplied
as decimals of 38 digits. Hot words are joined by `join_hot`; every window holds a bounded number of rows.

Edge cases: a null text is empty; a null language is `und`; a language with fewer than k survivors returns all;
repeated rows count each time; ids are not used; very long texts are read whole; an empty table gives no rows;
other input columns are not kept, so clashing names do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise, raw_texts, slices

K = 2000
MIN_COUNT = 10
OVERLAP = 50
SCALE = 1_000_000
NO_LANG = "und"
GROWTH = (2, 8, 64, 1024)    # thresholds of the rounds, in multiples of k; after them everything is expanded
FILTER_BITS = 1 << 28
BLOCK = 1 << 20
SLICE = 4 << 20
SALTS = 64
PRIME = np.uint64(0x9E3779B97F4A7C15)

# Characters that end a piece, and letters that are lower-cased.
BREAKS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
CLEAN = bytes.maketrans(UPPER + BREAKS, LOWER + b"\n" * len(BREAKS))


def _hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\t" + word)


def _pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * PRIME + y
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts of one language: distinct words, their numbers and pieces in order."""

    def __init__(self, texts: pa.Array):
        clean = b"\n".join(raw_texts(texts)).translate(CLEAN)
        found = pa.array(clean.split(), pa.binary()).dictionary_encode()
        self.distinct = found.dictionary
        self.code = found.indices.to_numpy().astype(np.int64)
        raw = np.frombuffer(clean, np.uint8)
        cut = raw == 10
        blank = cut | (raw == 32) | (raw == 9)
        first = ~blank
        first[1:] &= blank[:-1]
        self.piece = np.cumsum(cut)[first]

    def grams(self, words: int) -> np.ndarray:
        """Where `words` words of one piece begin."""
        last = words - 1
        return np.flatnonzero(self.piece[last:] == self.piece[:self.piece.size - last])

    def hashes(self, lang: bytes) -> np.ndarray:
        return np.fromiter((_hash(lang, w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))

    def rows(self, lang: str, at: np.ndarray, words: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the phrases of `words` words that begin at `at`."""
        key, size = self.code[at], max(1, len(self.distinct))
        for j in range(1, words):
            if j > 1:  # keeps the combined number below 2^63
                heads, key = np.unique(key, return_inverse=True)
            key = key * size + self.code[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        parts = [self.distinct.take(pa.array(self.code[at[first] + j])) for j in range(words)]
        phrase = parts[0] if words == 1 else pc.binary_join_element_wise(*parts, b" ")
        return pa.RecordBatch.from_arrays([pa.array([lang] * n.size, pa.string()), phrase.cast(pa.string()),
                                           pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _by_language(batches):
    """(language, Words) of bounded slices of a task's texts."""
    for batch in batches:
        for part in slices(batch, "body", SLICE):
            langs = part.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, Words(part.column("body").filter(pa.array(code == i)))


def _counted(lines: DataFrame, emit, min_count: int) -> DataFrame:
    return (lines.mapInArrow(emit, "lang string, phrase string, n long").groupBy("lang", "phrase")
            .agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))


def count_words(lines: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f) of frequent words; the empty phrase counts all words of a language."""

    def emit(batches):
        for lang, words in _by_language(batches):
            if words.code.size:
                yield words.rows(lang, np.arange(words.code.size), 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([words.code.size])],
                                                 ["lang", "phrase", "n"])

    return _counted(lines, emit, min_count)


class Membership:
    """A broadcast bit array over hashes of phrases: never says no to a phrase of `phrases`."""

    def __init__(self, phrases: DataFrame, name: str):
        spark = phrases.sparkSession
        self.bits = bits = min(FILTER_BITS, max(BLOCK, 1 << (16 * phrases.count()).bit_length()))

        def place(batches):
            for batch in batches:
                at = [_phrase_hash(lang.encode(), phrase.encode()) & (bits - 1)
                      for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                at = np.unique(np.array(at, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK)], ["block", "at"])

        def build(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                block, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
                for b in np.unique(block).tolist():
                    held.setdefault(b, np.zeros(BLOCK, bool))[at[block == b]] = True
            for b, part in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array(
                    [zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())], ["block", "bits"])

        rows = (phrases.select("lang", "phrase").mapInArrow(place, "block long, at long")
                .repartition(bits // BLOCK, "block").mapInArrow(build, "block long, bits binary"))
        array = np.zeros(bits // 8, np.uint8)
        for r in rows.collect():  # FILTER_BITS bits at most
            array[r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
        self.shared = spark.sparkContext.broadcast(zlib.compress(array.tobytes(), 1))
        self.array = None

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared, "array": None}

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.array is None:
            self.array = np.frombuffer(zlib.decompress(self.shared.value), np.uint8)
        at = (h & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.array[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _phrase_hash(lang: bytes, phrase: bytes) -> int:
    """Hash of a word or of a pair."""
    words = phrase.split(b" ")
    h = np.array([_hash(lang, w) for w in words], np.uint64)
    return int(h[0]) if len(words) == 1 else int(_pair_hash(h[:1], h[1:])[0])


def count_pairs(lines: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f) of frequent pairs."""
    frequent = Membership(words, "words")

    def emit(batches):
        for lang, found in _by_language(batches):
            at = found.grams(2)
            if at.size:
                good = frequent.has(found.hashes(lang.encode()))[found.code]
                yield found.rows(lang, at[good[at] & good[at + 1]], 2)

    return _counted(lines, emit, min_count)


def count_triples(lines: DataFrame, heads: DataFrame, tails: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f) of the frequent triples that begin with a pair of `heads` or end with one of `tails`."""
    begins, ends = Membership(heads, "heads"), Membership(tails, "tails")

    def emit(batches):
        for lang, found in _by_language(batches):
            at = found.grams(3)
            if at.size:
                h = found.hashes(lang.encode())[found.code]
                wanted = begins.has(_pair_hash(h[at], h[at + 1])) | ends.has(_pair_hash(h[at + 1], h[at + 2]))
                if wanted.any():
                    yield found.rows(lang, at[wanted], 3)

    return _counted(lines, emit, min_count)


def _key(phrase: Column) -> Column:
    return F.concat("lang", F.lit("\t"), phrase)


def _lookup(rows: DataFrame, parts: list[Column], right: DataFrame, values: list[str], name: str) -> DataFrame:
    """(lang, phrase, a, and v0, v1, ... for each of `values` v): what `right` has for each part of a phrase of
    the written table `rows`. All parts are looked up in one join."""
    long = rows.select("lang", "phrase", "a", F.posexplode(F.array(*[_key(p) for p in parts])).alias("slot", "_key"))
    found = join_hot(long, right.select(_key(F.col("phrase")).alias("_key"), *values), "_key", name)
    return found.groupBy("lang", "phrase", "a").agg(*[
        F.max(F.when(F.col("slot") == i, F.col(v))).alias(f"{v}{i}") for v in values for i in range(len(parts))])


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exact."""
    a, left, right = (f"cast({c} as decimal(15, 0))" for c in (a, left, right))
    return F.expr(f"(cast({SCALE} as decimal(7, 0)) * {a} * {a}) div ({left} * {right})")


def _word(i: int) -> Column:
    return F.get(F.split("phrase", " "), F.lit(i))


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, most, score, bound): pairs with their score; `most` is the highest count of a
    pair that begins with the second word (null: none), `bound` the best score a triple from here can have."""
    follow = pairs.groupBy("lang", _word(0).alias("phrase")).agg(F.max("f").alias("most"))
    known = words.join(follow, ["lang", "phrase"], "left")
    rows = _lookup(pairs.withColumnRenamed("f", "a"), [_word(0), _word(1)], known, ["f", "most"], "pair-words")
    return (rows.select("lang", "phrase", "a", F.col("f0").alias("l"), F.col("f1").alias("r"),
                        F.col("most1").alias("most"))
            .withColumn("score", _score("a", "l", "r"))
            .withColumn("bound", F.expr(f"(cast({SCALE} as decimal(7, 0)) * least(a, most)) div l")))


def scored_triples(triples: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) with the cut of lowest score."""
    parts = [_word(0), _tail(), _head(), _word(2)]
    rows = _lookup(triples.withColumnRenamed("f", "a"), parts, words.unionByName(pairs), ["f"], "triple-parts")
    rows = rows.withColumn("s1", _score("a", "f0", "f1")).withColumn("s2", _score("a", "f2", "f3"))
    early = F.col("s1") <= F.col("s2")
    return rows.select("lang", "phrase", "a", *[F.when(early, F.col(x)).otherwise(F.col(y)).alias(o)
                                                for x, y, o in (("f0", "f2", "l"), ("f1", "f3", "r"), ("s1", "s2", "score"))])


def _head() -> Column:
    return F.substring_index("phrase", " ", 2)


def _tail() -> Column:
    return F.substring_index("phrase", " ", -2)


def thresholds(pairs: DataFrame, rows: int) -> DataFrame:
    """(lang, t): the highest score that at least `rows` pairs reach, 0 if there are fewer. A language's
    histogram has SCALE + 1 cells at most."""
    cells = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return (cells.withColumn("above", above).groupBy("lang")
            .agg(F.coalesce(F.max(F.when(F.col("above") >= rows, F.col("score"))), F.lit(0)).alias("t")))


def best_phrases(rows: DataFrame, k: int) -> DataFrame:
    """The first `k` rows of each language with their rank; salted, so no window holds a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = (rows.withColumn("part", part)
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
           .where(F.col("rank") <= k))
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= k).drop("part"))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", k: int = K,
                 min_count: int = MIN_COUNT, overlap: int = OVERLAP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `k` phrases of each language."""
    lines = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.col(text_col).alias("body"))
    counted = materialise(count_words(lines, min_count), "words")
    totals, words = counted.where("phrase = ''"), counted.where("phrase <> ''")
    pairs = materialise(count_pairs(lines, words, min_count), "pairs")
    nodes = materialise(scored_pairs(pairs, words), "frontier")
    todo = nodes.select("lang").distinct()
    done = None
    for growth in (*GROWTH, None):
        level = thresholds(nodes, growth * k) if growth else todo.select("lang", F.lit(0).alias("t"))
        level = materialise(level.join(todo, "lang", "left_semi"), "thresholds")
        if level.isEmpty():
            break
        best = nodes.join(level, "lang").where("score >= t or bound >= t").select(*nodes.columns, "t")
        best = materialise(best, "expanded")
        high = best.where("score >= t")
        counted = materialise(count_triples(
            lines.join(level, "lang", "left_semi"), best.where("bound >= t or most is not null"), high, min_count),
            "triple-counts")
        triples = materialise(scored_triples(counted, words, pairs), "triples")
        holders = (triples.select("lang", F.explode(F.array(_head(), _tail())).alias("phrase"), "a")
                   .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        alive = high.join(holders, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (100 * F.col("longer") < overlap * F.col("a"))).select(*columns)
        survivors = materialise(alive.unionByName(
            triples.join(level, "lang").where("score >= t").select(*columns)), "survivors")
        enough = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        settled = materialise(level.join(enough, "lang", "left").where(
            (F.col("t") == 0) | (F.col("n") >= k)).select("lang"), "settled")
        rows = best_phrases(survivors.join(settled, "lang", "left_semi"), k)
        done = rows if done is None else done.unionByName(rows)
        todo = materialise(level.select("lang").join(settled, "lang", "left_anti"), "open")
    if done is None:
        done = best_phrases(nodes.select("lang", "phrase", "a", "l", "r", "score"), k)
    return (done.join(totals.select("lang", F.col("f").alias("n")), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
