"""Phrase mining, periodic runs and best-fit packing against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
from conftest import SF_SMALL
from marquee.llm import bestfit, collocations, periods

BYTES = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("id", "body", "lang2", "phrase", "n", "f", "t", "shard", "number", "first", "runs", "collapsed_text", "piece")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})


# -- phrases ---------------------------------------------------------------------------------------

def plain_phrases(rows, k, min_count, overlap):
    """(lang, rank, phrase, a, l, r, n, score) straight from the definition."""
    count, total, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                count[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in found.items():
            if any(100 * b >= overlap * a and p in (q[:2], q[1:]) for q, b in found.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]])
                                        for c in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:k]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def random_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "éa", "Ab", "x\x00y"]
    fixed = [rng.choices(words, k=3) for _ in range(12)]
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += " ".join(rng.choice(fixed) if rng.random() < .4 else rng.choices(words, k=rng.randint(1, 4)))
            text += rng.choice([" ", " ", "\t", ". ", "\n", ",", " ;", "?!"])
        yield rng.choice(["en", "en", "en", "de", None, "und", "a\tb"]), text


@pytest.mark.parametrize("k, growth", [(5, (1, 2)), (40, (1,)), (2000, (2,))])
def test_phrases_equal_the_plain_version(spark, monkeypatch, k, growth):
    monkeypatch.setattr(collocations, "GROWTH", growth)  # thresholds so low that several rounds are needed
    rows = [*random_texts(k, 300), ("en", None), (None, None), ("en", "w1 w2 " * 20_000)]
    docs = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    got = sorted(tuple(r) for r in collocations.mine_phrases(docs, k=k, min_count=4).collect())
    assert got == plain_phrases(rows, k, 4, collocations.OVERLAP)


def test_expanding_less_loses_nothing(spark):
    """The bound of every pair is at least the score of each triple that begins with it."""
    lines = spark.createDataFrame([*random_texts(9, 300)], "lang string, body string").na.fill("und", ["lang"])
    words = collocations.count_words(lines, 3)
    pairs = collocations.count_pairs(lines, words, 3)
    nodes = collocations.scored_pairs(pairs, words).cache()
    triples = collocations.scored_triples(collocations.count_triples(lines, pairs, pairs, 3), words, pairs)
    heads = triples.select("lang", F.substring_index("phrase", " ", 2).alias("phrase"), F.col("score").alias("s"))
    joined = heads.join(nodes, ["lang", "phrase"], "left")
    assert joined.count() > 100
    assert joined.where("bound is null or s > bound").isEmpty()


def test_a_scored_product_beyond_64_bits_is_exact(spark):
    row = spark.createDataFrame([(4_000_000_007, 4_000_000_009, 4_000_000_011)], "a long, l long, r long")
    got = row.select(collocations._score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * 4_000_000_007**2 // (4_000_000_009 * 4_000_000_011)


# -- runs ------------------------------------------------------------------------------------------

def plain_runs(words, min_length=periods.MIN_LENGTH):
    """(start, end, period) of all runs, by testing each period."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_length, 2 * q):
                best.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, kind = rng.randint(0, 80), rng.random()
    if kind < .3:
        return [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(n)]
    if kind < .6:
        out = []
        while len(out) < n:
            unit = [rng.randint(0, 1) for _ in range(rng.randint(1, 9))]
            out += [unit[i % len(unit)] for i in range(rng.randint(len(unit), 30))]
        return out
    if kind < .8:
        a, b = [0], [0, 1]
        while len(b) < n + 2:
            a, b = b, b + a
        return b
    root = [rng.randint(0, 1) for _ in range(rng.randint(1, 4))]  # runs between stretches of one period
    cycle = lambda lo, hi: [root[i % len(root)] for i in range(lo, hi)]
    return cycle(-rng.randint(0, 9), 0) + cycle(0, rng.randint(8, 25)) * rng.randint(2, 4) + cycle(0, rng.randint(0, 9))


def test_runs_equal_the_plain_version():
    rng = random.Random(3)
    for _ in range(600):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
        begins = np.cumsum([0] + [len(t) for t in texts])
        items = np.array([w for t in texts for w in t], np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(begins))
        got = sorted(zip(*(x.tolist() for x in periods.find_runs(items, text))))
        assert got == sorted((s + b, e + b, q) for t, b in zip(texts, begins.tolist()) for s, e, q in plain_runs(t))


def test_a_long_constant_text_is_one_run():
    items = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in periods.find_runs(items, items)] == [[0], [200_000], [1]]


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = periods.RangeSuccessor(values)
    lo = rng.integers(0, 299, 500)
    hi = lo + 1 + rng.integers(0, 300 - lo)
    x = values[rng.integers(lo, hi)]
    wanted = [min((v for v in values[a:b] if v > c), default=-1) for a, b, c in zip(lo, hi, x)]
    assert tree.after(lo, hi, x).tolist() == wanted


def test_run_query_equals_the_plain_version(spark):
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = brute.WORD.findall(d.text or "")
        if len(words) > 2500:  # the plain version is quadratic; longer texts: test_run_edges
            continue
        h = zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        row = got[d.doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == _sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs))
        assert row.collapsed_sha256 == _sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        assert (row.start, row.length, row.period, row.exponent_milli) == (
            (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_run_edges(spark):
    unit = " ".join(f"u{i}" for i in range(5000))
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, f"head {unit} {unit} {unit} tail", "É " * 30, "É " * 30]
    docs = clashing(spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts)],
                                          "doc_id long, text string"))
    got = periods.periodic_runs(docs).collect()
    found = sorted((tuple(map(tuple, r.runs)), len(r.collapsed_text.split())) for r in got)
    assert found == sorted([((), 0)] * 3 + [((), 11), (((0, 12, 1),), 1), (((1, 15_000, 5000),), 5002)]
                           + [(((0, 30, 1),), 1)] * 2)
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    nulls = periods.with_planted_periods(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert sorted(r.text or "" for r in nulls) == sorted(t or "" for t in texts)


# -- packing ---------------------------------------------------------------------------------------

def test_byte_ids_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    encoder = bestfit.ByteEncoder(open(BYTES, encoding="utf-8").read())
    rng = random.Random(5)
    parts = ["a", "B", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "\r\n", "é", "É", "日本", "😀", "0", "12", "!", "...",
             "<|endoftext|>", "<|endoftext", " ", " ", "̀", "ß", "\x00", "ſ", "‍", "x'"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_open_bins_follow_the_rule():
    """The fullest bin that takes the piece; where none does, a new one, and the fullest closes at the limit."""
    rng = random.Random(2)
    for limit in (1, 3, 50):
        bins, free, closed = bestfit.OpenBins(40, limit), {}, set()
        for _ in range(500):
            n = rng.randint(1, 40)
            number, offset = bins.place(n)
            fits = [f for b, f in free.items() if f >= n]
            if fits:
                assert free[number] == min(fits)
            else:
                assert number not in free and number not in closed
                if len(free) == limit:
                    gone = min(free.values())
                    closed.add(next(b for b in reversed(list(free)) if free[b] == gone))
                    free = {b: f for b, f in free.items() if b not in closed}
                free[number] = 40
            assert offset == 40 - free[number]
            free[number] -= n
            if not free[number]:
                del free[number]
            open_now = {b for x in bins.free for b in x}
            assert len(open_now) == len(free) <= limit and sorted(free.values()) == sorted(
                f for f, x in enumerate(bins.free) for _ in x)
            free = {b: f for f, x in enumerate(bins.free) for b in x}


def check_pieces(rows, texts, capacity):
    """`rows` are exactly the pieces of `texts` (id -> text), packed without gap or overlap."""
    library = Tokenizer.from_file(BYTES)
    by_id, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by_id.keys() == texts.keys()
    for i, pieces in by_id.items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == capacity for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for members in sequences.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == [sum(m.length for m in members[:k]) for k in range(len(members))]
        assert sum(r.length for r in members) <= capacity
    return len(sequences)


def test_packing_query(spark):
    rows = entry.queries()["op13_best_fit"](spark, SF_SMALL).collect()
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sequences = check_pieces(rows, texts, 1024)
    assert sequences <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_packing_edges(spark):
    texts = {0: None, 1: "", 2: "a" * 30_000, 3: "a b", 4: "a b", 5: "word " * 63, 6: "word " * 64, 7: "É 日本 " * 999}
    docs = clashing(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    for shard_rows, open_bins in ((1 << 15, 1 << 14), (2, 1)):
        check_pieces(bestfit.best_fit(docs, BYTES, capacity=64, shard_rows=shard_rows, open_bins=open_bins).collect(),
                     texts, 64)
    assert bestfit.best_fit(docs.limit(0), BYTES).count() == 0
    copies = bestfit.best_fit(docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long")), BYTES).collect()
    single = bestfit.best_fit(docs, BYTES).collect()
    assert sorted(2 * [r.ids_crc32 for r in single]) == sorted(r.ids_crc32 for r in copies)
    places = [(r.sequence_id, r.offset) for r in copies]
    assert len(set(places)) == len(places)
