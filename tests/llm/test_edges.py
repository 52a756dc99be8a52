"""Every operator on nulls, empty, long and repeated texts, clashing columns, and empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from marquee.llm import bpe, brown, lines, packing, pivots, quality, simhash, substring, urls, wrapper

LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(60))
TEXTS = [None, "", " \t\r\n", "One line that is long\nOne line that is long\nshort", "one LINE that is long  \nshort",
         SHARED, "head " + SHARED + " tail", "a b c", "A B C", LONG, LONG, "x " * 100, "Ünï " * 30]
ROWS = [(i, t, i % 3) for i, t in enumerate(TEXTS)]
CLASH = ("id", "key", "body", "thash", "fp", "bucket", "batch", "host", "kept", "kept_text", "n_words", "ids", "word",
         "n", "label", "node", "vkey", "rule")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang int").repartition(3)
    return plain.withColumns({c: F.lit(c) for c in CLASH}).cache()


def without(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_lines(spark, docs):
    wanted = brute.lines([(i, t) for i, t, _ in ROWS])
    for bits in (1 << 29, 0):  # the second: the way for filters too large to broadcast
        got = lines.dedup_lines(docs, broadcast_bits=bits).collect()
        assert without(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(wanted, key=str)
    again = lines.dedup_lines(docs.unionByName(docs)).collect()  # repeated rows are one document
    assert without(again, "doc_id", "kept_text") == sorted([(w[0], w[3]) for w in wanted] * 2, key=str)
    nulls = lines.dedup_lines(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nulls) == len(ROWS) and all(r.n_dropped == 0 for r in nulls)


def test_substrings(spark, docs, monkeypatch):
    wanted = brute.substrings([(i, t) for i, t, _ in ROWS])
    got = substring.dedup_substrings(docs).collect()
    assert without(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(wanted, key=str)
    monkeypatch.setattr(substring, "HOT_BYTES", 0)  # every anchor is overfull
    got = substring.dedup_substrings(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert without(got, "n_words", "n_removed") == sorted([w[1:3] for w in wanted], key=str)


def test_simhash(spark, docs):
    fps = [brute.fingerprint(t) for t in TEXTS]
    root = brute.components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = simhash.simhash_components(docs).collect()
    assert without(got, "doc_id", "fingerprint", "component_id") == sorted(
        [(i, f"{fps[i]:016x}", root[i]) for i in range(len(fps))], key=str)
    kept = simhash.keep_first_of_group(docs.unionByName(docs)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))
    assert kept[0].asDict().keys() == set(docs.columns)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (7, 0, 0), (8, 0, 1), (9, 1, 0), (11, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = {r.doc_id: r for r in quality.quality_rules(docs, known).collect()}
        assert len(got) == len(ROWS)
        for i, t, _ in ROWS:
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == \
                brute.base_counts(t)
            assert not (r.kept and r.base_failed)
        if known is not labels:
            assert all(r.kept != r.base_failed for r in got.values())


def test_packing(spark, docs):
    got = packing.pack(docs, n_buckets=3, token_budget=200, shard_rows=4).collect()
    assert without(got, "doc_id", "n_tokens") == sorted([(i, len(brute.WORD.findall(t or ""))) for i, t, _ in ROWS], key=str)
    assert len({(r.bucket, r.shard, r.batch, r.slot) for r in got}) == len(got)
    for r in got:
        assert r.n_tokens <= r.padded_len and (r.slot == 0 or (r.slot + 1) * r.padded_len <= 200)
    assert len({r.bucket for r in got}) == 3


def test_brown(spark, docs):
    got = brown.brown_scores(docs).collect()
    assert len(got) == len(ROWS)
    train = [r for r in got if not r.held_out]
    assert all(r.train_tokens == sum(x.n_tokens for x in train) for r in got)
    for r in got:
        assert math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0
        assert r.n_tokens == len(brute.WORD.findall(TEXTS[r.doc_id] or "")) + 1 and 1 <= r.n_known <= r.n_tokens
    assert all(r.n_known == r.n_tokens for r in train)


def test_bpe(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert {r.doc_id: r.ids for r in got}[0] == [] and {r.doc_id: r.decoded for r in got}[7] == "a</w> b</w> c</w>"
    odd = spark.createDataFrame([(None,), ([],), ([64, -1, 10**8],)], "ids array<int>")
    assert all(r.decoded is not None for r in bpe.decode(odd, path).collect())


def test_urls(spark, docs):
    some = ["http://A.example.NET/en/1", "https://x.net/", "https://net/x", "http://example.net/en", "http://y.org/fr/z?q",
            "http://w.com/de/", "http://www.example.com/de/?a#b", "ftp://z.io", "no scheme", "", None, "http://x.net?y",
            "http://x.net/en/", "http://notexample.com/de/"] * 2
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(some)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.url_filter(pages).collect()}
    rules = ["example.net/en/", "net/", "net/", "net/", "org/fr/", None, "example.com/de/", *[None] * 5, "net/", None]
    assert [got[i].rule for i in range(len(some))] == rules * 2
    assert got[0].host == "a.example.net" and got[0].path == "/en/1" and got[4].path == "/fr/z" and got[11].path == ""
    assert all(r.verdict == {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow", "example.com/de/": "block"}
               .get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in got.values())
    assert {r.verdict for r in urls.url_filter(pages.where("page_id = 5")).collect()} == {"allow"}


def test_pages(spark, docs):
    page = "<body><div class=x><p>Story {0} text {0}</p></div><div><p>Imprint of the house</p></div></body>"
    rows = [(i, f"http://h{i % 2}.io/{i}", page.format(i), "t") for i in range(26)]
    rows += [(120, None, None, "t"), (121, "x", "", "t"), (122, "http://h1.io/q", "<p>" + "long " * 50_000, "t"), (2, rows[2][1], rows[2][2], "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in wrapper.extract(pages).collect()]
    wanted = [(i, f"Story {i} text {i}") for i in range(26)] + [(120, ""), (121, ""), (122, "long " * 49_999 + "long"), (2, "Story 2 text 2")]
    assert sorted(got) == sorted(wanted)


def test_embeddings(spark, docs):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.01], [2.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [nan, 1.0], [inf, 1.0],
               [None, 1.0], [1.0, 0.0, 0.0], [], [-1.0, 0.0], [1e-30, 0.0], [1.0, 0.18], [1.0, 0.25]]
    rows = [(i, v, 1, "n") for i, v in enumerate(vectors)] + [(90, [1.0, 0.0], None, "n"), (91, [1.0, 0.0], 2, "n")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in pivots.embedding_components(frame).collect()}
    ok = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)

    def linked(a, b):
        (_, x, k, _), (_, y, m, _) = a, b
        if k is None or k != m or not ok(x) or not ok(y) or len(x) != len(y):
            return False
        return sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y) >= 0.98

    root = brute.components(len(rows), lambda i, j: linked(rows[i], rows[j]))
    for i, row in enumerate(rows):
        r = got[row[0]]
        assert r.n_links == sum(linked(row, o) for o in rows if o is not row), row
        assert r.component_id == rows[root[i]][0] and r.kept == (r.component_id == r.vec_id)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (lines.dedup_lines(none), substring.dedup_substrings(none), simhash.simhash_components(none),
                   simhash.keep_first_of_group(none), quality.quality_rules(none, labels), packing.pack(none),
                   brown.brown_scores(none), urls.url_filter(pages), wrapper.extract(pages),
                   pivots.embedding_components(vectors)):
        assert result.count() == 0


def test_digests_are_what_the_contract_says(spark):
    assert spark.range(1).select(F.sha2(F.lit("é"), 256).alias("h")).first().h == hashlib.sha256("é".encode()).hexdigest()


def test_brown_classes_words_beyond_the_local_table(spark, monkeypatch):
    half = 66_000  # words of one text each, more than the table of frequent words holds; a few are frequent
    rows = [(i, " ".join(f"the n{k:06d} runs . we v{k:06d} it . the n{k % 20}x runs . we v{k % 20}x it ."
                         for k in range(i * 100, i * 100 + 100))) for i in range(half // 100)]
    frame = spark.createDataFrame(rows, "id long, body string").withColumn("held_out", F.lit(False)).repartition(8)
    model, lexicon = brown.fit(frame)
    kinds = lexicon.groupBy(F.substring("word", 1, 1).alias("kind")).agg(
        F.collect_set("c").alias("c"), F.count("c").alias("n")).collect()
    of = {r.kind: set(r.c) for r in kinds}
    assert sum(r.n for r in kinds) == 2 * half + 45 - len(model.words) > 100_000
    assert not of["n"] & of["v"] and len(of["n"]) == len(of["v"]) == 1
    got = brown.score(frame, model, lexicon).collect()
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
    # The number of blocks changes nothing.
    monkeypatch.setattr(brown, "NEAR_TOKENS", 1 << 16)
    monkeypatch.setattr(brown, "FAR_TOKENS", 100)
    again, words = brown.fit(frame)
    assert (again.transition == model.transition).all() and (again.classes == model.classes).all()
    assert words.exceptAll(lexicon).isEmpty() and words.count() == lexicon.count()


def test_long_pages_have_a_reference_too(spark):
    page = "<body><div><p>{0}</p></div><div><p>Imprint of the house</p></div></body>"
    words = lambda i: " ".join(f"w{i}" for _ in range(25_000))
    rows = [(i, f"http://long.io/{i}", page.format(words(i))) for i in range(10, 18)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert len(rows[0][2]) > wrapper.MAX_REFERENCE
    got = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    assert got == {i: words(i) for i in range(10, 18)}


def test_brown_scores_of_rare_words_are_summed_without_row_functions(spark, capsys):
    """Words of a hand-made model and of its lexicon, alone and in runs, against the formula."""
    n_classes = brown.CLASSES
    known = {"a": (9, 1), "b": (5, 2)}  # n, class; the others lie in the lexicon
    rare = {f"r{i}": (1 + i % 3, 3 + i % 4) for i in range(40)}
    classes = np.zeros(brown.LOCAL + 1, np.int64)
    classes[:2] = [1, 2]
    transitions = np.arange(n_classes * n_classes).reshape(n_classes, n_classes) % 7
    totals, types, of_bucket = np.arange(n_classes) + 90, np.arange(n_classes) + 3, np.arange(brown.BUCKETS) % 40 + 1
    m = brown.Model(pa.array(list(known)), np.array([9, 5]), classes, of_bucket, transitions, totals, types, 200, 50, 4, 0.5)
    texts = [None, "a b a", "r1 r2 r3 a r4", "a r5 r6 b b r5 r6 r7", "x1 r8 x2 y", " ".join(f"r{i % 40} a r{i % 7}" for i in range(900))]
    rows = [(i % 5 or None, t, i % 2 == 0) for i, t in enumerate(texts)]  # ids are null or repeat
    frame = spark.createDataFrame(rows, "id long, body string, held_out boolean").repartition(2)
    lexicon = spark.createDataFrame([(w, *v) for w, v in rare.items()], "word string, n long, c int")
    result = brown.score(frame, m, lexicon)
    result.explain()
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" not in plan and "ArrowEvalPython" not in plan

    def wanted(text):
        last, known_, base, logs = 0, 0, 0.0, 0.0
        for w in [*(text or "").split(), None]:
            n, c = (4, 0) if w is None else {**known, **rare}.get(w) or (0, int(of_bucket[zlib.crc32(w[-4:].encode()) % brown.BUCKETS]))
            known_ += n > 0
            base += math.log10(n + 1) - m.base_total
            logs += m.transition[last, c]
            if w is not None:
                logs += (math.log10(n - 0.5) if n else m.unknown[c]) - m.class_total[c]
            last = c
        return known_, base, logs

    got = sorted(((r.n_tokens, r.id, r.held_out, r.n_known, r.base_score, r.score) for r in result.collect()), key=str)
    plain = sorted(((len((t or "").split()) + 1, i, h, *wanted(t)) for i, t, h in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in plain]
    for g, w in zip(got, plain):
        assert math.isclose(g[4], w[4]) and math.isclose(g[5], w[5])
