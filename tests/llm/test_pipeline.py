"""Queries with SQL against DuckDB; the pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from conftest import SF_SMALL
from marquee.llm import packing, pivots, quality, queries
from marquee.llm.common import materialise, table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    wanted = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF_SMALL).select(*wanted.columns).collect()
    assert sorted(map(tuple, got)) == sorted(wanted.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality_rules(docs, table(spark, SF_SMALL, "labels")).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        return materialise(stages[name](spark, frame, SF_SMALL), "t")

    one = step("quality rules", docs)
    assert one.columns == docs.columns and {r.doc_id: r.text for r in one.collect()} == {i: rows[i] for i in kept}
    two = step("line dedup", one)
    texts = {i: t for i, _, _, t in brute.lines([(i, rows[i]) for i in sorted(kept)])}
    assert {r.doc_id: r.text for r in two.collect()} == texts
    three = step("simhash near-dedup", two)
    ids = sorted(texts)
    fps = [brute.fingerprint(texts[i]) for i in ids]
    root = brute.components(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in three.collect()) == sorted({ids[r] for r in root})
    four = step("substring dedup", three)
    wanted = brute.substrings([(r.doc_id, r.text) for r in three.collect()])
    assert {r.doc_id: r.text for r in four.collect()} == {i: t for i, _, _, t in wanted}
    assert four.columns == docs.columns and all(r.n_chars == len(r.text) for r in four.collect())
    five = step("packing", four).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in five) == sorted(
        (i, len(brute.WORD.findall(t))) for i, _, _, t in wanted)


def test_pivot_recall(spark):
    """Links found, against all pairs by brute force; at least 0.9 is asked for."""
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    links = ((x @ x.T >= 0.98) & (label[:, None] == label)).sum(axis=1) - 1
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in pivots.embedding_components(frame).collect()}
    found = np.array([got[r.vec_id] for r in rows])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()


def test_stages_keep_clashing_columns_nulls_and_empty_tables(spark):
    """A caller's column named like one of an operator's comes back with the caller's value."""
    good = " ".join(f"word{i} of a fine text" for i in range(40))
    rows = [(1, good, "a"), (2, None, "b"), (None, good + " more", "c"), (4, "", "d"), (5, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    names = ("kept_text", "n_words", "n_removed", "n_lines", "n_dropped", "fingerprint", "component_id", "id", "body",
             "fp", "quality_score", "base_failed", "_doc_0", "lang")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("kept", F.lit("-"))) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == c + (r.kept or "-") for c in names), (name, r)
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == 5


def test_buckets_are_optimal_for_long_texts(spark):
    """Lengths beyond 4,096 words: the padding is the least that any cuts give."""
    rng = random.Random(4)
    lengths = [rng.randint(4097, 9000) for _ in range(14)] + [8000 + k for k in range(4)]
    docs = spark.createDataFrame([(i, "x " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    got = packing.pack(docs, n_buckets=3).collect()
    distinct = sorted(set(lengths))

    def padding(tops):
        return sum(min(t for t in tops if t >= n) - n for n in lengths)

    best = min(padding([*cuts, distinct[-1]]) for cuts in itertools.combinations(distinct[:-1], 2))
    assert sum(r.padded_len - r.n_tokens for r in got) == best
