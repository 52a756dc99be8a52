"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bestfit, bpe, brown, collocations, lines, packing, periods, pivots, quality, simhash, substring, urls, wrapper
from .common import table


def op1_length_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_pivot_permutations(spark, sf_dir):
    return pivots.embedding_components(table(spark, sf_dir, "embeddings"))


def op3_fm_index(spark, sf_dir):
    return substring.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_wrapper_induction(spark, sf_dir):
    return wrapper.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_brown_classes(spark, sf_dir):
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "quality_score")


def op7_simhash_trie(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op9_line_bloom(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_bpe_rounds(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_url_models(spark, sf_dir):
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "url_score")


def op11_collocations(spark, sf_dir):
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    docs = periods.with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periods.longest_run(F.col("runs"))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (periods.periodic_runs(docs).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed_text", 256).alias("collapsed_sha256")))


def op13_best_fit(spark, sf_dir):
    import public_tokenizers

    return bestfit.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_length_buckets": op1_length_buckets,
    "op2_pivot_permutations": op2_pivot_permutations,
    "op3_fm_index": op3_fm_index,
    "op4_wrapper_induction": op4_wrapper_induction,
    "op5_brown_classes": op5_brown_classes,
    "op8_bpe_rounds": op8_bpe_rounds,
    "op10_url_models": op10_url_models,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_trie": op7_simhash_trie,
    "op9_line_bloom": op9_line_bloom,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit": op13_best_fit,
}

ORACLE_SQL = {
    "op2_pivot_permutations": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings
      UNION SELECT c.node, p.v FROM c JOIN p ON c.reached = p.u),
m AS (SELECT node, min(reached) AS component_id FROM c GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op3_fm_index": r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
g AS (SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS seq, n FROM w),
r AS (SELECT doc_id, pos FROM g WHERE pos + 34 <= n
      QUALIFY count(*) OVER (PARTITION BY seq) > 1),
c AS (SELECT w.doc_id, w.pos, w.word, max(r.pos) OVER (
        PARTITION BY w.doc_id ORDER BY w.pos ROWS UNBOUNDED PRECEDING) AS covering
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (covering + 34 >= pos) AS n_removed,
             string_agg(word, ' ' ORDER BY pos) FILTER (covering IS NULL OR covering + 34 < pos) AS kept
      FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)""",
    "op9_line_bloom": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.keeper IS NULL OR r.keeper = k.doc_id), ''))
         AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY k.doc_id""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
      FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3)) s(size)
      WHERE i + size - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, size, phrase, lang || chr(9) || phrase AS key, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cut AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, cut,
         lang || chr(9) || array_to_string(string_split(phrase, ' ')[:cut], ' ') AS head,
         lang || chr(9) || array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail
  FROM f, (VALUES (1), (2)) c(cut) WHERE f >= 10 AND size > cut),
s AS MATERIALIZED (
  SELECT cut.lang, cut.size, cut.phrase, a, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.key = head JOIN f y ON y.key = tail
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (
             SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '),
                                     array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS part
             FROM s WHERE size = 3) GROUP BY lang, part)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, phrase) AS rank, phrase, s.a, l, r,
       n, score
FROM s JOIN n USING (lang) LEFT JOIN longer ON longer.lang = s.lang AND part = phrase AND size = 2
WHERE longer.a IS NULL OR 100 * longer.a < 50 * s.a
QUALIFY rank <= 2000""",
}
