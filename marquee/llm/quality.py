"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Base counts per text: words, their code points, symbols, repeated lines, words in repeated windows of
`WINDOW` words. A text fails the base rules with fewer than 20 words or with over 30 % of its words in
repeated windows.

Method: words and word pairs are hashed to `BUCKETS` buckets. The raw-corpus multinomial is counted over
all texts; the trusted-target multinomial over texts labelled as good and not toxic. A text's score is the
sum of log(target / raw) over its n-grams, divided by their number. The threshold is the one that best
separates good from bad texts in the labelled rows that were not used for the target; every text at or
above it is kept. The labelled rows are a bounded sample (`max_labelled`, smallest id hashes first); all
else covers all rows and needs no shuffle but of bucket counts.

Edge cases: a null or empty text has no words and fails the base rules; with no labelled rows, or without
both kinds among them, there is no threshold and the base rules alone decide; ties with the threshold are
kept; repeated rows are judged alike; an empty table gives no rows; null labels count as unlabelled; input
columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, smallest_hashes, words_column

WINDOW = 8
BUCKETS = 1 << 16
SMOOTHING = 1.0
MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score",
          "kept")


def _shifted(hashes: Column, by: int) -> Column:
    """Hash of each element with the one `by` places on."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array of all windows."""
    places = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))

    at = F.sort_array(F.transform(let(places, repeated), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words"))
    return F.aggregate(at, start, lambda acc, p: F.struct(
        p.alias("last"), (acc["words"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("words")),
        lambda acc: acc["words"])


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the base columns and the n-gram hashes `_llm_h1` (words) and `_llm_h2` (pairs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    counted = docs.select(
        *[c for c in docs.columns if c not in OUTPUT],
        words_column(F.col(text_col)).alias("_llm_words"),
        F.when(text.rlike(f"[{SYMBOLS}]"), F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")))
        .otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    h1, h2 = F.col("_llm_h1"), F.col("_llm_h2")
    hashed = (counted.withColumn("word_chars", F.length(F.array_join("_llm_words", "")).cast("long"))
              .withColumn("_llm_h1", F.transform("_llm_words", lambda w: F.xxhash64(w))).drop("_llm_words"))
    paired = hashed.withColumn("_llm_h2", _shifted(h1, 1))
    windows = let(_shifted(h2, 2), lambda h4: _shifted(h4, 4))
    some = F.size(F.array_distinct("_llm_h8")) < F.size("_llm_h8")
    return (paired.withColumn("_llm_h8", windows)
            .withColumn("n_words", F.size("_llm_h1").cast("long"))
            .withColumn("n_repeat_words", F.when(some, _covered(F.col("_llm_h8"))).otherwise(F.lit(0).cast("long")))
            .drop("_llm_h8")
            .withColumn("base_failed", (F.col("n_words") < 20)
                        | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _ngrams(docs: DataFrame, text_col: str) -> Column:
    hashes = F.transform(words_column(F.col(text_col)), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.concat(h, _shifted(h, 1)))


def labelled_sample(labels: DataFrame, id_col: str, max_labelled: int) -> DataFrame:
    """At most `max_labelled` rows (id, good, target): `target` rows train, the others calibrate."""
    rows = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col)
            .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    order = F.xxhash64(id_col)
    good = (F.col("quality") == 1)
    useful = materialise(rows.where(~(good & (F.coalesce(F.col("toxic"), F.lit(0)) == 1))), "quality-labels")
    return (smallest_hashes(useful, id_col, max_labelled)
            .select(F.col(id_col).alias("_llm_id"), good.alias("_llm_good"),
                    (good & (F.pmod(order, F.lit(2)) == 0)).alias("_llm_target")))


def bucket_weights(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: `weights`, an array of log(target / raw) by bucket."""
    grams = (docs.join(F.broadcast(sample.where("_llm_target").select("_llm_id")),
                       F.col(id_col) == F.col("_llm_id"), "left")
             .select(F.col("_llm_id").isNotNull().cast("long").alias("t"),
                     F.explode(_ngrams(docs, text_col)).alias("h")))
    counts = grams.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    counts = materialise(counts, "quality-buckets")  # no more than BUCKETS rows
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"),
                        F.coalesce(F.sum("target"), F.lit(0)).alias("targets")).first()
    part = lambda c, n: F.log((F.coalesce(F.col(c), F.lit(0)) + SMOOTHING) / (n + SMOOTHING * BUCKETS))
    spark = docs.sparkSession
    buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    weight = F.struct("b", (part("target", totals.targets) - part("raw", totals.raws)).alias("w"))
    return buckets.agg(F.transform(F.sort_array(F.collect_list(weight)), lambda x: x["w"]).alias("weights"))


def with_score(counted: DataFrame, weights: DataFrame) -> DataFrame:
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.get(F.col("_llm_w"), _bucket(x)))
    n = F.size("_llm_h1") + F.size("_llm_h2")
    return (counted.withColumn("_llm_w", weights.scalar())
            .withColumn("quality_score", F.when(n > 0, (total("_llm_h1") + total("_llm_h2")) / n).otherwise(F.lit(0.0)))
            .drop("_llm_w", "_llm_h1", "_llm_h2"))


def best_threshold(scores: DataFrame) -> float | None:
    """The score t for which `score >= t` best separates good from bad rows (share of good kept plus
    share of bad dropped); midway between neighbouring scores. `scores` is the bounded sample."""
    w = Window.orderBy("s")
    by_score = scores.groupBy("s").agg(F.sum(F.col("good").cast("int")).alias("g"),
                                       F.sum((~F.col("good")).cast("int")).alias("b"))
    totals = scores.agg(F.sum(F.col("good").cast("int")).alias("g"), F.sum((~F.col("good")).cast("int")).alias("b")).first()
    if not totals.g or not totals.b:
        return None
    below = by_score.select("s", F.lag("s").over(w).alias("before"),
                            (F.sum("g").over(w) - F.col("g")).alias("good_lost"),
                            (F.sum("b").over(w) - F.col("b")).alias("bad_lost"))
    gain = F.col("bad_lost") / totals.b - F.col("good_lost") / totals.g
    best = below.orderBy(gain.desc(), "s").select("s", "before").first()
    return best.s if best.before is None else (best.s + best.before) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_labelled: int = MAX_LABELLED) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality_score and kept."""
    sample = materialise(labelled_sample(labels, id_col, max_labelled), "quality-sample")
    weights = materialise(bucket_weights(docs, sample, id_col, text_col), "quality-weights")
    chosen = docs.join(F.broadcast(sample.where("not _llm_target")), F.col(id_col) == F.col("_llm_id"))
    scored = with_score(base_counts(chosen, text_col), weights)
    scored = materialise(scored.select("base_failed", F.col("quality_score").alias("s"),
                                       F.col("_llm_good").alias("good")), "quality-scores")
    threshold = best_threshold(scored.where("not base_failed"))
    out = with_score(base_counts(docs, text_col), weights)
    passed = F.lit(True) if threshold is None else F.col("quality_score") >= threshold
    # Generated, so that a caller's filter on it stays above and the counts are computed once, not
    # once for the filter's copy of the expression.
    return out.withColumn("kept", F.explode(F.array(~F.col("base_failed") & passed)))
