"""URL filter: rules by host and path, and for all other URLs a likelihood ratio of two character models.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#`
or the end. A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's;
the longest fitting rule wins (of equally long ones the first in order).

Method: the URLs that a rule decides train two variable-order Markov models over the bytes of a URL,
accepted and rejected. Orders 0 to `ORDER` are counted in hashed tables of a fixed size, and each order is
smoothed towards the next lower one: p_k = (c(context, byte) + A p_{k-1}) / (c(context) + A). A URL's score
is (log p_accepted - log p_rejected) / bytes. The threshold is calibrated on the rule-decided URLs with an
odd hash, which the models for calibration do not see: the histogram of their scores (a fixed number of
bins) gives the cut with the best share of right verdicts, averaged over the two kinds. The final models
learn from all rule-decided URLs. URLs at or above the threshold are allowed.

Edge cases: a null or empty URL, or one without `://`, has an empty host and path and no rule; it is
scored like any other (an empty one scores 0); if either kind of rule decides no URL, the models say
nothing: all scores are 0 and the threshold is 0, so what no rule blocks is allowed; repeated rows and ties
get equal verdicts; an empty table gives no rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, raw_texts, slices

# Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
TABLE = 1 << 18
STRENGTH = 2.0
BINS = 400
RANGE = 4.0                  # scores beyond +-RANGE fall into the outer bins
OUTPUT = ("host", "path", "rule", "verdict", "url_score")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the last one tried is the longest
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _places(raw: list[bytes]):
    """For all bytes of several URLs one after the other: owner, and by order the table cells of
    (context, byte) and of the context. A context begins anew at each URL."""
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    context = np.zeros(flat.size, np.uint64)
    cells = []
    for k in range(ORDER + 1):
        if k:  # one byte further back; before the URL's start there is 256
            back = np.where(inside >= k, np.roll(flat, k), np.uint64(256))
            context = (context + back + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(31)
        pair = (context ^ (flat + np.uint64(k << 9))) * np.uint64(0xC2B2AE3D27D4EB4F)
        whole = (context + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        shift = np.uint64(64 - (TABLE - 1).bit_length())
        cells.append(((pair >> shift).astype(np.int64), (whole >> shift).astype(np.int64)))
    return sizes, owner, cells


def _models(urls: DataFrame, fold: str | None) -> np.ndarray | None:
    """Counts [kind, order, pair or context, cell] from the rule-decided URLs; None if a kind is empty.
    Bounded: 2 * (ORDER + 1) * 2 tables of TABLE cells."""
    labelled = urls.where("kind is not null")
    labelled = labelled.where(f"fold = {fold}") if fold else labelled

    def count(batches):
        tables = np.zeros((2, ORDER + 1, 2, TABLE), np.int64)
        rows = 0
        for batch in batches:
            for part in slices(batch, "url"):
                raw, kind = raw_texts(part.column("url")), part.column("kind").to_numpy()
                rows += len(raw)
                _, owner, cells = _places(raw)
                for k, both in enumerate(cells):
                    for which, cell in enumerate(both):
                        tables[:, k, which] += np.bincount(kind[owner] * TABLE + cell,
                                                           minlength=2 * TABLE).reshape(2, TABLE)
        if rows:
            for kind in range(2):
                for k in range(ORDER + 1):
                    for which in range(2):
                        t = tables[kind, k, which]
                        at = np.flatnonzero(t)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(at.size, (kind * (ORDER + 1) + k) * 2 + which, np.int32)),
                            pa.array(at), pa.array(t[at])], ["which", "cell", "n"])

    counts = (labelled.select("url", "kind").mapInArrow(count, "which int, cell long, n long")
              .groupBy("which", "cell").agg(F.sum("n").alias("n")))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.column_stack([
                batch.column(c).to_numpy() for c in ("which", "cell", "n")]).astype(np.int64).tobytes(), 1)],
                pa.binary())], ["rows"])

    tables = np.zeros((2 * (ORDER + 1) * 2, TABLE), np.int64)
    for r in counts.mapInArrow(pack, "rows binary").collect():  # one entry per table cell at most
        which, cell, n = np.frombuffer(zlib.decompress(r["rows"]), np.int64).reshape(-1, 3).T
        tables[which, cell] = n
    tables = tables.reshape(2, ORDER + 1, 2, TABLE)
    return tables if tables[:, 0, 0].sum(axis=1).all() else None


def score_batch(raw: list[bytes], tables: np.ndarray) -> np.ndarray:
    """(log p_accepted - log p_rejected) / bytes for each URL."""
    sizes, owner, cells = _places(raw)
    logs = []
    for kind in range(2):
        p = np.full(owner.size, 1 / 256)
        for k, (pair, whole) in enumerate(cells):
            p = (tables[kind, k, 0][pair] + STRENGTH * p) / (tables[kind, k, 1][whole] + STRENGTH)
        logs.append(np.log(np.maximum(p, 1e-300)))
    total = np.bincount(owner, weights=logs[1] - logs[0], minlength=len(raw))
    return total / np.maximum(sizes, 1)


def _scorer(spark, tables: np.ndarray | None):
    if tables is None:
        return lambda url: F.lit(0.0)
    shared = spark.sparkContext.broadcast(zlib.compress(tables.astype(np.float32).tobytes(), 1))
    memory = {}

    @F.arrow_udf(T.DoubleType())
    def run(urls: pa.Array) -> pa.Array:
        if "tables" not in memory:
            memory["tables"] = np.frombuffer(zlib.decompress(shared.value), np.float32).reshape(2, ORDER + 1, 2, TABLE)
        raw = raw_texts(urls)
        parts = [score_batch(raw[i:i + 4096], memory["tables"]) for i in range(0, len(raw), 4096)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best mean share of right verdicts, from a histogram of the scores `s` of rows
    with a known `kind` (1 accepted, 0 rejected): a fixed number of bins at any input size."""
    step = 2 * RANGE / BINS
    bin_ = F.least(F.greatest(F.floor((F.col("s") + RANGE) / step), F.lit(0)), F.lit(BINS - 1)).cast("int")
    hist = np.zeros((2, BINS))
    for r in scored.groupBy("kind", bin_.alias("bin")).count().collect():
        hist[r["kind"], r["bin"]] = r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    share = hist / hist.sum(axis=1, keepdims=True)
    right = np.concatenate(([0], np.cumsum(share[0]))) + 1 - np.concatenate(([0], np.cumsum(share[1])))
    best = np.flatnonzero(right >= right.max() - 1e-12)  # the middle of equally good cuts
    return float(best[(best.size - 1) // 2] * step - RANGE)


def url_filter(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and url_score."""
    verdicts = {rule: verdict for rule, verdict in rules}
    judged = (pages.select(*[c for c in pages.columns if c not in OUTPUT])
              .withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
              .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    given = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        given = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(given)
    urls = materialise(judged.select(
        F.col(url_col).alias("url"), (given == "allow").cast("int").alias("kind"),
        F.pmod(F.xxhash64(url_col), F.lit(2)).cast("int").alias("fold")).where("kind is not null"), "url-labelled")
    spark = pages.sparkSession
    trial = _models(urls, "0")
    held_out = urls.where("fold = 1")
    threshold = 0.0 if trial is None else calibrate(
        held_out.select("kind", _scorer(spark, trial)(F.col("url")).alias("s")))
    score = _scorer(spark, _models(urls, None))(F.col(url_col))
    return (judged.withColumn("url_score", score)
            .withColumn("verdict", F.coalesce(given, F.when(F.col("url_score") >= threshold, F.lit("allow"))
                                              .otherwise(F.lit("block")))))
