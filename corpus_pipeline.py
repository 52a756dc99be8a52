"""A corpus pipeline over `documents`: quality rules, line dedup, SimHash near-dedup, substring dedup,
packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's `docs`; it sees exactly what its predecessor kept, and judges that alone. All stages
but the last return the columns of `documents`, with `n_chars` following the text. The last returns one
row per remaining document: its length, bucket and batch.

Edge cases, in every stage: other columns of `docs` come back as they were, whatever their names; a null text
counts as empty (the quality rules reject it); null ids and repeated rows are judged row by row, except that
one row of each group stays in the SimHash stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import lines, packing, quality, simhash, substring
from marquee.llm.common import materialise, table


KNOWN = ("doc_id", "text")  # the columns that the operators read


def _hidden(docs: DataFrame) -> DataFrame:
    """`docs` with the columns that an operator need not know under names that clash with none of its own."""
    return docs.select([F.col(f"`{c}`").alias(c if c in KNOWN else f"_doc_{i}") for i, c in enumerate(docs.columns)])


def _shown(df: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` by their own names; the text is the column `text`, and `n_chars` follows it."""
    out = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            out.append(F.col(text).alias(c))
        elif c == "n_chars" and text != "text":
            out.append(F.length(text).cast("long").alias(c))
        else:
            out.append(F.col(c if c in KNOWN else f"_doc_{i}").alias(c))
    return df.select(out)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules (6)."""
    judged = quality.quality_rules(_hidden(docs), table(spark, sf_dir, "labels"))
    return _shown(judged.where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines everywhere but in the first document that holds them (9)."""
    return _shown(lines.dedup_lines(_hidden(docs)), docs, "kept_text")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates (7)."""
    return _shown(simhash.keep_first_of_group(_hidden(docs)), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occur more than once (3)."""
    return _shown(substring.dedup_substrings(_hidden(docs)), docs, "kept_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches (1)."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

# No stage but line dedup can be put in SQL as a whole (hashed scores, fingerprints, dynamic programming);
# tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
