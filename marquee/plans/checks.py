"""The constraints a Parquet catalogue does not enforce, checked as one Spark job per rule.

Rules: primary keys unique and not NULL, NOT NULL columns, the unique genre name, every foreign key
resolvable, and the 20-character bound of `title_type`. Each rule yields one row
(table, rule, violations, sample) where `sample` is the smallest offending key (NULL when clean).
All rules run in a few passes (see `check_catalog`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import (FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, Catalog, read_catalog, read_manifest,
                       read_parts)

UNIQUE = {"genres": ["name"]}
MAX_LENGTH = {("titles", "title_type"): 20}


def _key_text(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])


def _rules() -> list[tuple[str, str]]:
    """Every (table, rule) pair checked, in report order."""
    rules = []
    for table, key in PRIMARY_KEYS.items():
        rules.append((table, f"primary key ({', '.join(key)}) unique"))
        rules += [(table, f"{c} not null") for c in key + NOT_NULL.get(table, [])]
        rules += [(table, f"length({col}) <= {n}") for (t, col), n in MAX_LENGTH.items() if t == table]
    rules += [(table, f"({', '.join(cols)}) unique") for table, cols in UNIQUE.items()]
    rules += [(table, f"{col} references {ref}({ref_col})") for table, col, ref, ref_col in FOREIGN_KEYS]
    return rules


UNIQUE_KEYS = ([(t, f"primary key ({', '.join(k)}) unique", k) for t, k in PRIMARY_KEYS.items()]
               + [(t, f"({', '.join(c)}) unique", c) for t, c in UNIQUE.items()])

# What is kept of a checked snapshot: violations by rule, and the references without a target.
FOUND = "table string, rule string, violations long, sample string"
DANGLING = "table string, rule string, ref string, key string, n long"


def _repeated_keys(tables: dict[str, DataFrame], known: dict[str, DataFrame] | None) -> DataFrame:
    """Keys that `tables` make repeated: with `known`, those not repeated there before. One aggregation per
    key, on the key's own columns; text is made for the sample only."""
    parts = []
    for t, rule, cols in UNIQUE_KEYS:
        counts = tables[t].groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        if known is not None:
            new = counts.select(*[F.col(c).alias(f"_{c}") for c in cols], "_n")
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
            before = known[t].select(*cols).join(new, same, "left_semi").groupBy(*cols).agg(
                F.count(F.lit(1)).alias("_before"))
            counts = (new.join(before, same, "left").where(F.coalesce("_before", F.lit(0)) <= 1)
                      .select(*[F.col(f"_{c}").alias(c) for c in cols],
                              (F.col("_n") + F.coalesce("_before", F.lit(0))).alias("_n")))
        parts.append(counts.where(F.col("_n") > 1).select(
            F.lit(t).alias("table"), F.lit(rule).alias("rule"), _key_text(cols).alias("key"),
            F.lit(1).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def _faulty_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row-level rules: one scan per table, one output row per violated rule."""
    parts = []
    for table, key in PRIMARY_KEYS.items():
        checks = [(f"{c} not null", F.col(c).isNull()) for c in key + NOT_NULL.get(table, [])]
        checks += [(f"length({col}) <= {n}", F.length(col) > n)
                   for (t, col), n in MAX_LENGTH.items() if t == table]
        failed = F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in checks]), lambda r: r.isNotNull())
        parts.append(tables[table].select(F.lit(table).alias("table"), F.explode(failed).alias("rule"),
                                          _key_text(key).alias("key"), F.lit(1).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def _dangling(tables: dict[str, DataFrame], targets: dict[str, DataFrame], before: DataFrame | None) -> DataFrame:
    """References of `tables` and of `before` (the references left open by earlier parts) that no row of
    `targets` resolves: all columns referencing one table in one anti-join. Rows are first combined to one
    per referenced id, so an id that very many rows refer to is one row in the join."""
    parts = []
    for ref in sorted({r for _, _, r, _ in FOREIGN_KEYS}):
        here = [(t, col, f"{col} references {r}({rc})", rc) for t, col, r, rc in FOREIGN_KEYS if r == ref]
        rows = reduce(DataFrame.unionByName, [
            tables[t].where(F.col(col).isNotNull()).select(
                F.lit(t).alias("table"), F.lit(rule).alias("rule"), F.col(col).cast("string").alias("ref"),
                _key_text(PRIMARY_KEYS[t]).alias("key"), F.lit(1).cast("bigint").alias("n"))
            for t, col, rule, _ in here])
        if before is not None:
            open_ = reduce(Column.__or__, [(F.col("table") == t) & (F.col("rule") == rule) for t, _, rule, _ in here])
            rows = rows.unionByName(before.where(open_))
        # the id first: rows are sorted by it for the smallest key, and the names are the same in most rows
        combined = rows.groupBy("ref", "table", "rule").agg(F.min("key").alias("key"), F.sum("n").alias("n"))
        target = targets[ref].select(F.col(here[0][3]).cast("string").alias("ref"))
        parts.append(combined.join(target, "ref", "left_anti").select("table", "rule", "ref", "key", "n"))
    return reduce(DataFrame.unionByName, parts)


def _by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("table", "rule").agg(F.sum("n").alias("violations"), F.min("key").alias("sample"))


def _report(found: DataFrame) -> DataFrame:
    """Every rule with its violations, 0 for the clean ones. `found`: (table, rule, violations, sample)."""
    rules = found.sparkSession.createDataFrame(_rules(), "table string, rule string")
    total = found.groupBy("table", "rule").agg(F.sum("violations").alias("violations"), F.min("sample").alias("sample"))
    return rules.join(total, ["table", "rule"], "left").select(
        "table", "rule", F.coalesce("violations", F.lit(0)).alias("violations"), "sample")


def check_catalog(cat: Catalog) -> DataFrame:
    """One row per rule: (table, rule, violations, sample).

    Few passes whatever the number of rules: one aggregation per unique key, one scan per table that
    emits its row-level violations, and one anti-join per referenced table against all columns that
    reference it; a join onto the rule list reports the clean rules with 0.
    """
    tables = cat.tables()
    return _report(_by_rule(reduce(DataFrame.unionByName, [
        _repeated_keys(tables, None), _faulty_rows(tables), _dangling(tables, tables, None).drop("ref")])))


def check_snapshot(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """`check_catalog` of the snapshot at `path`, with what was found kept beside it.

    With `base`, an earlier checked snapshot that `path` was written on, only the folders added since are
    checked: their rows; their keys against the same keys of the earlier folders (a semi-join, nothing earlier
    is aggregated again); their references against all targets. References that `base` left open are tried
    against the new targets only. Equal to the full check, since nothing is ever removed from a snapshot."""
    skip = 0 if base is None else 1 + max(part for _, part, *_ in read_manifest(spark, base))
    new = read_parts(spark, path, skip).tables()
    if base is None:
        found = _by_rule(_repeated_keys(new, None).unionByName(_faulty_rows(new)))
        _dangling(new, new, None).write.parquet(f"{path}/checks/dangling")
    else:
        known, whole = read_catalog(spark, base).tables(), read_catalog(spark, path).tables()
        before = spark.read.schema(DANGLING).parquet(f"{base}/checks/dangling")
        earlier = spark.read.schema(FOUND).parquet(f"{base}/checks/found")
        found = _by_rule(_repeated_keys(new, known).unionByName(_faulty_rows(new))).unionByName(earlier)
        found = found.groupBy("table", "rule").agg(F.sum("violations").alias("violations"),
                                                   F.min("sample").alias("sample"))
        none = {t: df.limit(0) for t, df in new.items()}
        (_dangling(new, whole, None).unionByName(_dangling(none, new, before))
         .write.parquet(f"{path}/checks/dangling"))
    found.write.parquet(f"{path}/checks/found")
    dangling = spark.read.schema(DANGLING).parquet(f"{path}/checks/dangling")
    return _report(spark.read.schema(FOUND).parquet(f"{path}/checks/found").unionByName(_by_rule(dangling.drop("ref"))))
