"""Column expressions shared by the jobs. All are built-in Spark functions (JVM side, codegen'd).

Numeric rules (same in the SQL twins, so results agree bit for bit):
  * `mean`: AVG of an exact column as `double(SUM) / COUNT`; SUM of a decimal is exact, so equal
    inputs give equal doubles whatever the partitioning.
  * `stddev`: sample standard deviation of a one-decimal column from exact integer moments.
  * `round_half_up`: rounds through DECIMAL(38,10) so ties round away from zero, as in PostgreSQL's
    numeric ROUND, and double noise never decides a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_DEC = "decimal(38,0)"


def round_half_up(col: Column, n: int) -> Column:
    return F.round(col.cast("decimal(38,10)"), n).cast("double")


def round_dec(col: Column, n: int) -> Column:
    """Like `round_half_up` but keeps the exact decimal (for values averaged again later)."""
    return F.round(col.cast("decimal(38,10)"), n)


def mean(col: Column | str, over: Window | None = None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    total, n = F.sum(col), F.count(col)
    if over is not None:
        total, n = total.over(over), n.over(over)
    return F.try_divide(total.cast("double"), n)


def stddev(col: Column | str) -> Column:
    """stddev_samp of a column with one decimal place (ratings), exact up to the final sqrt."""
    col = F.col(col) if isinstance(col, str) else col
    x = (col * 10).cast("bigint")
    n = F.count(x).cast(_DEC)
    num = n * F.sum(x.cast(_DEC) * x) - F.sum(x).cast(_DEC) * F.sum(x)
    den = n * (F.count(x) - 1)
    return F.sqrt(num.cast("double") / F.nullif(den, F.lit(0)).cast("double")) / F.lit(10.0)


def stddev_at_most(col: Column | str, limit: float) -> Column:
    """Exact test `stddev_samp(col) <= limit` for a one-decimal column (no float rounding)."""
    col = F.col(col) if isinstance(col, str) else col
    x = (col * 10).cast("bigint")
    n = F.count(x).cast(_DEC)
    num = n * F.sum(x.cast(_DEC) * x) - F.sum(x).cast(_DEC) * F.sum(x)
    bound = F.lit(round(limit * limit * 100, 6)).cast("decimal(38,6)")
    return num <= bound * n * (F.count(x) - 1)


def mean_at_least(col: Column | str, limit: float) -> Column:
    """Exact test `avg(col) >= limit` on a decimal column."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col) >= F.lit(str(limit)).cast("decimal(38,6)") * F.count(col)


def decade(year: Column | str) -> Column:
    year = F.col(year) if isinstance(year, str) else year
    return (F.floor(year / 10) * 10).cast("int")


def string_list(col: Column) -> Column:
    """STRING_AGG(DISTINCT x, ', ') with a stated order (by value) and NULL, not '', when empty."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(col)), ", "), F.lit(""))


def ratio_pct(num: Column, den: Column) -> Column:
    """100 * num / den in double precision (the input counts are exact), NULL when den is 0."""
    return F.try_divide(F.lit(100.0) * num.cast("double"), F.nullif(den, F.lit(0)).cast("double"))
