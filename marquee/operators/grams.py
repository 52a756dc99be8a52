"""Batch substring search: join texts with LIKE patterns through the rarest gram of each pattern.

A pattern's literal runs give its grams: substrings of three characters, or of two or one where no run is that
long; a pattern without any literal has the empty gram, which every text has. A text that matches a pattern
holds all its grams, so it is enough to join on one of them. Which one decides how many candidates are checked
in vain: the grams are counted over all texts first, and every pattern takes the one that fewest texts hold. A
pattern with a gram that no text holds matches nothing and leaves at once.

A gram can stay hot (all patterns short, or all texts alike). Its texts and patterns are dealt to a grid of
cells with at most about `CELL` texts and `CELL` patterns each; texts are copied along one side of the grid,
patterns along the other, and every pair still meets in exactly one cell. The table of chosen grams is
broadcast only if it was counted to hold `SMALL` grams at most; beyond that it is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

WIDTH = 3
CELL = 4096
SMALL = 100_000
_PARTS = ("_gram", "_row_cell", "_term_cell")


def _substrings(text: Column, width: int) -> Column:
    """All substrings of `width` characters, none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (width - 1), F.lit(1)))
    return F.when(F.length(text) >= width, F.transform(starts, lambda i: F.substr(text, i, F.lit(width)))).otherwise(
        F.array().cast("array<string>"))


def text_grams(texts: Sequence[str], widths: Sequence[int]) -> Column:
    """Distinct grams of the given widths in any of the text columns; width 0 is the empty gram."""
    parts = [F.array(F.lit(""))] if 0 in widths else []
    for name in texts:
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        parts += [_substrings(low, w) for w in widths if w]
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def pattern_grams(pattern: Column) -> Column:
    """Grams of a LIKE pattern, of the greatest width that one of its literal runs has."""
    runs = F.split(F.lower(pattern), r"(?s)\\.|[%_]")
    out = F.array(F.lit(""))
    for width in range(1, WIDTH + 1):
        found = F.array_distinct(F.flatten(F.transform(runs, lambda r: _substrings(r, width))))
        out = F.when(F.size(found) > 0, found).otherwise(out)
    return out


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


class GramIndex:
    """The chosen gram of each pattern of `patterns` (columns `term`, `pattern`; terms distinct), given all
    `sides`: frames of rows with the text columns that may match."""

    def __init__(self, patterns: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str]]]):
        scratch_dir(patterns.sparkSession)
        grams = patterns.withColumn("_gram", F.explode(pattern_grams(F.col("pattern"))))
        grams = grams.checkpoint(eager=True)
        self.widths = [r[0] for r in grams.select(F.length("_gram")).distinct().collect()]  # 0 to WIDTH
        needed = grams.select("_gram").distinct()
        counted = None
        for rows, texts in sides:
            held = rows.select(F.explode(text_grams(texts, self.widths)).alias("_gram"))
            counted = held if counted is None else counted.unionByName(held)
        counted = (counted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
                   .join(needed, "_gram", "left_semi").checkpoint(eager=True))
        small = counted.count() <= SMALL
        rarest = F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("_rows"), "_gram"))
        self.terms = (grams.join(_hint(counted, small), "_gram", "left").groupBy("term", "pattern")
                      .agg(rarest.alias("_best")).where("_best._rows > 0")
                      .select("term", "pattern", "_best._gram", "_best._rows").checkpoint(eager=True))
        cells = lambda n: F.ceil(n / CELL).cast("int")
        self.grid = (self.terms.groupBy("_gram").agg(cells(F.max("_rows")).alias("_row_cells"),
                                                     cells(F.count(F.lit(1))).alias("_term_cells"))
                     .checkpoint(eager=True))
        self.small = self.grid.count() <= SMALL
        dealt = self.terms.drop("_rows").join(_hint(self.grid, self.small), "_gram")
        self.dealt = dealt.withColumns({
            "_term_cell": F.pmod(F.xxhash64("term"), F.col("_term_cells")).cast("int"),
            "_row_cell": F.explode(F.sequence(F.lit(0), F.col("_row_cells") - 1))}).drop("_row_cells", "_term_cells")

    def candidates(self, rows: DataFrame, texts: Sequence[str], key: str = "id") -> DataFrame:
        """`rows` x (`term`, `pattern`) where the row holds the pattern's rarest gram."""
        held = (rows.withColumn("_gram", F.explode(text_grams(texts, self.widths)))
                .join(_hint(self.grid, self.small), "_gram"))
        held = held.withColumns({
            "_row_cell": F.pmod(F.xxhash64(key), F.col("_row_cells")).cast("int"),
            "_term_cell": F.explode(F.sequence(F.lit(0), F.col("_term_cells") - 1))}).drop("_row_cells", "_term_cells")
        return held.join(self.dealt, list(_PARTS)).drop(*_PARTS)

    def matches(self, rows: DataFrame, texts: Sequence[str], key: str = "id") -> DataFrame:
        """`rows` x (`term`, `pattern`) where one of `texts` is ILIKE the pattern; each pair once."""
        condition = " OR ".join(f"`{c}` ILIKE pattern" for c in texts)
        return self.candidates(rows, texts, key).where(F.expr(condition))
