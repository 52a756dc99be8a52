"""Frames several jobs share: typed title subsets, credits by role, per-title bridge aggregates.

Bridge tables (credits, genres, episodes) are always reduced to one row per title *before* they
meet each other, so two 1:N bridges never multiply (the DISTINCT-after-fan-out of the SQL source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.columns import string_list

ACTING = ("actor", "actress")


def titles_of_type(cat: Catalog, title_type: str, *cols: str | Column) -> DataFrame:
    t = cat.titles.where(F.col("title_type") == title_type)
    return t.select(*cols) if cols else t


def restrict(df: DataFrame, keys: DataFrame | None, column: str) -> DataFrame:
    """Keep rows whose `column` appears in the optional `keys` frame (its first column)."""
    if keys is None:
        return df
    key = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    return df.join(key, df[column] == key["_key"], "left_semi")


def ratings_at_least(cat: Catalog, min_votes: int | None) -> DataFrame:
    r = cat.ratings
    return r if min_votes is None else r.where(F.col("num_votes") >= min_votes)


def credits(cat: Catalog, categories: tuple[str, ...] | None = None) -> DataFrame:
    tp = cat.title_people
    return tp if categories is None else tp.where(F.col("category").isin(*categories))


def genre_names(cat: Catalog) -> DataFrame:
    """title_id, genre (name): the genre bridge with names resolved."""
    g = cat.genres.select(F.col("id").alias("genre_id"), F.col("name").alias("genre"))
    return cat.title_genres.join(g, "genre_id").select("title_id", "genre")


def genre_list_by_title(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """title_id, genres: distinct genre names joined with ', ' in name order."""
    return restrict(genre_names(cat), keys, "title_id").groupBy("title_id").agg(string_list(F.col("genre")).alias("genres"))


def season_episode_counts(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """parent_series_id, season_count, episode_count.

    COUNT(DISTINCT season) and COUNT(DISTINCT episode) in two partial aggregations instead of one
    Expand-based double distinct: first per (series, season), then per series. episode_id is the
    episodes key, so counting it per season is counting distinct episodes. `keys` restricts the series.
    """
    per_season = (restrict(cat.episodes, keys, "parent_series_id").groupBy("parent_series_id", "season_number")
                  .agg(F.count("episode_id").alias("_eps")))
    return per_season.groupBy("parent_series_id").agg(
        F.count("season_number").alias("season_count"),
        F.sum("_eps").cast("bigint").alias("episode_count"),
    )


def cat_rank(category: Column) -> Column:
    """Order of credit categories on a cast page (fixed values of the source system)."""
    return (F.when(category == "director", 1).when(category == "writer", 2)
            .when(category == "producer", 3).when(category.isin("actor", "actress"), 4).otherwise(5))
