"""Page jobs: the rows behind a title, series, episode or person page, for every key in one pass.

The source answers one key per statement (`WHERE id = $1`); a point lookup is not a Spark job, so
each job here builds the page rows for all titles (or people) at once, and takes an optional `keys`
frame (first column = ids) that restricts the output with a semi-join. Per-key "first n" lists are
windowed top-k; per-title lists (directors, writers, genres, season counts) are aggregated per title
before they are joined, so independent bridges never multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.columns import mean, string_list
from ..operators.running import running_aggregates
from ..operators.skew import HeavyKeys, join_chain
from ..operators.topk import top_k_per_key
from .common import (ACTING, cat_rank, credits, genre_list_by_title, restrict, season_episode_counts,
                     titles_of_type)


def _people(cat: Catalog) -> DataFrame:
    return cat.people.select(F.col("id").alias("person_id"), "name")


def _rating(cat: Catalog) -> DataFrame:
    return cat.ratings.select(F.col("title_id").alias("_rid"), "average_rating", "num_votes")


def _with_rating(df: DataFrame, cat: Catalog, key: str = "id") -> DataFrame:
    r = _rating(cat)
    return df.join(r, df[key] == r["_rid"], "left").drop("_rid")


def _left(df: DataFrame, other: DataFrame, key: str = "id", other_key: str = "title_id") -> DataFrame:
    return df.join(other, df[key] == other[other_key], "left").drop(other[other_key])


def _with_position(rows: DataFrame, key: str, order: list, heavy: HeavyKeys) -> DataFrame:
    """`rows` with their position within `key`; a key with very many rows is numbered by several tasks."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    if heavy.any:
        return running_aggregates(rows, key, columns, {}).withColumn("position", F.col("pos").cast("bigint"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*columns)).cast("bigint"))


def movie_summary(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Title columns, rating, distinct directors, writers and genres as ', ' lists."""
    movies = restrict(titles_of_type(cat, "movie", "id", "primary_title", "original_title", "start_year",
                                     "runtime_minutes"), keys, "id")
    ids = movies.select("id")
    crew = credits(cat, ("director", "writer")).select("title_id", "person_id", "category")
    crew = restrict(crew, ids, "title_id").join(_people(cat), "person_id")
    lists = crew.groupBy("title_id").agg(
        string_list(F.when(F.col("category") == "director", F.col("name"))).alias("directors"),
        string_list(F.when(F.col("category") == "writer", F.col("name"))).alias("writers"),
    )
    out = _left(_left(_with_rating(movies, cat), lists), genre_list_by_title(cat, ids))
    return out.select("id", "primary_title", "original_title", "start_year", "runtime_minutes",
                      "average_rating", "num_votes", "directors", "writers", "genres")


def _acting_credits(cat: Catalog, title_type: str, categories, keys: DataFrame | None) -> DataFrame:
    titles = restrict(titles_of_type(cat, title_type, "id"), keys, "id")
    c = credits(cat, tuple(categories)).select("title_id", "person_id", "category", "characters")
    return c.join(titles, c["title_id"] == titles["id"], "left_semi")


def movie_top_cast(cat: Catalog, keys: DataFrame | None = None, k: int = 5,
                   categories: tuple[str, ...] = ("actor",)) -> DataFrame:
    """First k credits of the given categories per movie, by person id.

    The order needs no name, so each movie is cut to k credits before people are joined. Every credit's person
    must be in the catalogue (a foreign key of the source; the import and I10 see to it)."""
    order = [F.col("person_id").asc(), F.col("category").asc()]
    cut = top_k_per_key(_acting_credits(cat, "movie", categories, keys), ["title_id"], order, k)
    return cut.join(_people(cat), "person_id").select("title_id", "name", "characters",
                                                      F.col("pos").cast("bigint").alias("pos"))


def series_top_cast(cat: Catalog, keys: DataFrame | None = None, k: int = 10) -> DataFrame:
    """First k actors/actresses per series, by name."""
    named = _acting_credits(cat, "tvSeries", ACTING, keys).join(_people(cat), "person_id")
    order = [F.col("name").asc(), F.col("person_id").asc(), F.col("category").asc()]
    return top_k_per_key(named, ["title_id"], order, k).select("title_id", "name", "characters",
                                                               F.col("pos").cast("bigint").alias("pos"))


def movie_details(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Every title column, the extended details (arrays) and the rating."""
    movies = restrict(titles_of_type(cat, "movie"), keys, "id")
    details = cat.title_details
    out = _with_rating(_left(movies, details), cat)
    return out.select(*cat.titles.columns, "production_company", "alternative_titles", "languages",
                      "countries", "average_rating", "num_votes")


def cast_crew(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Every credit with the person's details and its position on the title's page: by category, then name."""
    c = restrict(cat.title_people, keys, "title_id")
    p = cat.people.select(F.col("id").alias("person_id"), "name", "birth_year", "death_year")
    rows = c.join(p, "person_id").withColumn("category_order", cat_rank(F.col("category")))
    return _with_position(rows, "title_id", ["category_order", "name", "person_id", "category"], cat.heavy_titles).select(
        "title_id", "category", "name", "job", "characters", "birth_year", "death_year", "category_order", "position")


def series_summary(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Per series: rating, numbered-season and episode counts (0 when none), genres."""
    series = restrict(titles_of_type(cat, "tvSeries", "id", "primary_title", "start_year", "end_year"), keys, "id")
    ids = series.select("id")
    counts = season_episode_counts(cat, ids).withColumnRenamed("parent_series_id", "title_id")
    out = _left(_left(_with_rating(series, cat), counts), genre_list_by_title(cat, ids))
    return out.select("id", "primary_title", "start_year", "end_year", "average_rating", "num_votes",
                      F.coalesce("season_count", F.lit(0)).alias("season_count"),
                      F.coalesce("episode_count", F.lit(0)).cast("bigint").alias("episode_count"),
                      "genres")


def season_breakdown(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Per series and season: episodes, first year, mean rating, total votes, position by season.

    A series holding a large share of all episodes is fine: the aggregation combines map-side, and only its
    seasons are numbered.
    """
    e = restrict(cat.episodes, keys, "parent_series_id")
    et = cat.titles.select("id", "start_year")
    j = e.join(et, e["episode_id"] == et["id"])
    j = _with_rating(j, cat, key="episode_id")
    seasons = j.groupBy("parent_series_id", "season_number").agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.min("start_year").alias("season_start_year"),
        mean("average_rating").alias("avg_season_rating"),
        F.sum("num_votes").cast("bigint").alias("total_votes"),
    )
    order = Window.partitionBy("parent_series_id").orderBy(F.col("season_number").asc_nulls_last())
    return seasons.withColumn("position", F.row_number().over(order).cast("bigint"))


def episode_page(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Episode title, season/episode numbers, rating and the parent series' title."""
    t = restrict(cat.titles.select("id", "primary_title", "start_year"), keys, "id")
    e = restrict(cat.episodes, keys, "episode_id")
    series = cat.titles.select(F.col("id").alias("_sid"), F.col("primary_title").alias("series_title"))
    j = (t.join(e, t["id"] == e["episode_id"])
         .join(series, F.col("parent_series_id") == F.col("_sid")))
    return _with_rating(j, cat).select("id", "primary_title", "start_year", "season_number", "episode_number",
                                       "average_rating", "num_votes", "series_title")


def episode_cast(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """All actors/actresses of each episode with their position by name."""
    eps = restrict(titles_of_type(cat, "tvEpisode", "id"), keys, "id")
    c = credits(cat, ACTING).select("title_id", "person_id", "category", "characters")
    c = c.join(eps, c["title_id"] == eps["id"], "left_semi").join(_people(cat), "person_id")
    return _with_position(c, "title_id", ["name", "person_id", "category"], cat.heavy_titles).select(
        "title_id", "name", "characters", "category", "position")


def person_page(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Name, birth and death year."""
    return restrict(cat.people, keys, "id").select("id", "name", "birth_year", "death_year")


def filmography(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Every credit of each person with title, rating and position on the person's page: by category, the
    newest first (undated last), then title."""
    c = restrict(cat.title_people, keys, "person_id")
    t = cat.titles.select(F.col("id").alias("title_id"), "primary_title", "title_type", "start_year")
    r = cat.ratings.select("title_id", "average_rating")
    j = join_chain(c, "title_id", [(t, "inner"), (r, "left")], cat.heavy_titles, ["person_id"])
    order = ["category", F.col("start_year").desc_nulls_last(), "primary_title", "title_id"]
    return _with_position(j, "person_id", order, cat.heavy_people).select(
        "person_id", "title_id", "primary_title", "title_type", "start_year", "category", "job", "characters",
        "average_rating", "position")
