"""Listing, featured, search and filter-support jobs.

Optional filters are added only when their argument is given, so they never reach the plan as
`NULL IS NULL OR ...`. Sorted pages are found by counting where the offset is deep (see `operators.order`),
and the per-title genre list is built for the page rows only.
"""

from __future__ import annotations

import re

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.columns import string_list
from ..operators.grams import GramIndex
from ..operators.order import ascending, descending, page, page_after, sort_key
from ..operators.topk import top_k, top_k_per_key
from ..session import scratch_dir
from .common import genre_names, season_episode_counts, titles_of_type

R = "average_rating"
TITLE_TEXTS = ["primary_title", "original_title"]
PERSON_TEXTS = ["name"]


def _sort_keys(sort: str | None) -> list[Column]:
    """The parameter-chosen sort key, then votes, then id (a total order for stable paging)."""
    first = {
        "rating": [F.col(R).desc_nulls_last()],
        "year": [F.col("start_year").desc_nulls_last()],
        "title": [F.col("primary_title").asc_nulls_last()],
    }.get(sort, [])
    return first + [F.col("num_votes").desc_nulls_last(), F.col("id").asc()]


def listing_key(sort: str | None) -> Column:
    """The same order as one ascending key. Collected from a page's last row, it is where the next page
    starts (`after`)."""
    first = {"rating": [descending(R)], "year": [descending("start_year")], "title": [ascending("primary_title")]}
    return sort_key(*first.get(sort, []), descending("num_votes"), ascending("id"))


def _page(rows: DataFrame, sort: str | None, limit: int, offset: int, after: Row | None) -> DataFrame:
    """A page computed once (at most `limit` rows), whatever the offset (see `operators.order`)."""
    scratch_dir(rows.sparkSession)
    key = listing_key(sort)
    rows = page(rows, key, limit, offset) if after is None else page_after(rows, key, after, limit)
    return rows.checkpoint(eager=True)


def _with_genre(df: DataFrame, cat: Catalog, genre: str | None) -> DataFrame:
    if genre is None:
        return df
    having = genre_names(cat).where(F.col("genre") == genre).select("title_id")
    return df.join(having, df["id"] == having["title_id"], "left_semi")


def _rated(df: DataFrame, cat: Catalog, min_rating) -> DataFrame:
    r = cat.ratings.select(F.col("title_id").alias("_rid"), R, "num_votes")
    j = df.join(r, df["id"] == r["_rid"], "left").drop("_rid")
    if min_rating is not None:
        j = j.where(F.col(R) >= F.lit(Decimal(str(min_rating))))
    return j


def _page_genres(page: DataFrame, cat: Catalog) -> DataFrame:
    ids = page.select(F.col("id").alias("_pid"))
    names = genre_names(cat)
    lists = (names.join(F.broadcast(ids), names["title_id"] == ids["_pid"], "left_semi")
             .groupBy("title_id").agg(string_list(F.col("genre")).alias("genres")))
    return page.join(lists, page["id"] == lists["title_id"], "left").drop("title_id")


def movie_listing(cat: Catalog, year: int | None = None, genre: str | None = None, min_rating=None,
                  adult: bool | None = None, sort: str | None = "rating", limit: int = 20,
                  offset: int = 0, after: Row | None = None) -> DataFrame:
    """Filtered, sorted, paged movie list; by offset, or behind the row whose `listing_key` is `after`."""
    t = titles_of_type(cat, "movie", "id", "primary_title", "start_year", "runtime_minutes", "is_adult")
    if year is not None:
        t = t.where(F.col("start_year") == year)
    if adult is not None:
        t = t.where(F.col("is_adult") == adult)
    t = _rated(_with_genre(t, cat, genre), cat, min_rating)
    rows = _page(t, sort, limit, offset, after)
    return _page_genres(rows, cat).orderBy(*_sort_keys(sort)).select(
        "id", "primary_title", "start_year", "runtime_minutes", R, "num_votes", "genres")


def _with_seasons(series: DataFrame, counts: DataFrame) -> DataFrame:
    counts = counts.select(F.col("parent_series_id").alias("_sid"), "season_count")
    return (series.join(counts, series["id"] == counts["_sid"], "left").drop("_sid")
            .withColumn("season_count", F.coalesce("season_count", F.lit(0))))


def series_listing(cat: Catalog, start_year: int | None = None, end_year: int | None = None,
                   genre: str | None = None, min_rating=None, adult: bool | None = None,
                   min_seasons: int | None = None, sort: str | None = "rating", limit: int = 20,
                   offset: int = 0, after: Row | None = None) -> DataFrame:
    """Filtered, sorted, paged series list with numbered-season counts; `offset` and `after` as above.

    Seasons are counted before the page is cut only where they decide (`min_seasons`)."""
    t = titles_of_type(cat, "tvSeries", "id", "primary_title", "start_year", "end_year", "is_adult")
    if start_year is not None:
        t = t.where(F.col("start_year") >= start_year)
    if end_year is not None:
        t = t.where((F.col("end_year") <= end_year) | F.col("end_year").isNull())
    if adult is not None:
        t = t.where(F.col("is_adult") == adult)
    t = _rated(_with_genre(t, cat, genre), cat, min_rating)
    if min_seasons is None:
        rows = _page(t, sort, limit, offset, after)
        rows = _with_seasons(rows, season_episode_counts(cat, rows.select("id")))
    else:
        t = _with_seasons(t, season_episode_counts(cat)).where(F.col("season_count") >= min_seasons)
        rows = _page(t, sort, limit, offset, after)
    return _page_genres(rows, cat).orderBy(*_sort_keys(sort)).select(
        "id", "primary_title", "start_year", "end_year", R, "num_votes", "season_count", "genres")


def _featured(cat: Catalog, title_type: str, adult: bool | None, min_votes: int, k: int) -> DataFrame:
    t = titles_of_type(cat, title_type, "id", "primary_title", "start_year", "is_adult")
    if adult is not None:
        t = t.where(F.col("is_adult") == adult)
    r = cat.ratings.where(F.col("num_votes") >= min_votes)
    j = t.join(r, t["id"] == r["title_id"])
    best = top_k(j, [F.col(R).desc_nulls_first(), F.col("num_votes").desc_nulls_first(), F.col("id").asc()], k)
    return best.select("id", "primary_title", "start_year", R, "num_votes",
                       F.lit(title_type).alias("content_type"))


def featured_movies(cat: Catalog, adult: bool | None = None, min_votes: int = 1000, k: int = 10) -> DataFrame:
    """Best-rated well-voted movies."""
    return _featured(cat, "movie", adult, min_votes, k)


def featured_series(cat: Catalog, adult: bool | None = None, min_votes: int = 500, k: int = 10) -> DataFrame:
    """Best-rated well-voted series."""
    return _featured(cat, "tvSeries", adult, min_votes, k)


def _search_order() -> list[Column]:
    title_rating = F.when(F.col("result_type") == "title", F.col(R))
    return [F.col("result_type").asc(), title_rating.desc_nulls_last(), F.col("name").asc(), F.col("id").asc()]


def _search_rows(cat: Catalog, title_match: Column, person_match: Column, adult: bool | None,
                 extra: list[str] = ()) -> DataFrame:
    titles = cat.titles.where(title_match)
    if adult is not None:
        titles = titles.where(F.col("is_adult") == adult)
    r = cat.ratings.select(F.col("title_id").alias("_rid"), R)
    t = titles.join(r, titles["id"] == r["_rid"], "left").select(
        *extra, F.lit("title").alias("result_type"), "id", F.col("primary_title").alias("name"), "title_type",
        "start_year", F.col(R), F.lit(None).cast("int").alias("birth_year"))
    p = cat.people.where(person_match).select(
        *extra, F.lit("person").alias("result_type"), "id", "name", F.lit(None).cast("string").alias("title_type"),
        F.lit(None).cast("int").alias("start_year"), F.lit(None).cast("decimal(3,1)").alias(R), "birth_year")
    return t.unionByName(p)


def like_pattern(term: str) -> str:
    """LIKE pattern for "contains `term`": wildcards stay live; a backslash takes the character after it
    literally, whatever it is (only an escaped wildcard or backslash keeps its backslash)."""
    return "%" + re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], term + "%", flags=re.S)


def search(cat: Catalog, term: str, adult: bool | None = None, limit: int | None = 50) -> DataFrame:
    """Case-blind substring search over titles (primary or original) and people.

    `term` keeps its LIKE wildcards (`%`, `_`) as in the source. The adult filter applies to the
    title branch as a whole.
    """
    pattern = like_pattern(term)
    rows = _search_rows(cat, F.col("primary_title").ilike(pattern) | F.col("original_title").ilike(pattern),
                        F.col("name").ilike(pattern), adult)
    return top_k(rows, _search_order(), limit) if limit is not None else rows


def search_index(cat: Catalog, terms: DataFrame) -> GramIndex:
    """The gram index of the search terms (column `term`) over titles and people."""
    # as in like_pattern(): only an escaped wildcard or backslash keeps its backslash
    escaped = F.regexp_replace(F.concat("term", F.lit("%")), r"(?s)(?<!\\)((?:\\\\)*)\\([^%_\\])", "$1$2")
    patterns = (terms.select("term").where(F.col("term").isNotNull()).distinct()
                .withColumn("pattern", F.concat(F.lit("%"), escaped)))
    return GramIndex(patterns, [(cat.titles, TITLE_TEXTS), (cat.people, PERSON_TEXTS)])


def search_many(cat: Catalog, terms: DataFrame, adult: bool | None = None, limit: int = 50) -> DataFrame:
    """W16 in batch: one ranked result list per term of `terms` (column `term`), any number of terms.

    Every term joins the titles and people on its rarest gram (see `operators.grams`), and the full pattern
    is checked on those candidates. The top `limit` per term come from a group-limited window.
    """
    index = search_index(cat, terms)
    cat2 = cat.replace(titles=index.matches(cat.titles, TITLE_TEXTS), people=index.matches(cat.people, PERSON_TEXTS))
    rows = _search_rows(cat2, F.lit(True), F.lit(True), adult, extra=["term"])
    return top_k_per_key(rows, ["term"], _search_order(), limit, name="rank")


def genre_options(cat: Catalog) -> DataFrame:
    """Genres by name."""
    return cat.genres.select("id", "name").orderBy("name")


def year_range(cat: Catalog) -> DataFrame:
    """First and last start year."""
    return cat.titles.where(F.col("start_year").isNotNull()).agg(
        F.min("start_year").alias("min_year"), F.max("start_year").alias("max_year"))
