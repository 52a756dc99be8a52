"""Registered queries: every job with the parameters it is checked with, on the test-data catalogue.

`queries()` maps a name to `(spark, sf_dir) -> DataFrame`; each runs its job on the catalogue mapped
from the star schema at `sf_dir` and converts the result to plain column types (decimals to double,
arrays to ', '-joined text) so that it can be compared value by value with its SQL twin in
`marquee.oracle`. The mapped catalogue is materialised once per session and input folder
(`catalog_snapshot`), like the snapshot an import leaves behind, and jobs read that snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import oracle
from .oracle import AS_OF_YEAR
from .plans import analysis as A
from .plans import checks as C
from .plans import imports as I
from .plans import listings as L
from .plans import pages as P
from .catalog import SCHEMAS, Catalog, read_catalog, write_catalog
from .session import new_scratch_path
from .sources.dump import detail_rows, write_test_dumps
from .sources.testdata import catalog_from_testdata


def plain_types(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ", ")
        cols.append(c.alias(f.name))
    return df.select(cols)


# Parameterised listings: name -> (job, parameters, SQL twin builder). The parameters are examples of
# what a page request passes; the same values are bound into the SQL twin.
LISTINGS = {
    "movie_listing": (L.movie_listing, dict(genre="PROMO", min_rating=6.0, sort="rating", limit=50, offset=10),
                      oracle.movie_listing_sql),
    "movie_listing_by_title": (L.movie_listing, dict(year=1992, adult=False, sort="title", limit=20),
                               oracle.movie_listing_sql),
    "series_listing": (L.series_listing, dict(start_year=1950, end_year=2020, min_seasons=2, sort="year",
                                               limit=25, offset=5), oracle.series_listing_sql),
    "series_listing_by_rating": (L.series_listing, dict(genre="SMALL", min_rating=7.0, sort="rating", limit=20),
                                 oracle.series_listing_sql),
    "movie_listing_plain": (L.movie_listing, dict(sort=None, limit=30), oracle.movie_listing_sql),
    "movie_listing_by_year": (L.movie_listing, dict(min_rating=5.5, sort="year", limit=25, offset=40),
                              oracle.movie_listing_sql),
    "movie_listing_deep": (L.movie_listing, dict(sort="title", limit=20, offset=450), oracle.movie_listing_sql),
    "series_listing_by_title": (L.series_listing, dict(sort="title", limit=20, offset=3), oracle.series_listing_sql),
    "series_listing_adult": (L.series_listing, dict(adult=True, sort="rating", limit=20), oracle.series_listing_sql),
    "featured_adult_series": (L.featured_series, dict(adult=True),
                              lambda **kw: oracle.featured_sql("tvSeries", 500, adult=True)),
    "featured_movies": (L.featured_movies, {}, lambda **kw: oracle.featured_sql("movie", 1000)),
    "featured_adult_movies": (L.featured_movies, dict(adult=True),
                              lambda **kw: oracle.featured_sql("movie", 1000, adult=True)),
    "featured_series": (L.featured_series, {}, lambda **kw: oracle.featured_sql("tvSeries", 500)),
    "search": (L.search, dict(term="title 99"), oracle.search_sql),
    "search_people": (L.search, dict(term="RSON 12"), oracle.search_sql),
    "search_backslash": (L.search, dict(term="tit\\le 12"), oracle.search_sql),
    "search_wildcard": (L.search, dict(term="1_3", adult=False), oracle.search_sql),
}

# name -> (job, keyword arguments)
JOBS: dict[str, tuple[Callable[..., DataFrame], dict]] = {
    "rating_by_decade": (A.rating_by_decade, {}),
    "genre_by_decade": (A.genre_by_decade, {}),
    "director_performance": (A.director_performance, {}),
    "actor_best_genre": (A.actor_best_genre, {}),
    "genre_popularity": (A.genre_popularity, {}),
    "collaborations": (A.collaborations, {}),
    "genre_pairs": (A.genre_pairs, {}),
    "success_profile": (A.success_profile, {}),
    "series_longevity": (A.series_longevity, {"as_of_year": AS_OF_YEAR}),
    "long_running_series": (A.long_running_series, {"as_of_year": AS_OF_YEAR}),
    "series_longevity_today": (A.series_longevity, {}),
    "long_running_series_today": (A.long_running_series, {}),
    "career_trajectory": (A.career_trajectory, {}),
    "movies_since_last_hit": (A.movies_since_last_hit, {}),
    "genre_performance": (A.genre_performance, {}),
    "most_voted": (A.most_voted, {}),
    "dashboard": (A.dashboard, {}),
    "rating_rollup": (A.rating_rollup, {}),
    "next_decade_change": (A.next_decade_change, {}),
    # pages (every key in one pass)
    "movie_summary": (P.movie_summary, {}),
    "movie_top_cast": (P.movie_top_cast, {}),
    "movie_details": (P.movie_details, {}),
    "cast_crew": (P.cast_crew, {}),
    "series_summary": (P.series_summary, {}),
    "series_top_cast": (P.series_top_cast, {}),
    "season_breakdown": (P.season_breakdown, {}),
    "episode_page": (P.episode_page, {}),
    "episode_cast": (P.episode_cast, {}),
    "person_page": (P.person_page, {}),
    "filmography": (P.filmography, {}),
    # listings, featured, search, filter support
    **{name: (job, params) for name, (job, params, _) in LISTINGS.items()},
    "genre_options": (L.genre_options, {}),
    "year_range": (L.year_range, {}),
}


def catalog_rows(cat: Catalog) -> DataFrame:
    """Every table as (table_name, row text), for comparing whole catalogues."""
    parts = []
    for name, df in cat.tables().items():
        cols = []
        for f in SCHEMAS[name].fields:
            c = F.col(f.name)
            c = F.array_join(c, ", ") if isinstance(f.dataType, T.ArrayType) else c.cast("string")
            cols.append(F.coalesce(c, F.lit("\\N")))
        parts.append(df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *cols).alias("row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DUMPS: dict[tuple[str, str, int | None], str] = {}


def _test_dumps(spark: SparkSession, sf_dir: str, edition: int | None = None) -> str:
    """Raw dumps derived from the test tables, written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, edition)
    if key not in _DUMPS:
        raw = new_scratch_path(spark, "dumps")
        write_test_dumps(spark, sf_dir, raw, edition)
        _DUMPS[key] = raw
    return _DUMPS[key]


def import_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1-I9 + I11: import the raw dumps derived from the test tables into a new snapshot, return it."""
    raw = _test_dumps(spark, sf_dir)
    snapshot = I.import_catalog(spark, raw, new_scratch_path(spark, "snapshot"),
                                details=detail_rows(spark, sf_dir))
    return catalog_rows(snapshot)


def reimport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I11 again over an existing snapshot: known rows that changed, repeated rows and new rows."""
    first = new_scratch_path(spark, "snapshot")
    I.import_catalog(spark, _test_dumps(spark, sf_dir, 1), first, details=detail_rows(spark, sf_dir))
    snapshot = I.import_catalog(spark, _test_dumps(spark, sf_dir, 2), new_scratch_path(spark, "snapshot"),
                                previous=first, details=detail_rows(spark, sf_dir))
    return catalog_rows(snapshot)


def faulty_parts(cat: Catalog) -> tuple[Catalog, Catalog]:
    """Two parts of a catalogue with violations of every kind: the second resolves some of the first's
    references, repeats some of its keys, and brings rows without a name and a title type too long."""
    ends = lambda c, *x: F.substring(c, -len(x[0]), len(x[0])).isin(*x)
    empty = {name: df.limit(0) for name, df in cat.tables().items()}
    first = cat.replace(titles=cat.titles.where(~ends("id", "5", "7")), people=cat.people.where(~ends("id", "3")),
                        genres=cat.genres.where("id > 1"), title_genres=cat.title_genres.where(~ends("title_id", "9")))
    titles = cat.titles.where(ends("id", "7")).unionByName(cat.titles.where(ends("id", "11"))).unionByName(
        cat.titles.where(ends("id", "15")).withColumn("title_type", F.lit("a title type of over 20")))
    people = cat.people.where(ends("id", "13")).withColumn("name", F.lit(None).cast("string"))
    second = Catalog(**empty).replace(
        titles=titles, people=people, ratings=cat.ratings.where(ends("title_id", "22")),
        genres=cat.genres.where("id = 2").withColumn("id", F.lit(None).cast("int")),
        title_genres=cat.title_genres.where(ends("title_id", "9")))
    return first, second


def check_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I10 on a snapshot of two parts with violations: the second part checked on top of the first's state."""
    first, second = faulty_parts(catalog_snapshot(spark, sf_dir))
    base, path = new_scratch_path(spark, "faulty"), new_scratch_path(spark, "faulty")
    write_catalog(first, base)
    C.check_snapshot(spark, base)
    write_catalog(second, path, base=base)
    return plain_types(C.check_snapshot(spark, path, base))


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def catalog_snapshot(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue mapped from the test tables, written once per session and input folder as a
    Parquet snapshot in the shared scratch folder (as the import would leave it), then read back.
    Jobs then read catalogue tables, not the star schema, as they would in production."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        path = new_scratch_path(spark, "catalog")
        write_catalog(catalog_from_testdata(spark, sf_dir), path)
        _CATALOGS[key] = read_catalog(spark, path)
    return _CATALOGS[key]


def _run(job: Callable[..., DataFrame], kwargs: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_types(job(catalog_snapshot(spark, sf_dir), **kwargs))


def search_many_prefixes(cat: Catalog) -> DataFrame:
    """W16 in batch: the first eight characters of every title are the terms."""
    terms = cat.titles.select(F.substring("primary_title", 1, 8).alias("term")).distinct()
    return plain_types(L.search_many(cat, terms))


def search_many_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_many_prefixes(catalog_snapshot(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(_run, job, kwargs) for name, (job, kwargs) in JOBS.items()}
    out["check_catalog"] = partial(_run, C.check_catalog, {})
    out["check_incremental"] = check_again
    out["import_catalog"] = import_roundtrip
    out["reimport_catalog"] = reimport
    out["search_many"] = search_many_titles
    return out


def oracle_sql() -> dict[str, str]:
    statements = {**oracle.ANALYSIS, **oracle.PAGES}
    statements.update({name: build(**params) for name, (_, params, build) in LISTINGS.items()})
    statements["check_catalog"] = oracle.check_catalog_sql()
    statements["search_many"] = oracle.search_many_sql()
    statements["check_incremental"] = oracle.check_catalog_sql(oracle.FAULTY)
    statements["import_catalog"] = oracle.catalog_rows_sql()
    statements["reimport_catalog"] = oracle.catalog_rows_sql(oracle.REIMPORTED)
    return {name: statements[name] for name in queries() if name in statements}
