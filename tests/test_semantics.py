"""Edge cases of the job semantics on hand-written catalogues (nulls, ties, labels, wildcards)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import d, make_catalog, movie
from marquee.plans import analysis as A
from marquee.plans import listings as L
from marquee.plans import pages as P


def test_movie_without_rating_genre_or_cast_gets_nulls_not_empty_strings(spark):
    cat = make_catalog(spark, titles=[movie(1)])
    row = P.movie_summary(cat).collect()[0]
    assert row["directors"] is None and row["writers"] is None and row["genres"] is None
    assert row["average_rating"] is None


def test_string_lists_are_distinct_and_sorted(spark):
    cat = make_catalog(
        spark, titles=[movie(1)],
        people=[("nm1", "Zed", None, None), ("nm2", "Amy", None, None), ("nm3", "Amy", None, None)],
        title_people=[("tt1", "nm1", "director", None, None), ("tt1", "nm2", "director", None, None),
                      ("tt1", "nm3", "director", None, None), ("tt1", "nm1", "writer", None, None)],
        genres=[(1, "Drama"), (2, "Action")], title_genres=[("tt1", 1), ("tt1", 2)])
    row = P.movie_summary(cat).collect()[0]
    assert row["directors"] == "Amy, Zed"
    assert row["writers"] == "Zed"
    assert row["genres"] == "Action, Drama"


def test_director_with_all_films_in_one_year_is_stable(spark):
    titles = [movie(i, year=2001) for i in range(5)]
    ratings = [(f"tt{i}", d(5 + i), 500) for i in range(5)]
    credits = [(f"tt{i}", "nm1", "director", None, None) for i in range(5)]
    cat = make_catalog(spark, titles=titles, ratings=ratings, title_people=credits,
                       people=[("nm1", "Solo", 1950, None)])
    row = A.director_performance(cat).collect()[0]
    assert row["career_trajectory"] == "Stable"
    assert row["career_length"] == 1 and row["rating_rank"] == 1 and row["productivity_rank"] == 1


def test_slope_labels_at_and_beyond_the_threshold(spark):
    # ratings rise 0.1 per year -> slope 0.1 -> Improving; fall 0.1 per year -> Declining;
    # rise 0.1 every two years -> slope exactly 0.05 -> Stable (strict comparison)
    def career(person, start, step_years, delta):
        titles = [movie(f"{person}{i}", year=start + i * step_years) for i in range(5)]
        ratings = [(f"tt{person}{i}", d(round(6 + i * delta, 1)), 500) for i in range(5)]
        credits = [(f"tt{person}{i}", person, "director", None, None) for i in range(5)]
        return titles, ratings, credits
    parts = [career("nmA", 1990, 1, 0.1), career("nmB", 1990, 1, -0.1), career("nmC", 1990, 2, 0.1)]
    cat = make_catalog(spark, titles=sum((p[0] for p in parts), []), ratings=sum((p[1] for p in parts), []),
                       title_people=sum((p[2] for p in parts), []),
                       people=[("nmA", "A", None, None), ("nmB", "B", None, None), ("nmC", "C", None, None)])
    labels = {r["name"]: r["career_trajectory"] for r in A.director_performance(cat).collect()}
    assert labels == {"A": "Improving", "B": "Declining", "C": "Stable"}


def test_rounding_ties_go_away_from_zero(spark):
    # decade 2000: 7.1, 7.1, 7.1, 7.2 -> mean 7.125 -> 7.13; decade 2010: 7.0 -> change -0.125 -> -0.13
    titles = [movie(i, year=2001) for i in range(4)] + [movie(9, year=2011)]
    ratings = [(f"tt{i}", d(r), 200) for i, r in enumerate([7.1, 7.1, 7.1, 7.2])] + [("tt9", d(7.0), 200)]
    rows = {r["decade"]: r for r in A.rating_by_decade(make_catalog(spark, titles=titles, ratings=ratings)).collect()}
    assert rows[2000]["average_rating"] == 7.13
    assert rows[2000]["median_rating"] == 7.1
    assert rows[2010]["rating_change"] == -0.13
    assert rows[2010]["prev_decade_rating"] == 7.125


def test_unrated_genre_pair_sorts_first_and_counts(spark):
    titles = [movie(1), movie(2), movie(3)]
    ratings = [("tt1", d(8.0), 10)]
    cat = make_catalog(spark, titles=titles, ratings=ratings, genres=[(1, "A"), (2, "B"), (3, "C")],
                       title_genres=[("tt1", 1), ("tt1", 2), ("tt2", 2), ("tt2", 3), ("tt3", 2), ("tt3", 3)])
    rows = A.genre_pairs(cat, min_count=1).collect()
    assert [(r["genre1"], r["genre2"], r["combination_count"], r["avg_rating"]) for r in rows] == [
        ("B", "C", 2, None), ("A", "B", 1, 8.0)]
    assert [r["success_rank"] for r in rows] == [1, 2]


def test_null_start_year_is_last_in_a_career(spark):
    titles = [movie(1, year=None), movie(2, year=1990), movie(3, year=1980)]
    ratings = [(f"tt{i}", d(r), 500) for i, r in [(1, 9.0), (2, 6.0), (3, 8.0)]]
    credits = [(f"tt{i}", "nm1", "director", None, None) for i in (1, 2, 3)]
    cat = make_catalog(spark, titles=titles, ratings=ratings, title_people=credits,
                       people=[("nm1", "Dir", None, None)])
    rows = A.career_trajectory(cat, min_movies=1).collect()
    assert [(r["start_year"], r["career_movie_number"], r["peak_so_far"]) for r in rows] == [
        (1980, 1, 8.0), (1990, 2, 8.0), (None, 3, 9.0)]
    assert [r["running_avg"] for r in rows] == [8.0, 7.0, 7.67]


def test_movies_since_last_hit_islands(spark):
    seq = [6.0, 8.0, 6.0, 6.0, 9.0, 5.0]
    titles = [movie(i, year=2000 + i) for i in range(len(seq))]
    ratings = [(f"tt{i}", d(r), 500) for i, r in enumerate(seq)]
    credits = [(f"tt{i}", "nm1", "director", None, None) for i in range(len(seq))]
    cat = make_catalog(spark, titles=titles, ratings=ratings, title_people=credits)
    rows = A.movies_since_last_hit(cat).orderBy("start_year").collect()
    assert [r["movies_since_last_hit"] for r in rows] == [1, 1, 2, 3, 1, 2]


def test_namesake_directors_are_merged_by_name(spark):
    titles = [movie(i, year=2000 + i) for i in range(4)]
    ratings = [(f"tt{i}", d(8.0), 500) for i in range(4)]
    credits = [("tt0", "nm1", "director", None, None), ("tt1", "nm1", "director", None, None),
               ("tt2", "nm2", "director", None, None), ("tt3", "nm2", "director", None, None)]
    cat = make_catalog(spark, titles=titles, ratings=ratings, title_people=credits,
                       people=[("nm1", "Same Name", None, None), ("nm2", "Same Name", None, None)])
    # 2 + 2 movies under one name reach the threshold of 4 together
    rows = A.career_trajectory(cat, min_movies=4).collect()
    assert len(rows) == 4 and {r["person_id"] for r in rows} == {"nm1", "nm2"}


def test_actor_and_actress_on_one_title_count_twice(spark):
    titles = [movie(1)]
    cat = make_catalog(spark, titles=titles, ratings=[("tt1", d(7.0), 500)],
                       title_people=[("tt1", "nm1", "actor", None, None), ("tt1", "nm1", "actress", None, None)],
                       people=[("nm1", "Both", None, None)], genres=[(1, "Drama")], title_genres=[("tt1", 1)])
    row = A.actor_best_genre(cat, min_movies=2).collect()[0]
    assert row["total_movies"] == 2 and row["movies_in_best_genre"] == 2


def test_series_without_episodes(spark):
    titles = [movie(1, kind="tvSeries", year=2000), movie(2, kind="tvSeries", year=2000),
              movie(3, kind="tvEpisode", year=2001)]
    cat = make_catalog(spark, titles=titles, ratings=[("tt1", d(8.0), 600), ("tt2", d(8.0), 600)],
                       episodes=[("tt3", "tt2", None, 1)])
    summary = {r["id"]: r for r in P.series_summary(cat).collect()}
    assert (summary["tt1"]["season_count"], summary["tt1"]["episode_count"]) == (0, 0)
    assert (summary["tt2"]["season_count"], summary["tt2"]["episode_count"]) == (0, 1)
    # neither series has a numbered season, so the longevity analysis drops both
    assert A.series_longevity(cat, as_of_year=2025).count() == 0


def test_search_keeps_like_wildcards_and_is_case_blind(spark):
    titles = [movie(1, title="100% Love"), movie(2, title="1000 Loves"), movie(3, title="A_B"),
              movie(4, title="AxB")]
    cat = make_catalog(spark, titles=titles, people=[("nm1", "LOVE Person", None, None)])
    names = [r["name"] for r in L.search(cat, "0%l").collect()]
    assert names == ["100% Love", "1000 Loves"]  # '%' matches anything
    assert sorted(r["name"] for r in L.search(cat, "a_b").collect()) == ["A_B", "AxB"]
    assert [r["result_type"] for r in L.search(cat, "love").collect()] == ["person", "title", "title"]


def test_search_adult_filter_guards_both_title_columns(spark):
    titles = [movie(1, title="Night", adult=True), movie(2, title="Day", original="Night", adult=True),
              movie(3, title="Night Two")]
    cat = make_catalog(spark, titles=titles)
    assert [r["id"] for r in L.search(cat, "night", adult=False).collect()] == ["tt3"]


def test_search_many_matches_single_searches(spark):
    titles = [movie(i, title=f"Title {i}") for i in range(30)]
    cat = make_catalog(spark, titles=titles, people=[("nm1", "Title Holder", None, None)])
    terms = spark.createDataFrame([("title 1",), ("2",)], "term string")
    batch = L.search_many(cat, terms, limit=5)
    for term in ("title 1", "2"):
        single = [r["id"] for r in L.search(cat, term, limit=5).collect()]
        got = [r["id"] for r in batch.where(F.col("term") == term).orderBy("rank").collect()]
        assert got == single


def test_batch_page_for_one_key_equals_the_full_page(spark):
    from conftest import SF_SMALL
    from marquee.sources.testdata import catalog_from_testdata
    cat = catalog_from_testdata(spark, SF_SMALL)
    full = {r["id"]: r for r in P.movie_summary(cat).collect()}
    key = sorted(full)[7]
    keys = spark.createDataFrame([(key,)], "id string")
    one = P.movie_summary(cat, keys=keys).collect()
    assert len(one) == 1 and one[0] == full[key]


def test_listing_pages_concatenate_to_the_whole_list(spark):
    from conftest import SF_SMALL
    from marquee.sources.testdata import catalog_from_testdata
    cat = catalog_from_testdata(spark, SF_SMALL)
    whole = [r["id"] for r in L.movie_listing(cat, genre="PROMO", sort="year", limit=10_000).collect()]
    paged = []
    for offset in range(0, len(whole), 37):
        paged += [r["id"] for r in L.movie_listing(cat, genre="PROMO", sort="year", limit=37, offset=offset).collect()]
    assert paged == whole and len(whole) > 37


def test_check_catalog_reports_each_kind_of_violation(spark):
    from marquee.plans.checks import check_catalog
    titles = [movie(1), movie(1, title="dup"), movie(2, kind="x" * 21)]
    cat = make_catalog(
        spark, titles=titles, people=[("nm1", "P", None, None)],
        title_people=[("tt1", "nm1", "director", None, None), ("tt9", "nm404", "actor", None, None)],
        genres=[(1, "Drama"), (2, "Drama")], title_genres=[("tt1", 3)],
        ratings=[("tt404", d(5.0), 1)], episodes=[("tt2", "tt77", 1, 1)])
    found = {(r["table"], r["rule"]): (r["violations"], r["sample"]) for r in check_catalog(cat).collect()
             if r["violations"]}
    assert found == {
        ("titles", "primary key (id) unique"): (1, "tt1"),
        ("titles", "length(title_type) <= 20"): (1, "tt2"),
        ("genres", "(name) unique"): (1, "Drama"),
        ("episodes", "parent_series_id references titles(id)"): (1, "tt2"),
        ("title_people", "title_id references titles(id)"): (1, "tt9|nm404|actor"),
        ("title_people", "person_id references people(id)"): (1, "tt9|nm404|actor"),
        ("title_genres", "genre_id references genres(id)"): (1, "tt1|3"),
        ("ratings", "title_id references titles(id)"): (1, "tt404"),
    }


PAGE_KEYS = {"movie_summary": "id", "movie_top_cast": "title_id", "movie_details": "id", "cast_crew": "title_id",
             "series_summary": "id", "series_top_cast": "title_id", "season_breakdown": "parent_series_id",
             "episode_page": "id", "episode_cast": "title_id", "person_page": "id", "filmography": "person_id"}


@pytest.mark.parametrize("name", sorted(PAGE_KEYS))
def test_pages_for_some_keys_equal_the_batch_rows(spark, name):
    from conftest import SF_SMALL
    from marquee.registry import catalog_snapshot
    cat = catalog_snapshot(spark, SF_SMALL)
    job, key = getattr(P, name), PAGE_KEYS[name]
    full = job(cat).collect()
    chosen = sorted({r[key] for r in full})[::max(1, len(full) // 3)][:3]
    keys = spark.createDataFrame([(k,) for k in chosen], "id string")
    some = job(cat, keys=keys).collect()
    assert chosen and sorted(some) == sorted(r for r in full if r[key] in chosen)
