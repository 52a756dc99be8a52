"""Import from hand-written gzip dumps: scan rules, existence checks, repeats, re-runs."""

from __future__ import annotations

import gzip
import os
from decimal import Decimal

import pytest

from conftest import SF_SMALL
from marquee import registry
from marquee.catalog import compact_catalog, read_catalog, table_writer, write_catalog
from marquee.plans.checks import check_catalog, check_snapshot
from marquee.plans.imports import import_catalog, import_report, import_titles
from marquee.sources import tsv

N = "\\N"


def write(raw_dir: str, spec: tsv.DumpSpec, rows: list[list[str]]) -> None:
    os.makedirs(raw_dir, exist_ok=True)
    with gzip.open(os.path.join(raw_dir, spec.file), "wt", encoding="utf-8", newline="") as f:
        f.write("\t".join(spec.header) + "\n")
        for row in rows:
            f.write("\t".join(row) + "\n")


BASICS = [
    ["tt1", "movie", 'He said "hi', N, "0", "1999", N, "120", "Drama,Comedy"],
    ["tt2", "movie", "", "Orig", "1", "2001", N, N, "Drama"],
    ["tt3", "tvSeries", "Show", N, N, "2005", "2010", "30", N],
    ["tt4", "tvEpisode", "Ep 1", N, "0", "2006", N, "30", "Comedy,"],
    ["tt5", "short", "Short", N, "0", "2000", N, "5", "Drama"],
    ["tt6", "tvMiniSeries", "Mini", N, "0", "2000", N, "50", "Drama"],
    ["tt1", "movie", "Repeat of tt1", N, "0", "1999", N, "120", "Drama"],
]
RATINGS = [["tt1", "7.5", "1500"], ["tt3", "8.1", "700"], ["tt99", "9.9", "10"]]
NAMES = [
    ["nm1", "Ann", "1950", N, "director", N],
    ["nm2", N, "", "", "actor", "tt1"],
    ["nm3", "Bob", "1960", "2020", "writer", N],
]
PRINCIPALS = [
    ["tt1", "2", "nm2", "actor", "second", '["B"]'],
    ["tt1", "1", "nm2", "actor", "first", '["A"]'],
    ["tt1", "3", "nm1", "director", "dir job", N],
    ["tt1", "4", "nm404", "actor", N, N],
    ["tt4", "1", "nm2", "actress", N, '["X"]'],
]
CREW = [
    ["tt1", "nm1,nm404,", "nm3"],
    ["tt3", N, "nm3"],
    ["tt77", "nm1", N],
]
EPISODES = [["tt4", "tt3", "1", "1"], ["tt404", "tt3", "1", "2"], ["tt4x", "tt404", N, N]]


def write_all(raw_dir, basics=BASICS, ratings=RATINGS):
    write(raw_dir, tsv.TITLE_BASICS, basics)
    write(raw_dir, tsv.TITLE_RATINGS, ratings)
    write(raw_dir, tsv.NAME_BASICS, NAMES)
    write(raw_dir, tsv.TITLE_PRINCIPALS, PRINCIPALS)
    write(raw_dir, tsv.TITLE_CREW, CREW)
    write(raw_dir, tsv.TITLE_EPISODE, EPISODES)


@pytest.fixture()
def imported(spark, scratch):
    raw = os.path.join(scratch, "raw")
    write_all(raw)
    return import_catalog(spark, raw, os.path.join(scratch, "snap1")), scratch


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_titles_scan_rules(imported):
    cat, _ = imported
    t = {r["id"]: r for r in cat.titles.collect()}
    assert sorted(t) == ["tt1", "tt2", "tt3", "tt4"]           # short / tvMiniSeries dropped
    assert t["tt1"]["primary_title"] == 'He said "hi'            # a lone quote is data
    assert t["tt2"]["primary_title"] == ""                       # '' stays an empty string
    assert t["tt1"]["original_title"] is None                    # \N is NULL
    assert (t["tt1"]["is_adult"], t["tt2"]["is_adult"], t["tt3"]["is_adult"]) == (False, True, None)
    assert t["tt2"]["runtime_minutes"] is None and t["tt3"]["end_year"] == 2010


def test_ratings_people_and_credits(imported):
    cat, _ = imported
    assert rows(cat.ratings, "title_id", "average_rating", "num_votes") == [
        ("tt1", Decimal("7.5"), 1500), ("tt3", Decimal("8.1"), 700)]
    assert rows(cat.people, "id", "name", "birth_year", "death_year") == [
        ("nm1", "Ann", 1950, None), ("nm2", "(Unknown)", None, None), ("nm3", "Bob", 1960, 2020)]
    assert rows(cat.title_people, "title_id", "person_id", "category", "job", "characters") == [
        ("tt1", "nm1", "director", "dir job", None),   # principal row wins over the crew row
        ("tt1", "nm2", "actor", "first", '["A"]'),    # lowest ordering wins
        ("tt1", "nm3", "writer", None, None),
        ("tt3", "nm3", "writer", None, None),
        ("tt4", "nm2", "actress", None, '["X"]'),
    ]


def test_genres_and_episodes(imported):
    cat, _ = imported
    assert rows(cat.genres, "id", "name") == [(1, "Comedy"), (2, "Drama")]
    assert rows(cat.title_genres, "title_id", "genre_id") == [
        ("tt1", 1), ("tt1", 2), ("tt2", 2), ("tt4", 1)]
    assert rows(cat.episodes, "episode_id", "parent_series_id") == [("tt4", "tt3")]


def test_catalog_checks_are_clean(imported):
    cat, _ = imported
    bad = [r for r in check_catalog(cat).collect() if r["violations"]]
    assert bad == []


def test_reimport_keeps_existing_rows_and_adds_new_ones(spark, imported):
    first, scratch = imported
    raw2 = os.path.join(scratch, "raw2")
    write_all(raw2, basics=BASICS + [["tt8", "movie", "New", N, "0", "2020", N, "90", "Horror"]],
              ratings=[["tt1", "1.0", "5"], ["tt8", "6.0", "20"]])
    second = import_catalog(spark, raw2, os.path.join(scratch, "snap2"), previous=os.path.join(scratch, "snap1"))
    assert rows(second.ratings, "title_id", "average_rating") == [
        ("tt1", Decimal("7.5")), ("tt3", Decimal("8.1")), ("tt8", Decimal("6.0"))]
    assert rows(second.genres, "id", "name") == [(1, "Comedy"), (2, "Drama"), (3, "Horror")]
    # running the same dumps again changes nothing
    third = import_catalog(spark, raw2, os.path.join(scratch, "snap3"), previous=os.path.join(scratch, "snap2"))
    for name, df in second.tables().items():
        assert sorted(df.collect()) == sorted(third.tables()[name].collect()), name


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}


def test_reimport_writes_new_rows_only(spark, imported):
    """The earlier snapshot's files stay as they are, the later one's hold the inserted rows alone, and the
    report of both says what happened to every staged row."""
    _, scratch = imported
    first, second = os.path.join(scratch, "snap1"), os.path.join(scratch, "snap-new")
    before = _files(first)
    raw2 = os.path.join(scratch, "raw-new")
    write_all(raw2, basics=BASICS + [["tt8", "movie", "New", N, "0", "2020", N, "90", "Horror"]],
              ratings=[["tt1", "1.0", "5"], ["tt8", "6.0", "20"], ["tt8", "6.1", "21"], ["tt99", "6.0", "20"]])
    cat = import_catalog(spark, raw2, second, previous=first)
    assert _files(first) == before
    assert [r.id for r in spark.read.parquet(f"{second}/titles").collect()] == ["tt8"]
    assert cat.titles.count() == 5
    report = {(r.table, r.part): tuple(r)[2:] for r in import_report(spark, second).collect()}
    assert report["ratings", 1] == (4, 1, 1, 1, 1)
    assert report["titles", 1][-2:] == (4, 1)
    assert report["genres", 1][-1] == 1 and report["titles", 0][-1] == 4
    assert all(r[0] == sum(r[1:]) for r in report.values() if None not in r)
    whole = compact_catalog(spark, second, os.path.join(scratch, "snap-whole"))
    for name, df in cat.tables().items():
        assert sorted(df.collect()) == sorted(whole.tables()[name].collect()), name


def test_incremental_check_equals_the_full_check(spark, scratch):
    cat = registry.catalog_snapshot(spark, SF_SMALL)
    first, second = registry.faulty_parts(cat)
    a, b, c = (os.path.join(scratch, x) for x in "abc")
    write_catalog(first, a)
    write_catalog(second, b, base=a)
    write_catalog(cat.replace(**{n: df.limit(0) for n, df in cat.tables().items() if n not in ("people", "genres")}),
                  c, base=b)
    for path, base in ((a, None), (b, a), (c, b)):
        got = check_snapshot(spark, path, base).collect()
        wanted = check_catalog(read_catalog(spark, path)).collect()
        assert sorted(got, key=str) == sorted(wanted, key=str)
        assert sum(r.violations > 0 for r in got) >= 4


def test_short_row_fails_loudly(spark, scratch):
    raw = os.path.join(scratch, "bad")
    write_all(raw, basics=BASICS + [["tt9", "movie", "Too short"]])
    with pytest.raises(Exception, match="expected 9 fields"):
        import_catalog(spark, raw, os.path.join(scratch, "out"))


def test_non_integer_year_fails_loudly(spark, scratch):
    raw = os.path.join(scratch, "bad")
    write_all(raw, basics=BASICS + [["tt9", "movie", "Bad year", N, "0", "19x9", N, N, N]])
    with pytest.raises(Exception):
        import_catalog(spark, raw, os.path.join(scratch, "out"))


def test_snapshot_folder_is_never_overwritten(spark, imported):
    _, scratch = imported
    raw = os.path.join(scratch, "raw")
    with pytest.raises(Exception):
        import_catalog(spark, raw, os.path.join(scratch, "snap1"))
    assert read_catalog(spark, os.path.join(scratch, "snap1")).titles.count() == 4


def test_bad_values_fail_without_ansi_too(spark, scratch):
    raw = os.path.join(scratch, "bad")
    write_all(raw, basics=BASICS + [["tt9", "movie", "Bad adult flag", N, "maybe", "1999", N, N, N]])
    previous = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="is_adult is not a valid boolean"):
            import_catalog(spark, raw, os.path.join(scratch, "out"))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", previous)


def test_blank_line_fails_and_a_line_of_tabs_is_a_row(spark, scratch):
    raw = os.path.join(scratch, "tabs")
    write_all(raw)
    write(raw, tsv.TITLE_CREW, CREW + [["", "", ""]])
    assert ("", "", "") in rows(tsv.read_dump(spark, raw, tsv.TITLE_CREW).fillna("-"), "tconst", "directors", "writers")
    bad = os.path.join(scratch, "blank")
    write_all(bad)
    write(bad, tsv.TITLE_CREW, CREW + [[""]] + CREW)
    with pytest.raises(Exception, match="expected 3 fields"):
        import_catalog(spark, bad, os.path.join(scratch, "out"))


def test_any_category_survives_the_snapshot(spark, scratch):
    raw = os.path.join(scratch, "raw")
    write_all(raw)
    names = ["", "~", "~x", "__HIVE_DEFAULT_PARTITION__", "a/b=c"]
    write(raw, tsv.TITLE_PRINCIPALS, PRINCIPALS + [["tt2", "1", "nm1", c, N, N] for c in names])
    cat = import_catalog(spark, raw, os.path.join(scratch, "out"))
    assert sorted(r.category for r in cat.title_people.where("title_id = 'tt2'").collect()) == sorted(names)
    again = import_catalog(spark, raw, os.path.join(scratch, "again"), previous=os.path.join(scratch, "out"))
    assert sorted(again.title_people.collect()) == sorted(cat.title_people.collect())


@pytest.mark.parametrize("open_cost", ["1", "4m", "1g"])
def test_first_row_wins_whatever_the_file_packing(spark, scratch, open_cost):
    raw = os.path.join(scratch, "raw")
    write_all(raw)
    folder = os.path.join(scratch, "raw2")
    write_all(folder, basics=[])
    os.makedirs(os.path.join(folder, "parts"))
    # Spark reads the larger file first when it packs both into one task
    write(os.path.join(folder, "parts"), tsv.TITLE_BASICS, BASICS)
    parts = tsv.DumpSpec("parts/*.gz", tsv.TITLE_BASICS.header, tsv.TITLE_BASICS.columns, tsv.TITLE_BASICS.types)
    late = [["tt1", "movie", f"Late {i * 7919}", N, "0", "1999", N, "1", N] for i in range(500)]
    write(os.path.join(folder, "parts"), tsv.DumpSpec("z.gz", parts.header, parts.columns, parts.types), late)
    previous = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    try:
        titles = import_titles(tsv.read_dump(spark, folder, parts, 8)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", previous)
    assert {t.id: t.primary_title for t in titles}["tt1"] == 'He said "hi'


def test_incomplete_snapshot_is_refused(spark, imported):
    cat, scratch = imported
    path = os.path.join(scratch, "half")
    for name, df in cat.tables().items():
        table_writer(df, name).parquet(f"{path}/{name}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_catalog(spark, path)


def test_null_primary_title_is_refused(spark, scratch):
    raw = os.path.join(scratch, "bad")
    write_all(raw, basics=BASICS + [["tt9", "movie", N, N, "0", "1999", N, N, N]])
    with pytest.raises(Exception, match="primary_title: null value"):
        import_catalog(spark, raw, os.path.join(scratch, "out"))
