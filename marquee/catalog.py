"""The catalogue data model: eight tables as declared Spark schemas, held together as a `Catalog`.

Every job is a function ``(Catalog, args) -> DataFrame``. A Catalog is just eight lazy DataFrames, so a
job only scans the tables (and columns) it touches.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.skew import HeavyKeys

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

TITLES = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("title_type", _S, False),
    T.StructField("primary_title", _S, False),
    T.StructField("original_title", _S),
    T.StructField("start_year", _I),
    T.StructField("end_year", _I),
    T.StructField("runtime_minutes", _I),
    T.StructField("is_adult", _B),
])

TITLE_DETAILS = T.StructType([
    T.StructField("title_id", _S, False),
    T.StructField("production_company", _S),
    T.StructField("alternative_titles", T.ArrayType(_S)),
    T.StructField("languages", T.ArrayType(_S)),
    T.StructField("countries", T.ArrayType(_S)),
])

EPISODES = T.StructType([
    T.StructField("episode_id", _S, False),
    T.StructField("parent_series_id", _S),
    T.StructField("season_number", _I),
    T.StructField("episode_number", _I),
])

PEOPLE = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("name", _S, False),
    T.StructField("birth_year", _I),
    T.StructField("death_year", _I),
])

TITLE_PEOPLE = T.StructType([
    T.StructField("title_id", _S, False),
    T.StructField("person_id", _S, False),
    T.StructField("category", _S, False),
    T.StructField("job", _S),
    T.StructField("characters", _S),
])

GENRES = T.StructType([
    T.StructField("id", _I, False),
    T.StructField("name", _S, False),
])

TITLE_GENRES = T.StructType([
    T.StructField("title_id", _S, False),
    T.StructField("genre_id", _I, False),
])

RATINGS = T.StructType([
    T.StructField("title_id", _S, False),
    T.StructField("average_rating", T.DecimalType(3, 1)),
    T.StructField("num_votes", _I),
])

SCHEMAS = {
    "titles": TITLES,
    "title_details": TITLE_DETAILS,
    "episodes": EPISODES,
    "people": PEOPLE,
    "title_people": TITLE_PEOPLE,
    "genres": GENRES,
    "title_genres": TITLE_GENRES,
    "ratings": RATINGS,
}

# Primary keys (what ON CONFLICT guards in the source system) and foreign keys, used by the
# import's insert-if-absent step and by `check_catalog`.
PRIMARY_KEYS = {
    "titles": ["id"],
    "title_details": ["title_id"],
    "episodes": ["episode_id"],
    "people": ["id"],
    "title_people": ["title_id", "person_id", "category"],
    "genres": ["id"],
    "title_genres": ["title_id", "genre_id"],
    "ratings": ["title_id"],
}

# NOT NULL columns besides the keys (fixed by the source DDL).
NOT_NULL = {"titles": ["title_type", "primary_title"], "people": ["name"], "genres": ["name"]}

FOREIGN_KEYS = [
    # (table, column, referenced table, referenced column)
    ("title_details", "title_id", "titles", "id"),
    ("episodes", "episode_id", "titles", "id"),
    ("episodes", "parent_series_id", "titles", "id"),
    ("title_people", "title_id", "titles", "id"),
    ("title_people", "person_id", "people", "id"),
    ("title_genres", "title_id", "titles", "id"),
    ("title_genres", "genre_id", "genres", "id"),
    ("ratings", "title_id", "titles", "id"),
]

# Title types the import keeps (fixed value of the source system).
TITLE_TYPES = ("movie", "tvSeries", "tvEpisode")


@dataclass(frozen=True)
class Catalog:
    titles: DataFrame
    title_details: DataFrame
    episodes: DataFrame
    people: DataFrame
    title_people: DataFrame
    genres: DataFrame
    title_genres: DataFrame
    ratings: DataFrame

    @cached_property
    def heavy_titles(self) -> HeavyKeys:
        """Titles that hold a large share of all credits, found once per catalogue (see `operators.skew`)."""
        return HeavyKeys(self.title_people.select("title_id"), "title_id")

    @cached_property
    def heavy_people(self) -> HeavyKeys:
        """People who hold a large share of all credits."""
        return HeavyKeys(self.title_people.select("person_id"), "person_id")

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def replace(self, **changes: DataFrame) -> "Catalog":
        return Catalog(**{**self.tables(), **changes})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast a frame to a declared table schema (column order and types)."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def read_table(spark: SparkSession, path: str, folder: str, name: str) -> DataFrame:
    """One folder of a table (declared schema, no inference)."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{folder}")
    return df.select([(_from_folder(F.col(f.name)) if f.name in FREE_FOLDERS.get(name, ()) else F.col(f.name))
                      .alias(f.name) for f in SCHEMAS[name].fields])


# The manifest is written last into a snapshot: the folders of each table, oldest first, and for each
# folder what the import that wrote it counted. A folder without "/" lies in the snapshot itself.
MANIFEST = "manifest"
COUNTS = ("staged", "orphans", "repeated", "known", "inserted")
MANIFEST_SCHEMA = T.StructType([T.StructField("table", _S, False), T.StructField("part", _I, False),
                                T.StructField("folder", _S, False), *[T.StructField(c, T.LongType()) for c in COUNTS]])


def read_manifest(spark: SparkSession, path: str) -> list[tuple]:
    """The manifest rows of a snapshot: a few per table and import. A snapshot without one (a write that
    failed or still runs) is refused: Spark does not find the path."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}").orderBy("table", "part").collect()
    return [tuple(r) for r in rows]


def write_manifest(spark: SparkSession, path: str, counts: dict[str, dict[str, int]] | None = None,
                   base: str | None = None) -> None:
    """Complete the snapshot at `path`: its own folders behind those of the snapshot `base`, if given."""
    rows = [(t, part, folder if "/" in folder else f"{base}/{folder}", *numbers)
            for t, part, folder, *numbers in (read_manifest(spark, base) if base else [])]
    parts = {t: sum(r[0] == t for r in rows) for t in SCHEMAS}
    rows += [(t, parts[t], t, *[(counts or {}).get(t, {}).get(c) for c in COUNTS]) for t in SCHEMAS]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """Load a snapshot written by `write_catalog` or by an import: each table is the union of its folders.
    Filters and column pruning reach every folder's scan."""
    return read_parts(spark, path, 0)


def read_parts(spark: SparkSession, path: str, skip: int) -> Catalog:
    """The catalogue without the first `skip` folders of each table."""
    folders: dict[str, list[str]] = {}
    for table, part, folder, *_ in read_manifest(spark, path):
        if part >= skip:
            folders.setdefault(table, []).append(folder)

    def read(name: str) -> DataFrame:
        parts = [read_table(spark, *(f.rsplit("/", 1) if "/" in f else (path, f)), name) for f in folders[name]]
        return reduce(DataFrame.unionByName, parts)

    return Catalog(**{name: read(name) for name in SCHEMAS})


def compact_catalog(spark: SparkSession, path: str, out: str) -> Catalog:
    """Rewrite a snapshot of many imports as one folder per table."""
    write_catalog(read_catalog(spark, path), out)
    return read_catalog(spark, out)


# Partition columns of the snapshot layout: `titles` by type and credits by category (both a handful
# of values), so the type and role filters of the jobs prune whole folders of the largest tables.
PARTITION_COLUMNS = {"titles": ["title_type"], "title_people": ["category"]}

# A partition folder cannot stand for '' (it comes back as NULL), nor for Hive's name of NULL: such
# values get a mark in front, and so do values that begin with the mark. All others name their folder.
# Only categories are free text; title types are fixed.
FREE_FOLDERS = {"title_people": ["category"]}
FOLDER_MARK, HIVE_NULL = "~", "__HIVE_DEFAULT_PARTITION__"


def _to_folder(value: Column) -> Column:
    marked = value.isin("", HIVE_NULL) | value.startswith(FOLDER_MARK)
    return F.when(marked, F.concat(F.lit(FOLDER_MARK), value)).otherwise(value)


def _from_folder(value: Column) -> Column:
    # reads the partition column alone, so filters on the result still prune folders
    return F.when(value.startswith(FOLDER_MARK), F.substring(value, 2, 1 << 30)).otherwise(value)

# Sort order inside each written file: ratings by votes, so the vote floors of the jobs
# (>= 500 / 1000 / 10000) skip row groups through Parquet min/max statistics.
SORT_COLUMNS = {"ratings": ["num_votes"]}


def table_writer(df: DataFrame, name: str, mode: str = "errorifexists"):
    """DataFrameWriter for one catalogue table in the snapshot layout."""
    out = conform(df, SCHEMAS[name])
    if name in SORT_COLUMNS:
        out = out.sortWithinPartitions(*SORT_COLUMNS[name])
    columns = PARTITION_COLUMNS.get(name, [])
    writer = out.select([(_to_folder(F.col(c)) if c in FREE_FOLDERS.get(name, ()) else F.col(c)).alias(c)
                         for c in out.columns]).write.mode(mode)
    return writer.partitionBy(*columns) if columns else writer


def write_catalog(catalog: Catalog, path: str, mode: str = "errorifexists", base: str | None = None) -> None:
    """Write all eight tables (independent jobs, submitted side by side), as a part on top of the snapshot
    `base`, if given."""
    from .session import run_concurrently

    def write(name: str, df: DataFrame):
        return lambda: table_writer(df, name, mode).parquet(f"{path}/{name}")

    run_concurrently(*[write(name, df) for name, df in catalog.tables().items()])
    write_manifest(catalog.titles.sparkSession, path, base=base)
