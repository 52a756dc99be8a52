"""Analysis jobs over the catalogue: trends, careers, pairings, profiles, series longevity.

Each job is `(Catalog, parameters) -> DataFrame` built from joins, partial/final aggregations and
windows; no action runs inside a job except the checkpoint of the distributed ranking operator.
Conventions (see `marquee.functions.columns`): rating means are exact sums over counts, rounding is
half away from zero, null order is always stated, and ties are broken by ids so that every LIMIT and
every rank is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.columns import (decade, mean, mean_at_least, ratio_pct, round_dec, round_half_up,
                                 stddev, stddev_at_most, string_list)
from ..operators.order import ascending, descending, sort_key, with_ranks
from ..operators.pairs import threshold_pairs
from ..operators.position import with_ntile
from ..operators.running import running_aggregates
from ..operators.skew import join_chain
from ..operators.topk import top_k, top_k_per_key, top_k_table
from .common import ACTING, credits, genre_names, ratings_at_least, season_episode_counts, titles_of_type

def R() -> F.Column:
    return F.col("average_rating")


def _decade_stats(cat: Catalog, min_year: int, min_votes: int) -> DataFrame:
    t = cat.titles.where(F.col("start_year").isNotNull() & (F.col("start_year") >= min_year))
    j = t.select("id", "title_type", "start_year").join(
        ratings_at_least(cat, min_votes).select("title_id", "average_rating", "num_votes"),
        F.col("id") == F.col("title_id"))
    return j.groupBy(decade("start_year").alias("decade"), "title_type").agg(
        mean(R()).alias("avg_rating"),
        F.count(F.lit(1)).alias("title_count"),
        F.sum("num_votes").cast("bigint").alias("total_votes"),
        F.percentile(R().cast("double"), F.lit(0.5)).alias("median_raw"),
    )


def rating_by_decade(cat: Catalog, min_year: int = 1920, min_votes: int = 100) -> DataFrame:
    """A1: per decade and title type: mean, count, votes, exact median; change vs previous decade."""
    g = _decade_stats(cat, min_year, min_votes)
    w = Window.partitionBy("title_type").orderBy("decade")
    prev = F.lag("avg_rating").over(w)
    return g.select(
        "decade", "title_type",
        round_half_up(F.col("avg_rating"), 2).alias("average_rating"),
        "title_count", "total_votes",
        round_half_up(F.col("median_raw"), 2).alias("median_rating"),
        prev.alias("prev_decade_rating"),
        round_half_up(F.col("avg_rating") - prev, 2).alias("rating_change"),
    ).orderBy("title_type", "decade")


def next_decade_change(cat: Catalog, min_year: int = 1920, min_votes: int = 100) -> DataFrame:
    """The LEAD twin of A1 (the design notes claim LEAD; no statement uses it)."""
    g = _decade_stats(cat, min_year, min_votes)
    w = Window.partitionBy("title_type").orderBy("decade")
    nxt = F.lead("avg_rating").over(w)
    return g.select(
        "decade", "title_type",
        round_half_up(F.col("avg_rating"), 2).alias("average_rating"),
        nxt.alias("next_decade_rating"),
        round_half_up(nxt - F.col("avg_rating"), 2).alias("next_change"),
    ).orderBy("title_type", "decade")


def _rated_genre_titles(cat: Catalog, title_filter, min_votes: int | None, how: str = "inner") -> DataFrame:
    """genre, title columns and rating columns for titles passing `title_filter`."""
    t = cat.titles.where(title_filter).select("id", "title_type", "start_year")
    r = ratings_at_least(cat, min_votes).select("title_id", "average_rating", "num_votes")
    tr = t.join(r, t["id"] == r["title_id"], how).drop("title_id")
    return genre_names(cat).join(tr, F.col("title_id") == F.col("id")).drop("title_id")


def genre_by_decade(cat: Catalog, min_year: int = 1970, min_votes: int = 50, min_titles: int = 10) -> DataFrame:
    """A2: genre x decade mean, count and sample stddev, for cells with enough titles."""
    base = _rated_genre_titles(cat, F.col("start_year").isNotNull() & (F.col("start_year") >= min_year), min_votes)
    g = base.groupBy("genre", decade("start_year").alias("decade")).agg(
        mean(R()).alias("avg_rating"),
        F.count(F.lit(1)).alias("title_count"),
        stddev(R()).alias("rating_stddev"),
    )
    return g.where(F.col("title_count") >= min_titles).orderBy("genre", "decade")


def _slope_label(x, y) -> F.Column:
    """'Improving' / 'Declining' / 'Stable' from the sign of REGR_SLOPE(y, x) against +-0.05, exact.

    slope = (n*Sxy - Sx*Sy) / (n*Sxx - Sx^2) over pairs with both values present; with y in tenths
    (integers) the tests become integer comparisons; a zero denominator (one distinct x) is 'Stable'.
    """
    dec = "decimal(38,0)"
    both = x.isNotNull() & y.isNotNull()
    xi = F.when(both, x).cast(dec)
    yi = F.when(both, (y * 10).cast("bigint")).cast(dec)
    n = F.count(xi).cast(dec)
    num = n * F.sum(xi * yi) - F.sum(xi) * F.sum(yi)
    den = n * F.sum(xi * xi) - F.sum(xi) * F.sum(xi)
    # slope > 0.05  <=>  num / den > 0.5 (y in tenths)  <=>  2 * num > den   (den > 0)
    return (F.when((den > 0) & (num * 2 > den), "Improving")
            .when((den > 0) & (num * 2 < -den), "Declining")
            .otherwise("Stable"))


def _movie_credits(cat: Catalog, categories: tuple[str, ...], min_votes: int | None,
                   persons: DataFrame | None = None) -> DataFrame:
    """person_id, title_id, start_year, primary_title, average_rating, num_votes of rated movies; with `persons`
    (a column person_id) of their credits only, which are chosen before the other joins."""
    m = titles_of_type(cat, "movie", F.col("id").alias("title_id"), "primary_title", "start_year")
    r = ratings_at_least(cat, min_votes).select("title_id", "average_rating", "num_votes")
    c = credits(cat, categories).select("title_id", "person_id", "category")
    if persons is not None:
        c = c.join(persons, "person_id", "left_semi")
    return join_chain(c, "title_id", [(m, "inner"), (r, "inner")], cat.heavy_titles, ["person_id"])


def _known(cat: Catalog, credits_: DataFrame, column: str = "person_id") -> DataFrame:
    """Credits of people in the catalogue: orphans go before a top-k cut, not after it."""
    return credits_.join(cat.people.select(F.col("id").alias(column)), column, "left_semi")


def director_performance(cat: Catalog, min_votes: int = 100, min_movies: int = 5, k: int = 50) -> DataFrame:
    """A3: directors with enough rated movies: stats, global ranks, career trajectory; top k."""
    base = _known(cat, _movie_credits(cat, ("director",), min_votes))
    stats = base.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("total_movies"),
        mean(R()).alias("avg_exact"),
        stddev(R()).alias("rating_consistency"),
        F.min("start_year").alias("career_start"),
        F.max("start_year").alias("career_end"),
        F.sum("num_votes").cast("bigint").alias("total_votes"),
        _slope_label(F.col("start_year"), R()).alias("career_trajectory"),
    ).where(F.col("total_movies") >= min_movies)
    out = stats.select(
        "person_id", "total_movies", "avg_exact",
        round_half_up(F.col("avg_exact"), 2).alias("avg_rating"),
        round_half_up(F.col("rating_consistency"), 2).alias("consistency"),
        "career_start", "career_end",
        (F.col("career_end") - F.col("career_start") + 1).alias("career_length"),
        "total_votes", "career_trajectory",
    )
    # ORDER BY the *rounded* output column (the SQL alias shadows the exact one), ties by id.
    best = top_k_table(out, [F.col("avg_rating").desc_nulls_first(), F.col("total_votes").desc_nulls_first(),
                             F.col("person_id").asc()], k)
    # The global ROW_NUMBERs of these k rows among all qualifying directors, by counting who precedes them.
    best = with_ranks(best, stats, "person_id", {
        "rating_rank": sort_key(descending("avg_exact", nulls_first=True), descending("total_votes", nulls_first=True),
                                ascending("person_id")),
        "productivity_rank": sort_key(descending("total_movies"), ascending("person_id"))})
    people = cat.people.select(F.col("id").alias("person_id"), "name")
    return best.join(people, "person_id").orderBy(
        F.col("avg_rating").desc_nulls_first(), F.col("total_votes").desc_nulls_first(), "person_id").select(
        "name", "total_movies", "avg_rating", "consistency", "career_start", "career_end", "career_length",
        "total_votes", "rating_rank", "productivity_rank", "career_trajectory", "person_id",
    )


def actor_best_genre(cat: Catalog, min_votes: int = 100, min_movies: int = 10, k: int = 100) -> DataFrame:
    """A4: actors with enough rated movies, overall stats and their best genre; top k.

    Only the k output actors need a best genre, so the (actor x genre) aggregation runs on their
    credits alone (a broadcast semi-join against k ids).
    """
    base = _known(cat, _movie_credits(cat, ACTING, min_votes))
    overall = base.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("total_movies"),
        mean(R()).alias("overall_avg"),
        F.sum("num_votes").cast("bigint").alias("total_career_votes"),
    ).where(F.col("total_movies") >= min_movies)
    best_actors = top_k_table(overall, [F.col("overall_avg").desc_nulls_first(),
                                  F.col("total_career_votes").desc_nulls_first(), F.col("person_id").asc()], k)
    chosen = base.join(F.broadcast(best_actors.select("person_id")), "person_id", "left_semi")
    per_genre = chosen.join(genre_names(cat), "title_id").groupBy("person_id", "genre").agg(
        F.count(F.lit(1)).alias("movies_in_genre"),
        mean(R()).alias("avg_in_genre"),
    )
    top_genre = top_k_per_key(per_genre, ["person_id"],
                              [F.col("avg_in_genre").desc_nulls_first(), F.col("movies_in_genre").desc(),
                               F.col("genre").asc()], 1).drop("pos")
    people = cat.people.select(F.col("id").alias("person_id"), "name")
    return (best_actors.join(people, "person_id").join(top_genre, "person_id", "left")
            .orderBy(F.col("overall_avg").desc_nulls_first(), F.col("total_career_votes").desc_nulls_first(),
                     "person_id")
            .select("name", "total_movies",
                    round_half_up(F.col("overall_avg"), 2).alias("avg_rating"),
                    "total_career_votes",
                    F.col("genre").alias("best_genre"),
                    F.col("movies_in_genre").alias("movies_in_best_genre"),
                    round_half_up(F.col("avg_in_genre"), 2).alias("best_genre_rating"),
                    "person_id"))


def genre_popularity(cat: Catalog, min_year: int = 1970) -> DataFrame:
    """A5: genre x decade of movies (unrated ones count): share of the decade and growth."""
    cond = (F.col("title_type") == "movie") & F.col("start_year").isNotNull() & (F.col("start_year") >= min_year)
    base = _rated_genre_titles(cat, cond, None, how="left")
    g = base.groupBy("genre", decade("start_year").alias("decade")).agg(
        F.count(F.lit(1)).alias("title_count"),
        mean(R()).alias("avg_raw"),
        F.sum("num_votes").cast("bigint").alias("popularity_score"),
    )
    by_decade = Window.partitionBy("decade")
    by_genre = Window.partitionBy("genre").orderBy("decade")
    prev = F.lag("title_count").over(by_genre)
    return g.select(
        "genre", "decade", "title_count",
        round_half_up(F.col("avg_raw"), 2).alias("avg_rating"),
        "popularity_score",
        round_half_up(ratio_pct(F.col("title_count"), F.sum("title_count").over(by_decade)), 2)
        .alias("decade_percentage"),
        prev.alias("prev_decade_count"),
        round_half_up(ratio_pct(F.col("title_count") - prev, prev), 1).alias("growth_rate"),
    ).orderBy("genre", "decade")


def collaborations(cat: Catalog, min_count: int = 3, k: int = 50, sample: int = 3) -> DataFrame:
    """Director-actor pairs with at least `min_count` shared movies; top k.

    The pairs are counted by `threshold_pairs`: people who cannot reach the count are pruned first, and a
    movie with very many directors and cast never emits their combinations. A person credited on one movie
    in two acting categories counts twice there, as two credit rows. Only the k reported pairs need their
    first `sample` titles: those come from the credits of the k pairs' people alone (broadcast semi-joins
    against at most k ids).
    """
    movie_ids = titles_of_type(cat, "movie", "id")
    d = (credits(cat, ("director",)).join(movie_ids, F.col("title_id") == F.col("id"), "left_semi")
         .select("title_id", F.col("person_id").alias("director_id")))
    d = _known(cat, d, "director_id")
    a = (credits(cat, ACTING).join(movie_ids, F.col("title_id") == F.col("id"), "left_semi")
         .select("title_id", F.col("person_id").alias("actor_id")))
    a = _known(cat, a, "actor_id")
    counts = threshold_pairs(
        d.select(F.col("title_id").alias("key"), F.col("director_id").alias("left")),
        a.groupBy(F.col("title_id").alias("key"), F.col("actor_id").alias("right")).agg(F.count(F.lit(1)).alias("weight")),
        cat.ratings.select(F.col("title_id").alias("key"), R().alias("value")), min_count)
    counts = counts.select(F.col("left").alias("director_id"), F.col("right").alias("actor_id"),
                           F.col("count").alias("collaboration_count"),
                           F.try_divide(F.col("total").cast("double"), F.col("rated")).alias("avg_raw"))
    best = top_k_table(counts, [F.col("collaboration_count").desc(), F.col("avg_raw").desc_nulls_first(),
                          F.col("director_id").asc(), F.col("actor_id").asc()], k)
    # sample titles for the chosen pairs only
    chosen = F.broadcast(best.select("director_id", "actor_id"))
    d_few = d.join(F.broadcast(best.select("director_id")), "director_id", "left_semi")
    a_few = a.join(F.broadcast(best.select("actor_id")), "actor_id", "left_semi")
    titles = titles_of_type(cat, "movie", "id", "primary_title", "start_year")
    chosen_pairs = (d_few.join(a_few, "title_id").join(chosen, ["director_id", "actor_id"], "left_semi")
                    .join(titles, F.col("title_id") == F.col("id")))
    firsts = top_k_per_key(chosen_pairs, ["director_id", "actor_id"],
                           [F.col("start_year").asc_nulls_last(), F.col("title_id").asc()], sample)
    samples = firsts.groupBy("director_id", "actor_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "primary_title"))).alias("_s"))
    people = cat.people.select("id", "name")
    dp = people.select(F.col("id").alias("director_id"), F.col("name").alias("director_name"))
    ap = people.select(F.col("id").alias("actor_id"), F.col("name").alias("actor_name"))
    return (best.join(samples, ["director_id", "actor_id"]).join(dp, "director_id").join(ap, "actor_id")
            .orderBy(F.col("collaboration_count").desc(), F.col("avg_raw").desc_nulls_first(), "director_id",
                     "actor_id")
            .select("director_name", "actor_name", "collaboration_count",
                    round_half_up(F.col("avg_raw"), 2).alias("avg_rating"),
                    F.transform("_s", lambda s: s["primary_title"]).alias("sample_movies"),
                    "director_id", "actor_id"))


def genre_pairs(cat: Catalog, min_count: int = 20, k: int = 30) -> DataFrame:
    """Unordered genre pairs on one movie: count, mean, votes, success rank; top k.

    Pairs are formed per movie from its genre set (bounded by the genre vocabulary), then aggregated
    map-side per pair; the ranking runs on the per-pair frame, which the vocabulary bounds.
    """
    movies = titles_of_type(cat, "movie", "id")
    tg = cat.title_genres.join(movies, F.col("title_id") == F.col("id"), "left_semi")
    g1 = tg.select("title_id", F.col("genre_id").alias("g1"))
    g2 = tg.select("title_id", F.col("genre_id").alias("g2"))
    pairs = g1.join(g2, "title_id").where(F.col("g1") < F.col("g2"))
    rated = pairs.join(cat.ratings.select("title_id", "average_rating", "num_votes"), "title_id", "left")
    names = cat.genres.select("id", "name")
    agg = rated.groupBy("g1", "g2").agg(
        F.count(F.lit(1)).alias("combination_count"),
        mean(R()).alias("avg_raw"),
        F.sum("num_votes").cast("bigint").alias("total_popularity"),
    ).where(F.col("combination_count") >= min_count)
    named = (agg.join(names.select(F.col("id").alias("g1"), F.col("name").alias("genre1")), "g1")
             .join(names.select(F.col("id").alias("g2"), F.col("name").alias("genre2")), "g2"))
    # One row per genre pair: at most vocabulary^2 / 2 rows whatever the data size, so the global
    # ROW_NUMBER runs as a plain window on this small frame.
    success = Window.orderBy(F.col("avg_raw").desc_nulls_first(), F.col("total_popularity").desc_nulls_first(),
                             F.col("genre1").asc(), F.col("genre2").asc())
    ranked = named.withColumn("success_rank", F.row_number().over(success).cast("bigint"))
    out = ranked.select("genre1", "genre2", "combination_count",
                        round_half_up(F.col("avg_raw"), 2).alias("avg_rating"),
                        "total_popularity", "success_rank")
    return top_k(out, [F.col("avg_rating").desc_nulls_first(), F.col("total_popularity").desc_nulls_first(),
                       F.col("genre1").asc(), F.col("genre2").asc()], k)


def success_profile(cat: Catalog, min_votes: int = 1000, tiles: int = 4) -> DataFrame:
    """Well-voted movies split into rating quartiles: mean runtime, genres, cast and crew."""
    m = titles_of_type(cat, "movie", "id", "runtime_minutes")
    r = ratings_at_least(cat, min_votes).select("title_id", "average_rating", "num_votes")
    movies = m.join(r, m["id"] == r["title_id"]).drop("title_id")
    # the bridges are cut to these movies before they are aggregated
    wanted = movies.select(F.col("id").alias("title_id"))
    genre_count = cat.title_genres.join(wanted, "title_id", "left_semi").groupBy("title_id").agg(F.count_distinct("genre_id").alias("genre_count"))
    # COUNT(DISTINCT person) for cast and for crew without an Expand: one row per (title, person)
    # with two flags first, then a sum per title (both steps combine map-side).
    acting = F.col("category").isin(*ACTING)
    per_person = cat.title_people.join(wanted, "title_id", "left_semi").groupBy("title_id", "person_id").agg(
        F.max(F.when(acting, 1).otherwise(0)).alias("_cast"),
        F.max(F.when(~acting, 1).otherwise(0)).alias("_crew"))
    sizes = per_person.groupBy("title_id").agg(F.sum("_cast").cast("bigint").alias("cast_size"),
                                               F.sum("_crew").cast("bigint").alias("crew_size"))
    sa = (movies.join(genre_count, movies["id"] == genre_count["title_id"], "left").drop("title_id")
          .join(sizes, movies["id"] == sizes["title_id"], "left").drop("title_id")
          .select("id", "runtime_minutes", "average_rating", "num_votes",
                  F.coalesce("genre_count", F.lit(0)).alias("genre_count"),
                  F.coalesce("cast_size", F.lit(0)).alias("cast_size"),
                  F.coalesce("crew_size", F.lit(0)).alias("crew_size")))
    q = with_ntile(sa, [R().asc_nulls_last(), F.col("id").asc()], tiles, name="rating_quartile")
    return q.groupBy("rating_quartile").agg(
        F.count(F.lit(1)).alias("movie_count"),
        round_half_up(mean(R()), 2).alias("avg_rating"),
        round_half_up(mean("runtime_minutes"), 0).alias("avg_runtime"),
        round_half_up(mean("genre_count"), 1).alias("avg_genres"),
        round_half_up(mean("cast_size"), 0).alias("avg_cast_size"),
        round_half_up(mean("crew_size"), 0).alias("avg_crew_size"),
        round_half_up(mean("num_votes"), 0).alias("avg_votes"),
    ).orderBy(F.col("rating_quartile").desc())


# Fixed values of the source system: the longevity and quality labels, in report order.
LONGEVITY = ["Long-running (10+ seasons)", "Medium-run (5-9 seasons)", "Short-run (2-4 seasons)", "Single season"]
QUALITY = ["Excellent", "Good", "Average", "Below Average"]


def series_longevity_frame(cat: Catalog, as_of_year: int | None = None) -> DataFrame:
    """Per series with at least one numbered season: seasons, episodes, duration and both labels."""
    year = F.lit(as_of_year) if as_of_year is not None else F.year(F.current_date())
    s = titles_of_type(cat, "tvSeries", "id", "primary_title", "start_year", "end_year").where(
        F.col("start_year").isNotNull())
    counts = season_episode_counts(cat)
    r = cat.ratings.select("title_id", "average_rating", "num_votes")
    # HAVING COUNT(DISTINCT season) >= 1 keeps only series that have episode rows -> inner join.
    j = (s.join(counts.where(F.col("season_count") >= 1), s["id"] == counts["parent_series_id"])
         .join(r, s["id"] == r["title_id"], "left"))
    seasons = F.col("season_count")
    longevity = (F.when(seasons >= 10, LONGEVITY[0]).when(seasons >= 5, LONGEVITY[1])
                 .when(seasons >= 2, LONGEVITY[2]).otherwise(LONGEVITY[3]))
    quality = (F.when(R() >= 8.5, QUALITY[0]).when(R() >= 7.5, QUALITY[1])
               .when(R() >= 6.5, QUALITY[2]).otherwise(QUALITY[3]))
    return j.where(R().isNotNull()).select(
        "id", "primary_title", "start_year", "end_year", "average_rating", "num_votes",
        seasons.alias("total_seasons"),
        F.col("episode_count").alias("total_episodes"),
        (F.coalesce(F.col("end_year"), year) - F.col("start_year") + 1).alias("series_duration"),
        round_dec(F.try_divide(F.col("episode_count").cast("double"), seasons.cast("double")), 1)
        .alias("avg_episodes_per_season"),
        longevity.alias("longevity_category"),
        quality.alias("quality_tier"),
    )


def _label_rank(col: str, labels: list[str]) -> F.Column:
    expr = F.lit(len(labels))
    for i, label in reversed(list(enumerate(labels, start=1))):
        expr = F.when(F.col(col) == label, i).otherwise(expr)
    return expr


def series_longevity(cat: Catalog, as_of_year: int | None = None) -> DataFrame:
    """Series grouped by longevity and quality labels, in label order."""
    lc = series_longevity_frame(cat, as_of_year)
    g = lc.groupBy("longevity_category", "quality_tier").agg(
        F.count(F.lit(1)).alias("series_count"),
        round_half_up(mean(R()), 2).alias("avg_rating"),
        round_half_up(mean("total_seasons"), 1).alias("avg_seasons"),
        round_half_up(mean("series_duration"), 1).alias("avg_duration_years"),
        round_half_up(mean("avg_episodes_per_season"), 1).alias("avg_eps_per_season"),
        round_half_up(mean("num_votes"), 0).alias("avg_popularity"),
    )
    return g.orderBy(_label_rank("longevity_category", LONGEVITY), _label_rank("quality_tier", QUALITY))


def long_running_series(cat: Catalog, as_of_year: int | None = None, k: int = 20) -> DataFrame:
    """A10: best long-running series of good quality (reads A9's per-series frame)."""
    lc = series_longevity_frame(cat, as_of_year).where(
        (F.col("longevity_category") == LONGEVITY[0]) & F.col("quality_tier").isin(QUALITY[0], QUALITY[1]))
    best = top_k(lc, [R().desc_nulls_first(), F.col("num_votes").desc_nulls_first(), F.col("id").asc()], k)
    return best.select("primary_title", "start_year", "end_year", "total_seasons", "total_episodes",
                       "series_duration", round_half_up(R(), 1).alias("rating"), "num_votes",
                       "longevity_category", "quality_tier", "id")


def _career_order():
    return [F.col("start_year").asc_nulls_last(), F.col("title_id").asc()]


def career_trajectory(cat: Catalog, min_votes: int = 100, min_movies: int = 8, k: int = 10) -> DataFrame:
    """Running career statistics per director-movie, for the k best-rated director names.

    Directors are chosen (and matched) by name, as in the source. Ratings are summed per director first, so
    names meet one row per director; the windows then read the credits of the chosen names' directors alone.
    """
    sums = _movie_credits(cat, ("director",), min_votes).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(R()).alias("total"), F.count(R()).alias("rated"))
    people = cat.people.select(F.col("id").alias("person_id"), "name")
    per_name = sums.join(people, "person_id").groupBy("name").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("total").cast("double"), F.sum("rated")).alias("m")).where(
        F.col("n") >= min_movies)
    top_names = top_k_table(per_name, [F.col("m").desc_nulls_first(), F.col("name").asc()], k).select("name")
    chosen = people.join(F.broadcast(top_names), "name", "left_semi")
    rows = _movie_credits(cat, ("director",), min_votes, chosen).join(chosen, "person_id")
    # Running career statistics, kept parallel even for a director with a very long career.
    run = running_aggregates(rows, "person_id", _career_order(), {"r": R()})
    return run.select(
        "name", "primary_title", "start_year",
        round_half_up(R(), 1).alias("rating"),
        round_half_up(F.try_divide(F.col("r_sum").cast("double"), F.col("r_count")), 2).alias("running_avg"),
        round_half_up(R().cast("double") - F.try_divide(F.col("r_total_sum").cast("double"), F.col("r_total_count")),
                      2).alias("vs_career_avg"),
        F.col("pos").cast("bigint").alias("career_movie_number"),
        round_half_up(F.col("r_max"), 1).alias("peak_so_far"),
        "person_id", "title_id",
    ).orderBy("name", F.col("start_year").asc_nulls_last(), "person_id", "title_id")


def movies_since_last_hit(cat: Catalog, hit: float = 7.5, min_votes: int = 100) -> DataFrame:
    """Per director-movie, the count of movies since (and including) the last hit.

    Gaps and islands: each hit (rating > `hit`) opens an island and counts as 1 in it; movies before
    the first hit form island 0. Computed as position minus the position of the latest hit so far,
    both from the skew-safe running aggregates.
    """
    base = _movie_credits(cat, ("director",), min_votes)
    run = running_aggregates(base, "person_id", _career_order(), {}, {"hit": R() > hit})
    return run.select(
        "person_id", "title_id", "start_year",
        R().cast("double").alias("average_rating"),
        F.when(F.col("hit_last").isNull(), F.col("pos")).otherwise(F.col("pos") - F.col("hit_last") + 1)
        .cast("bigint").alias("movies_since_last_hit"),
    )


def genre_performance(cat: Catalog, min_year: int = 1980, min_votes: int = 50, min_titles: int = 100,
                      min_avg: float = 6.0, max_stddev: float = 1.5, min_excellent: int = 5) -> DataFrame:
    """Per genre of recent rated movies: spread, quartiles, excellent/poor counts; 4 HAVING rules."""
    cond = (F.col("title_type") == "movie") & (F.col("start_year") >= min_year)
    base = _rated_genre_titles(cat, cond, min_votes)
    excellent = F.count(F.when(R() >= 8.0, 1))
    g = base.groupBy("genre").agg(
        F.count(F.lit(1)).alias("total_titles"),
        mean(R()).alias("avg_raw"),
        stddev(R()).alias("sd_raw"),
        F.percentile(R().cast("double"), F.lit(0.25)).alias("q1_raw"),
        F.percentile(R().cast("double"), F.lit(0.75)).alias("q3_raw"),
        excellent.alias("excellent_count"),
        F.count(F.when(R() <= 5.0, 1)).alias("poor_count"),
        F.sum("num_votes").cast("bigint").alias("total_popularity"),
        F.min("start_year").alias("first_appearance"),
        F.max("start_year").alias("last_appearance"),
        mean_at_least(R(), min_avg).alias("_avg_ok"),
        stddev_at_most(R(), max_stddev).alias("_sd_ok"),
    )
    g = g.where((F.col("total_titles") >= min_titles) & F.col("_avg_ok") & F.col("_sd_ok")
                & (F.col("excellent_count") >= min_excellent))
    return g.select(
        "genre", "total_titles",
        round_half_up(F.col("avg_raw"), 2).alias("avg_rating"),
        round_half_up(F.col("sd_raw"), 2).alias("consistency"),
        round_half_up(F.col("q1_raw"), 1).alias("q1_rating"),
        round_half_up(F.col("q3_raw"), 1).alias("q3_rating"),
        "excellent_count", "poor_count",
        round_half_up(ratio_pct(F.col("excellent_count"), F.col("total_titles")), 1).alias("excellent_percentage"),
        "total_popularity",
        (F.col("last_appearance") - F.col("first_appearance") + 1).alias("genre_lifespan"),
    ).orderBy(F.col("avg_rating").desc_nulls_first(), F.col("total_titles").desc(), "genre")


def most_voted(cat: Catalog, min_votes: int = 10000, k: int = 100) -> DataFrame:
    """The k most-voted titles with their genres and their vote rank within (type, year).

    Every title with more votes than a top-k title is itself in the top k, so the RANK() over
    (type, year) can be taken inside the k rows: no window over the whole table.
    """
    t = cat.titles.select("id", "title_type", "primary_title", "start_year")
    r = ratings_at_least(cat, min_votes).select("title_id", "average_rating", "num_votes")
    tr = t.join(r, t["id"] == r["title_id"]).drop("title_id")
    best = top_k_table(tr, [F.col("num_votes").desc(), F.col("id").asc()], k)
    genres = (genre_names(cat).join(F.broadcast(best.select("id")), F.col("title_id") == F.col("id"), "left_semi")
              .groupBy("title_id").agg(string_list(F.col("genre")).alias("genres")))
    w = Window.partitionBy("title_type", "start_year").orderBy(F.col("num_votes").desc())
    return (best.join(genres, best["id"] == genres["title_id"], "left")
            .select("title_type", "primary_title", "start_year",
                    R().cast("double").alias("average_rating"), "num_votes", "genres",
                    F.rank().over(w).cast("bigint").alias("year_popularity_rank"), "id")
            .orderBy(F.col("num_votes").desc(), "id"))


def dashboard(cat: Catalog) -> DataFrame:
    """Seven (metric, value) rows: counts, mean ratings, most common genre."""
    tt = F.col("title_type")

    def mean_text(type_name: str):
        col = F.when(tt == type_name, R())
        return F.round(F.try_divide(F.sum(col).cast("double"), F.count(col)).cast("decimal(38,10)"), 2)

    # counts come from the titles alone; only rated titles of two types meet their ratings
    counts = cat.titles.agg(
        F.count(F.when(tt == "movie", 1)).alias("movies"),
        F.count(F.when(tt == "tvSeries", 1)).alias("series"),
        F.count(F.when(tt == "tvEpisode", 1)).alias("episodes"),
    )
    means = cat.titles.where(tt.isin("movie", "tvSeries")).select("id", "title_type").join(
        cat.ratings.select("title_id", "average_rating"), F.col("id") == F.col("title_id")).agg(
        mean_text("movie").alias("movie_rating"), mean_text("tvSeries").alias("series_rating"))
    # metric names and their order are fixed values of the source system's dashboard
    def row(i: int, metric: str, value) -> F.Column:
        return F.struct(F.lit(i).alias("i"), F.lit(metric).alias("metric"), value.cast("string").alias("value"))

    metrics = counts.select(F.explode(F.array(
        row(1, "Total Movies", F.col("movies")),
        row(2, "Total TV Series", F.col("series")),
        row(3, "Total Episodes", F.col("episodes")),
    )).alias("m")).select("m.*")
    scores = means.select(F.explode(F.array(
        row(5, "Average Movie Rating", F.col("movie_rating")),
        row(6, "Average TV Series Rating", F.col("series_rating")),
    )).alias("m")).select("m.*")
    people = cat.people.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit(4).alias("i"), F.lit("Total People").alias("metric"), "value")
    popular = top_k(genre_names(cat).groupBy("genre").agg(F.count(F.lit(1)).alias("n")),
                    [F.col("n").desc(), F.col("genre").asc()], 1).select(
        F.lit(7).alias("i"), F.lit("Most Popular Genre").alias("metric"), F.col("genre").alias("value"))
    return metrics.unionByName(scores).unionByName(people).unionByName(popular).orderBy("i").drop("i")


def rating_rollup(cat: Catalog, min_votes: int | None = None) -> DataFrame:
    """GROUPING SETS ((genre, decade), (genre), ()) over rated movies (claimed in the design notes).

    `level` is grouping_id(genre, decade): 0 for a genre-decade cell, 1 for a genre total, 3 for the
    grand total.
    """
    base = _rated_genre_titles(cat, F.col("title_type") == "movie", min_votes).withColumn(
        "decade", decade("start_year"))
    # sums and counts per cell first (exact decimals), so that only cells are expanded to the three sets
    cells = base.groupBy("genre", "decade").agg(F.count(F.lit(1)).alias("_n"), F.count(R()).alias("_rated"),
                                                F.sum(R()).alias("_sum"))
    g = cells.groupingSets([["genre", "decade"], ["genre"], []], "genre", "decade").agg(
        F.grouping_id("genre", "decade").cast("int").alias("level"),
        F.sum("_n").alias("title_count"),
        round_half_up(F.try_divide(F.sum("_sum").cast("double"), F.sum("_rated")), 2).alias("avg_rating"),
    )
    return g.orderBy("level", F.col("genre").asc_nulls_last(), F.col("decade").asc_nulls_last())
