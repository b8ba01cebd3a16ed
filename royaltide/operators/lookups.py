"""Parameterised lookups over the catalogue, licences, payments and plays.

Every lookup has a form for one call and a form for a table of calls. The
latter carries the columns named in ``keys`` through to the result. Optional
filters of a table of calls are matched through scopes: a fact belongs to the
scope of its own value and to ``*``, so that "no filter" is an equi-join too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from royaltide.functions.columns import (
    micros,
    is_absent,
    matches_text,
    money,
    optional_eq,
    split_ids,
)
from royaltide.operators.matching import resolve_terms, top_per_group

EVERY = "*"
DEFAULT_RESULTS = 10
ADMIN_FEE = 0.15


def scope_of(value: Column | str, fold=F.lower) -> Column:
    """Scope an optional argument asks for."""
    column = F.col(value) if isinstance(value, str) else value
    absent = column.isNull() | (F.upper(column) == "NULL")
    return F.when(absent, F.lit(EVERY)).otherwise(fold(column))


def _scopes(value: Column) -> Column:
    return F.explode(F.array(value, F.lit(EVERY)))


# --- payments of songs ---------------------------------------------------------

ROYALTY_COLUMNS = (
    "song_id", "title", "artist_name", "isrc_code", "songwriter_id", "songwriter_name",
    "payment_period", "gross_amount", "deductions", "net_amount", "payment_status", "payment_date",
)


def _royalties_of(
    matched: DataFrame, payments: DataFrame, writers: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    names = writers.select("songwriter_id", F.col("name").alias("songwriter_name"))
    return (
        matched.select(*keys, "song_id", "title", "artist_name", "isrc_code")
        .join(payments, "song_id")
        .join(names, "songwriter_id", "left")
        .select(*keys, *ROYALTY_COLUMNS)
    )


def lookup_song_royalties(
    songs: DataFrame, payments: DataFrame, writers: DataFrame, search_term: str
) -> DataFrame:
    """Payments of the songs found by id, part of the title, or ISRC."""
    hit = (
        (F.col("song_id").cast("string") == search_term)
        | matches_text("title", search_term)
        | (F.upper("isrc_code") == search_term.upper())
    )
    found = _royalties_of(songs.where(hit), payments, writers)
    return found.orderBy(F.desc("payment_period"), F.desc("net_amount"))


def song_royalties_for(
    requests: DataFrame, songs: DataFrame, payments: DataFrame, writers: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """``lookup_song_royalties`` for a table of ``search_term`` values."""
    asked = requests.select(*keys, F.col("search_term").alias("term"))
    hits = resolve_terms(asked, songs, "song_id", "isrc_code", ["title"]).select("term", "song_id")
    matched = asked.join(hits, "term").join(songs, "song_id")
    return _royalties_of(matched, payments, writers, keys)


# --- splits --------------------------------------------------------------------


def royalty_splits(
    asks: DataFrame,
    songs: DataFrame,
    writers: DataFrame,
    keys: Sequence[str] = ("song_id", "gross_amount"),
    fee: float = ADMIN_FEE,
) -> DataFrame:
    """Divide each ask ``(song_id, gross_amount)`` among the song's writers.

    Splits are scaled to 100 percent over the writers that are known; an
    unknown writer is listed with NULL shares. ``keys`` must identify an ask;
    a window partition is then one song's writer list.
    """
    listed = (
        asks.join(songs.select("song_id", "title", "songwriters"), "song_id")
        .withColumn("songwriter_id", F.explode(split_ids("songwriters")))
        .drop("songwriters")
    )
    known = writers.select(
        F.col("songwriter_id").cast("string").alias("songwriter_id"),
        F.col("name").alias("songwriter_name"),
        "pro_affiliation",
        F.col("split_percentage").alias("_raw"),
    )
    # Decimals: with dozens of writers the order of a double sum reaches the rounded share.
    exact = F.col("_raw").try_cast("decimal(18, 9)")
    whole = F.sum(exact).over(W.partitionBy(*keys))
    share = F.try_divide(F.col("_raw"), whole.cast("double"))
    in_percent = F.try_divide(exact * F.lit(100), whole)
    amount = F.col("gross_amount") * F.col("_share")
    extra = [k for k in keys if k not in ("song_id", "gross_amount")]
    return (
        listed.join(known, "songwriter_id", "left")
        .withColumn("_share", share)
        .withColumn("_percent", in_percent)
        .select(
            *extra,
            "song_id",
            "title",
            "songwriter_id",
            "songwriter_name",
            "pro_affiliation",
            F.round("_percent", 2).cast("double").alias("split_percentage"),
            F.round(amount, 2).alias("gross_share"),
            F.round(amount * fee, 2).alias("estimated_deductions"),
            F.round(amount * (1 - fee), 2).alias("net_share"),
        )
    )


def calculate_royalty_split(
    songs: DataFrame, writers: DataFrame, song_id, gross_amount: float
) -> DataFrame:
    """Split of one amount for one song."""
    asks = songs.where(F.col("song_id") == F.lit(song_id)).select(
        "song_id", F.lit(float(gross_amount)).alias("gross_amount")
    )
    return royalty_splits(asks, songs, writers)


# --- licensing -----------------------------------------------------------------

LICENSING_COLUMNS = (
    "search_match", "match_type", "total_active_licenses", "total_license_revenue",
    "license_type", "license_type_count", "license_type_revenue", "top_territories",
)


def _licensing_of(
    matched: DataFrame, licenses: DataFrame, as_of: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Licence figures per match and type.

    One aggregate over (match, type, territory) feeds the type rows, the totals
    and the five leading territories. Songs that share a title are one match.
    """
    active = F.col("end_date") >= F.lit(as_of).cast("date")
    named = matched.select(
        *keys,
        "song_id",
        F.coalesce("title", "artist_name", F.col("song_id").cast("string")).alias("search_match"),
        "match_type",
    )
    by_song = (
        licenses.join(named.select("song_id").distinct(), "song_id", "left_semi")
        .groupBy("song_id", "license_type", "territory")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(micros("fee_amount")).alias("_fee"),
            F.count_if(active).alias("_active"),
        )
    )
    match = [*keys, "search_match"]
    cells = (
        named.join(by_song, "song_id")
        .groupBy(*match, "match_type", "license_type", "territory")
        .agg(*[F.sum(c).alias(c) for c in ("_n", "_fee", "_active")])
    )
    types = cells.groupBy(*match, "match_type", "license_type").agg(
        F.sum("_n").alias("license_type_count"),
        money(F.sum("_fee")).alias("license_type_revenue"),
    )
    totals = cells.groupBy(*match).agg(
        F.sum("_active").alias("total_active_licenses"),
        money(F.sum("_fee")).alias("total_license_revenue"),
    )
    leading = top_per_group(cells, match, "territory", F.sum("_n"), n=5)
    listed = leading.groupBy(*match).agg(
        F.sort_array(F.collect_list(F.struct("rank", "territory"))).alias("_top")
    ).select(*match, F.array_join(F.col("_top.territory"), ", ").alias("top_territories"))
    return (
        types.join(totals, match)
        .join(listed, match, "left")
        .select(*keys, *LICENSING_COLUMNS)
    )


def get_licensing_summary(
    songs: DataFrame, licenses: DataFrame, search_term: str, as_of: str
) -> DataFrame:
    """Licence figures of the songs found by id, title or artist."""
    kind = (
        F.when(F.col("song_id").cast("string") == search_term, "song_id")
        .when(matches_text("title", search_term), "title")
        .when(matches_text("artist_name", search_term), "artist")
    )
    matched = songs.withColumn("match_type", kind).where(F.col("match_type").isNotNull())
    return _licensing_of(matched, licenses, as_of).orderBy(
        F.desc("license_type_revenue"), "search_match", "match_type", "license_type"
    )


def licensing_summary_for(
    requests: DataFrame, songs: DataFrame, licenses: DataFrame, as_of: str, keys: Sequence[str]
) -> DataFrame:
    """``get_licensing_summary`` for a table of ``search_term`` values."""
    asked = requests.select(*keys, F.col("search_term").alias("term"))
    kind = F.when(F.col("match_type") == "artist_name", "artist").otherwise(F.col("match_type"))
    hits = resolve_terms(asked, songs, "song_id", None, ["title", "artist_name"])
    matched = asked.join(hits.withColumn("match_type", kind), "term").join(songs, "song_id")
    return _licensing_of(matched, licenses, as_of, keys)


# --- songwriter earnings ---------------------------------------------------------

EARNING_COLUMNS = (
    "songwriter_id", "songwriter_name", "pro_affiliation", "payment_period", "total_gross",
    "total_deductions", "total_net", "num_payments", "num_songs",
)


def _earnings_of(matched: DataFrame, payments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    per_song = (
        payments.join(matched.select("songwriter_id").distinct(), "songwriter_id", "left_semi")
        .groupBy("songwriter_id", "payment_period", "song_id")
        .agg(
            F.sum(micros("gross_amount")).alias("_gross"),
            F.sum(micros("deductions")).alias("_ded"),
            F.sum(micros("net_amount")).alias("_net"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    per_period = per_song.groupBy("songwriter_id", "payment_period").agg(
        money(F.sum("_gross")).alias("total_gross"),
        money(F.sum("_ded")).alias("total_deductions"),
        money(F.sum("_net")).alias("total_net"),
        F.sum("_n").alias("num_payments"),
        F.count("song_id").alias("num_songs"),
    )
    return (
        matched.select(*keys, "songwriter_id", F.col("name").alias("songwriter_name"), "pro_affiliation")
        .join(per_period, "songwriter_id")
        .select(*keys, *EARNING_COLUMNS)
    )


def lookup_songwriter_earnings(
    writers: DataFrame, payments: DataFrame, search_term: str
) -> DataFrame:
    """Earnings per period of the writers found by id or part of the name."""
    hit = (F.col("songwriter_id").cast("string") == search_term) | matches_text("name", search_term)
    return _earnings_of(writers.where(hit), payments).orderBy(
        F.desc("payment_period"), F.desc("total_net"), "songwriter_id"
    )


def songwriter_earnings_for(
    requests: DataFrame, writers: DataFrame, payments: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``lookup_songwriter_earnings`` for a table of ``search_term`` values."""
    asked = requests.select(*keys, F.col("search_term").alias("term"))
    hits = resolve_terms(asked, writers, "songwriter_id", None, ["name"])
    matched = asked.join(hits.drop("match_type"), "term").join(writers, "songwriter_id")
    return _earnings_of(matched, payments, keys)


# --- top songs -------------------------------------------------------------------

TOP_SONG_COLUMNS = (
    "rank", "song_id", "title", "artist_name", "genre", "total_gross", "total_deductions",
    "total_net", "num_payments", "num_songwriters",
)


PARTS = ("_gross", "_ded", "_net", "_n")


def _writer_totals(payments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Payments per song and writer; spreads a hot song over its writers."""
    return payments.groupBy(*keys, "song_id", "songwriter_id").agg(
        F.sum(micros("gross_amount")).alias("_gross"),
        F.sum(micros("deductions")).alias("_ded"),
        F.sum(micros("net_amount")).alias("_net"),
        F.count(F.lit(1)).alias("_n"),
    )


def _song_totals(per_writer: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Payment totals per song from totals per song and writer."""
    return per_writer.groupBy(*keys, "song_id").agg(
        money(F.sum("_gross")).alias("total_gross"),
        money(F.sum("_ded")).alias("total_deductions"),
        money(F.sum("_net")).alias("total_net"),
        F.sum("_n").alias("num_payments"),
        F.count("songwriter_id").alias("num_songwriters"),
    )


def get_top_royalty_songs(
    songs: DataFrame,
    payments: DataFrame,
    num_results: int | None = None,
    filter_genre: str | None = None,
    filter_period: str | None = None,
) -> DataFrame:
    """Songs ranked by total net payments; 10 by default, as many as asked for.

    Payments are reduced per song before they meet the songs, and only the
    first rows of each task travel to the final ranking.
    """
    limit = DEFAULT_RESULTS if num_results is None else max(0, num_results)
    if not is_absent(filter_period):
        payments = payments.where(F.col("payment_period") == filter_period)
    leaders = (
        _song_totals(_writer_totals(payments))
        .join(
            songs.where(optional_eq("genre", filter_genre)).select(
                "song_id", "title", "artist_name", "genre"
            ),
            "song_id",
        )
        .orderBy(F.desc("total_net"), "song_id")
        .limit(limit)
    )
    rank = F.row_number().over(W.orderBy(F.desc("total_net"), "song_id"))
    return leaders.withColumn("rank", rank).select(*TOP_SONG_COLUMNS)


def top_royalty_songs_for(
    requests: DataFrame, songs: DataFrame, payments: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``get_top_royalty_songs`` for a table of calls.

    Each distinct (genre, period) pair is ranked once, up to the largest number asked of it; calls
    with different limits share that ranking.
    """
    wanted = F.coalesce(F.col("num_results"), F.lit(DEFAULT_RESULTS))
    asked = requests.select(
        *keys,
        wanted.alias("_limit"),
        scope_of("filter_genre").alias("_genre"),
        scope_of("filter_period", fold=lambda c: c).alias("_period"),
    )
    # Reduced to (period, song, writer) before a row is put in two scopes.
    cells = _writer_totals(payments, ["payment_period"])
    scoped = (
        cells.withColumn("_period", _scopes(F.col("payment_period")))
        .join(asked.select("_period").distinct(), "_period", "left_semi")
        .groupBy("_period", "song_id", "songwriter_id")
        .agg(*[F.sum(c).alias(c) for c in PARTS])
    )
    described = songs.select("song_id", "title", "artist_name", "genre")
    ranked = (
        _song_totals(scoped, ["_period"])
        .join(described, "song_id")
        .withColumn("_genre", _scopes(F.lower("genre")))
        .join(asked.groupBy("_genre", "_period").agg(F.max("_limit").alias("_most")), ["_genre", "_period"])
        .withColumn(
            "rank",
            F.row_number().over(
                W.partitionBy("_genre", "_period").orderBy(F.desc("total_net"), "song_id")
            ),
        )
        .where(F.col("rank") <= F.col("_most"))
    )
    return (
        asked.join(ranked, ["_genre", "_period"])
        .where(F.col("rank") <= F.col("_limit"))
        .select(*keys, *TOP_SONG_COLUMNS)
    )


# --- catalogue overview ------------------------------------------------------------

OVERVIEW_COLUMNS = (
    "total_songs", "total_artists", "total_songwriters", "total_genres", "total_gross_revenue",
    "total_net_revenue", "total_licenses", "active_licenses", "avg_royalty_per_song",
    "top_genre", "top_artist",
)


def _overview(
    scopes: DataFrame,
    scoped: DataFrame,
    payments: DataFrame,
    licenses: DataFrame,
    writers: DataFrame,
    as_of: str,
) -> DataFrame:
    """One row per row of ``scopes``; ``scoped`` are songs labelled by ``_scope``."""
    counts = scoped.groupBy("_scope").agg(
        F.count(F.lit(1)).alias("total_songs"),
        F.count_distinct("artist_name").alias("total_artists"),
        F.count_distinct("genre").alias("total_genres"),
    )
    paid = payments.groupBy("song_id").agg(
        F.sum(micros("gross_amount")).alias("_gross"), F.sum(micros("net_amount")).alias("_net")
    )
    revenue = (
        scoped.select("_scope", "song_id", "genre", "artist_name")
        .join(paid, "song_id")
        .groupBy("_scope", "genre", "artist_name")
        .agg(F.sum("_gross").alias("_gross"), F.sum("_net").alias("_net"))
    )
    totals = revenue.groupBy("_scope").agg(
        money(F.sum("_gross")).alias("total_gross_revenue"),
        money(F.sum("_net")).alias("total_net_revenue"),
    )

    def leader(category: str, name: str) -> DataFrame:
        top = top_per_group(revenue, ["_scope"], category, F.sum("_net"))
        return top.select("_scope", F.col(category).alias(name))

    active = F.col("end_date") >= F.lit(as_of).cast("date")
    held = licenses.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(active).alias("_active")
    )
    licensed = (
        scoped.select("_scope", "song_id")
        .join(held, "song_id")
        .groupBy("_scope")
        .agg(F.sum("_n").alias("total_licenses"), F.sum("_active").alias("active_licenses"))
    )
    everyone = writers.agg(F.count_distinct("songwriter_id")).scalar()
    # Every part has at most one row per scope, so stacking them and taking the
    # only value of each column replaces five joins.
    parts = (counts, totals, licensed, leader("genre", "top_genre"), leader("artist_name", "top_artist"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, scopes)
    figures = [c for c in stacked.columns if c != "_scope"]
    out = stacked.groupBy("_scope").agg(*[F.max(c).alias(c) for c in figures])
    average = F.round(F.try_divide(F.col("total_net_revenue"), F.col("total_songs")), 2)
    return (
        out.fillna(0, ["total_songs", "total_artists", "total_genres", "total_licenses"])
        .withColumn("total_songwriters", everyone)
        .withColumn("avg_royalty_per_song", average)
    )


def get_catalog_overview(
    songs: DataFrame,
    payments: DataFrame,
    licenses: DataFrame,
    writers: DataFrame,
    as_of: str,
    filter_genre: str | None = None,
) -> DataFrame:
    """One row of portfolio totals. The writer count ignores the genre filter."""
    scopes = songs.sparkSession.range(1).select(F.lit(EVERY).alias("_scope"))
    scoped = songs.where(optional_eq("genre", filter_genre)).withColumn("_scope", F.lit(EVERY))
    return _overview(scopes, scoped, payments, licenses, writers, as_of).select(*OVERVIEW_COLUMNS)


def catalog_overview_for(
    requests: DataFrame,
    songs: DataFrame,
    payments: DataFrame,
    licenses: DataFrame,
    writers: DataFrame,
    as_of: str,
    keys: Sequence[str],
) -> DataFrame:
    """``get_catalog_overview`` for a table of ``filter_genre`` values."""
    asked = requests.select(*keys, scope_of("filter_genre").alias("_scope"))
    scopes = asked.select("_scope").distinct()
    scoped = songs.withColumn("_scope", _scopes(F.lower("genre"))).join(scopes, "_scope", "left_semi")
    per_scope = _overview(scopes, scoped, payments, licenses, writers, as_of)
    return asked.join(per_scope, "_scope").select(*keys, *OVERVIEW_COLUMNS)


# --- territories ---------------------------------------------------------------------

TERRITORY_COLUMNS = (
    "territory", "total_licenses", "active_licenses", "total_revenue", "avg_fee_per_license",
    "top_license_type", "top_licensee", "num_songs",
)


def _territories(licenses: DataFrame, as_of: str) -> DataFrame:
    """Figures per territory from two reduced scans of the licences."""
    active = F.col("end_date") >= F.lit(as_of).cast("date")
    cells = licenses.groupBy("territory", "license_type", "licensee_name").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("fee_amount").alias("_fees"),
        F.sum(micros("fee_amount")).alias("_fee"),
        F.count_if(active).alias("_active"),
    )
    stats = cells.groupBy("territory").agg(
        F.sum("_n").alias("total_licenses"),
        F.sum("_active").alias("active_licenses"),
        money(F.sum("_fee")).alias("total_revenue"),
        F.round(money(F.sum("_fee")) / F.sum("_fees"), 2).alias("avg_fee_per_license"),
    )
    song_count = (
        licenses.groupBy("territory", "song_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("territory")
        .agg(F.count("song_id").alias("num_songs"))
    )
    kind = top_per_group(cells, ["territory"], "license_type", F.sum("_fee"))
    partner = top_per_group(cells, ["territory"], "licensee_name", F.sum("_fee"))
    return (
        stats.join(song_count, "territory")
        .join(kind.select("territory", F.col("license_type").alias("top_license_type")), "territory", "left")
        .join(partner.select("territory", F.col("licensee_name").alias("top_licensee")), "territory", "left")
    )


def get_revenue_by_territory(
    licenses: DataFrame, as_of: str, filter_territory: str | None = None
) -> DataFrame:
    """Licence revenue per territory, highest first."""
    kept = licenses.where(optional_eq("territory", filter_territory))
    return _territories(kept, as_of).select(*TERRITORY_COLUMNS).orderBy(
        F.desc("total_revenue"), "territory"
    )


def revenue_by_territory_for(
    requests: DataFrame, licenses: DataFrame, as_of: str, keys: Sequence[str]
) -> DataFrame:
    """``get_revenue_by_territory`` for a table of ``filter_territory`` values."""
    asked = requests.select(*keys, scope_of("filter_territory").alias("_scope"))
    figures = _territories(licenses, as_of).withColumn("_scope", _scopes(F.lower("territory")))
    return asked.join(figures, "_scope").select(*keys, *TERRITORY_COLUMNS)


# --- platforms -----------------------------------------------------------------------

PLATFORM_COLUMNS = (
    "platform", "total_plays", "total_play_hours", "num_songs", "num_territories",
    "avg_plays_per_song", "top_song_title", "top_song_plays",
)


def _platforms(matched: DataFrame, plays: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Figures per platform; plays are reduced to (platform, song, territory) first."""
    group = [*keys, "platform"]
    cells = plays.groupBy("platform", "song_id", "territory").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_played").alias("_seconds")
    )
    heard = matched.select(*keys, "song_id", "title").join(cells, "song_id")
    per_song = heard.groupBy(*group, "song_id", "title").agg(
        F.sum("_n").alias("_n"), F.sum("_seconds").alias("_seconds")
    )
    stats = per_song.groupBy(*group).agg(
        F.sum("_n").alias("total_plays"),
        F.round(F.sum("_seconds") / F.lit(3600.0), 1).alias("total_play_hours"),
        F.count("song_id").alias("num_songs"),
        F.round(F.sum("_n") / F.count("song_id"), 1).alias("avg_plays_per_song"),
    )
    places = (
        heard.groupBy(*group, "territory")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*group)
        .agg(F.count("territory").alias("num_territories"))
    )
    best = top_per_group(per_song, group, "title", F.sum("_n"), name="top_song_plays")
    best = best.select(*group, F.col("title").alias("top_song_title"), "top_song_plays")
    return stats.join(places, group).join(best, group, "left")


def get_platform_performance(
    songs: DataFrame,
    plays: DataFrame,
    search_term: str | None = None,
    filter_platform: str | None = None,
) -> DataFrame:
    """Play figures per platform for the matching songs, most played first."""
    if not is_absent(search_term):
        songs = songs.where(
            (F.col("song_id").cast("string") == search_term)
            | matches_text("title", search_term)
            | matches_text("artist_name", search_term)
        )
        # Plays of other songs leave before they are counted.
        plays = plays.join(songs.select("song_id"), "song_id", "left_semi")
    kept = plays.where(optional_eq("platform", filter_platform))
    return _platforms(songs, kept).select(*PLATFORM_COLUMNS).orderBy(
        F.desc("total_plays"), "platform"
    )


def platform_performance_for(
    requests: DataFrame, songs: DataFrame, plays: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``get_platform_performance`` for a table of calls.

    Calls with the same term share their figures; calls without a term share
    the figures of the whole catalogue.
    """
    asked = requests.select(
        *keys,
        scope_of("search_term", fold=lambda c: c).alias("term"),
        scope_of("filter_platform").alias("_platform"),
    )
    terms = asked.select("term").distinct()
    named = resolve_terms(terms.where(F.col("term") != EVERY), songs, "song_id", None, ["title", "artist_name"])
    matched = named.select("term", "song_id").join(songs.select("song_id", "title"), "song_id")
    all_songs = songs.select(F.lit(EVERY).alias("term"), "song_id", "title").join(
        terms, "term", "left_semi"
    )
    figures = _platforms(matched.unionByName(all_songs), plays, ["term"])
    scoped = figures.withColumn("_platform", _scopes(F.lower("platform")))
    return asked.join(scoped, ["term", "_platform"]).select(*keys, *PLATFORM_COLUMNS)
