"""Parameterised lookups on fixed sample arguments."""

from pyspark.sql import functions as F

from royaltide.operators import lookups as L
from royaltide.operators.matching import resolve_terms, top_per_group
from royaltide.plans.common import AS_OF_DATE, Catalogue, sql_cents, sql_money, sql_round, sql_int

CAT = Catalogue()

TERM = "red"
GENRE = "economy"
PERIOD = "1999-Q1"


def songs_with_writers(t):
    """Songs with their writer ids as delimited text."""
    listed = t.song_writers.groupBy("song_id").agg(
        F.array_join(F.sort_array(F.collect_list("songwriter_id")).cast("array<string>"), ",").alias(
            "songwriters"
        )
    )
    return t.songs.join(listed, "song_id", "left")


@CAT.add(
    "top_royalty_songs",
    sql_int(f"""WITH sums AS (
        SELECT song_id, {sql_money("gross_amount")} AS total_gross,
               {sql_money("deductions")} AS total_deductions, {sql_money("net_amount")} AS total_net,
               count(*) AS num_payments, count(DISTINCT songwriter_id) AS num_songwriters
        FROM {{royalty_payments}} GROUP BY song_id)
    SELECT row_number() OVER (ORDER BY total_net DESC, song_id) AS rank, song_id, title, artist_name,
           genre, total_gross, total_deductions, total_net, num_payments, num_songwriters
    FROM sums JOIN {{songs}} USING (song_id) ORDER BY rank LIMIT 10""", "rank"),
)
def _(t):
    return L.get_top_royalty_songs(t.songs, t.royalty_payments)


@CAT.add(
    "top_royalty_songs_filtered",
    sql_int(f"""WITH sums AS (
        SELECT song_id, {sql_money("gross_amount")} AS total_gross,
               {sql_money("deductions")} AS total_deductions, {sql_money("net_amount")} AS total_net,
               count(*) AS num_payments, count(DISTINCT songwriter_id) AS num_songwriters
        FROM {{royalty_payments}} WHERE payment_period = '{PERIOD}' GROUP BY song_id)
    SELECT row_number() OVER (ORDER BY total_net DESC, song_id) AS rank, song_id, title, artist_name,
           genre, total_gross, total_deductions, total_net, num_payments, num_songwriters
    FROM sums JOIN {{songs}} USING (song_id) WHERE lower(genre) = '{GENRE}'
    ORDER BY rank LIMIT 80""", "rank"),
)
def _(t):
    return L.get_top_royalty_songs(t.songs, t.royalty_payments, 80, GENRE, PERIOD)


@CAT.add(
    "song_royalties",
    f"""SELECT p.song_id, title, artist_name, isrc_code, p.songwriter_id, w.name AS songwriter_name,
        payment_period, gross_amount, deductions, net_amount, payment_status,
        CAST(payment_date AS VARCHAR) AS payment_date
        FROM {{royalty_payments}} p JOIN {{songs}} s USING (song_id)
             LEFT JOIN {{songwriters}} w ON w.songwriter_id = p.songwriter_id
        WHERE contains(lower(title), '{TERM}')""",
)
def _(t):
    return L.lookup_song_royalties(t.songs, t.royalty_payments, t.songwriters, TERM)


# Weights are added as decimals, so the sum has no order; the percentage is rounded half up in integers.
_SPLITS = f"""
    WITH weighed AS (
        SELECT song_id, title, songwriter_id, w.name AS songwriter_name, pro_affiliation, gross,
               split_percentage AS raw, CAST(split_percentage AS DECIMAL(18, 9)) AS exact,
               sum(CAST(split_percentage AS DECIMAL(18, 9))) OVER (PARTITION BY song_id) AS whole
        FROM (SELECT song_id, {sql_money("gross_amount")} AS gross
              FROM {{royalty_payments}} GROUP BY song_id)
             JOIN {{song_writers}} USING (song_id) JOIN {{songs}} USING (song_id)
             LEFT JOIN {{songwriters}} w USING (songwriter_id)),
    listed AS (
        SELECT *, raw / CAST(whole AS DOUBLE) AS part,
               CAST(exact * 1000000000 AS HUGEINT) AS units, CAST(whole * 1000000000 AS HUGEINT) AS all_units
        FROM weighed)
    SELECT song_id, title, CAST(songwriter_id AS VARCHAR) AS songwriter_id, songwriter_name, pro_affiliation,
           CAST((20000 * units + all_units) // (2 * all_units) AS DOUBLE) / 100 AS split_percentage,
           {sql_round("gross * part", 2)} AS gross_share,
           {sql_round("gross * part * CAST(0.15 AS DOUBLE)", 2)} AS estimated_deductions,
           {sql_round("gross * part * CAST(0.85 AS DOUBLE)", 2)} AS net_share
    FROM listed"""


@CAT.add("royalty_split", _SPLITS)
def _(t):
    from royaltide.functions.columns import money_sum

    asks = t.royalty_payments.groupBy("song_id").agg(money_sum("gross_amount").alias("gross_amount"))
    return L.royalty_splits(asks, songs_with_writers(t), t.songwriters)


@CAT.add(
    "licensing_summary",
    f"""WITH hits AS (
        SELECT song_id, title AS search_match,
               CASE WHEN contains(lower(title), '{TERM}') THEN 'title' ELSE 'artist' END AS match_type
        FROM {{songs}} WHERE contains(lower(title), '{TERM}') OR contains(lower(artist_name), '{TERM}')),
    held AS (SELECT * FROM hits JOIN {{licenses}} USING (song_id)),
    kinds AS (SELECT search_match, match_type, license_type, count(*) AS license_type_count,
                     {sql_money("fee_amount")} AS license_type_revenue
              FROM held GROUP BY ALL),
    whole AS (SELECT search_match, count(*) FILTER (end_date >= DATE '{AS_OF_DATE}') AS total_active_licenses,
                     {sql_money("fee_amount")} AS total_license_revenue
              FROM held GROUP BY search_match),
    places AS (SELECT search_match, territory,
                      row_number() OVER (PARTITION BY search_match ORDER BY count(*) DESC, territory) AS pos
               FROM held GROUP BY search_match, territory),
    named AS (SELECT search_match, string_agg(territory, ', ' ORDER BY pos) AS top_territories
              FROM places WHERE pos <= 5 GROUP BY search_match)
    SELECT * FROM kinds JOIN whole USING (search_match) JOIN named USING (search_match)""",
)
def _(t):
    return L.get_licensing_summary(t.songs, t.licenses, TERM, AS_OF_DATE)


@CAT.add(
    "songwriter_earnings",
    f"""SELECT songwriter_id, name AS songwriter_name, pro_affiliation, payment_period,
        {sql_money("gross_amount")} AS total_gross, {sql_money("deductions")} AS total_deductions,
        {sql_money("net_amount")} AS total_net, count(*) AS num_payments,
        count(DISTINCT song_id) AS num_songs
        FROM {{songwriters}} JOIN {{royalty_payments}} USING (songwriter_id)
        WHERE contains(lower(name), 'supplier')
        GROUP BY songwriter_id, name, pro_affiliation, payment_period""",
)
def _(t):
    return L.lookup_songwriter_earnings(t.songwriters, t.royalty_payments, "SUPPLIER")


def _overview_sql(genre):
    kept = f"SELECT * FROM {{songs}} WHERE lower(genre) = '{genre}'" if genre else "SELECT * FROM {songs}"
    return f"""WITH base AS ({kept}),
    paid AS (SELECT genre, artist_name, {sql_cents("gross_amount")} AS g, {sql_cents("net_amount")} AS n
             FROM {{royalty_payments}} JOIN base USING (song_id)),
    held AS (SELECT end_date FROM {{licenses}} SEMI JOIN base USING (song_id))
    SELECT (SELECT count(*) FROM base) AS total_songs,
           (SELECT count(DISTINCT artist_name) FROM base) AS total_artists,
           (SELECT count(DISTINCT songwriter_id) FROM {{songwriters}}) AS total_songwriters,
           (SELECT count(DISTINCT genre) FROM base) AS total_genres,
           (SELECT CAST(sum(g) AS DOUBLE) / 100 FROM paid) AS total_gross_revenue,
           (SELECT CAST(sum(n) AS DOUBLE) / 100 FROM paid) AS total_net_revenue,
           (SELECT count(*) FROM held) AS total_licenses,
           (SELECT count(*) FILTER (end_date >= DATE '{AS_OF_DATE}') FROM held) AS active_licenses,
           {sql_round("(SELECT CAST(sum(n) AS DOUBLE) / 100 FROM paid) / (SELECT count(*) FROM base)", 2)}
               AS avg_royalty_per_song,
           (SELECT genre FROM paid GROUP BY genre ORDER BY sum(n) DESC, genre LIMIT 1) AS top_genre,
           (SELECT artist_name FROM paid GROUP BY artist_name ORDER BY sum(n) DESC, artist_name LIMIT 1)
               AS top_artist"""


@CAT.add("catalog_overview", _overview_sql(None))
def _(t):
    return L.get_catalog_overview(
        t.songs, t.royalty_payments, t.licenses, t.songwriters, AS_OF_DATE
    )


@CAT.add("catalog_overview_by_genre", _overview_sql(GENRE))
def _(t):
    return L.get_catalog_overview(
        t.songs, t.royalty_payments, t.licenses, t.songwriters, AS_OF_DATE, GENRE.title()
    )


@CAT.add(
    "revenue_by_territory",
    f"""WITH fees AS (SELECT *, {sql_cents("fee_amount")} AS c FROM {{licenses}}),
    figures AS (
        SELECT territory, count(*) AS total_licenses,
               count(*) FILTER (end_date >= DATE '{AS_OF_DATE}') AS active_licenses,
               CAST(sum(c) AS DOUBLE) / 100 AS total_revenue,
               {sql_round("CAST(sum(c) AS DOUBLE) / 100 / count(*)", 2)} AS avg_fee_per_license,
               count(DISTINCT song_id) AS num_songs
        FROM fees GROUP BY territory),
    kinds AS (SELECT territory, license_type AS top_license_type FROM fees GROUP BY territory, license_type
              QUALIFY row_number() OVER (PARTITION BY territory ORDER BY sum(c) DESC, license_type) = 1),
    partners AS (SELECT territory, licensee_name AS top_licensee FROM fees GROUP BY territory, licensee_name
              QUALIFY row_number() OVER (PARTITION BY territory ORDER BY sum(c) DESC, licensee_name) = 1)
    SELECT * FROM figures JOIN kinds USING (territory) JOIN partners USING (territory)""",
)
def _(t):
    return L.get_revenue_by_territory(t.licenses, AS_OF_DATE, "null")


def _platform_sql(condition):
    return f"""WITH heard AS (
        SELECT platform, song_id, title, territory, duration_played
        FROM {{performance_logs}} JOIN {{songs}} USING (song_id) WHERE {condition}),
    figures AS (
        SELECT platform, count(*) AS total_plays,
               {sql_round("CAST(sum(duration_played) AS DOUBLE) / 3600", 1)} AS total_play_hours,
               count(DISTINCT song_id) AS num_songs, count(DISTINCT territory) AS num_territories,
               {sql_round("CAST(count(*) AS DOUBLE) / count(DISTINCT song_id)", 1)} AS avg_plays_per_song
        FROM heard GROUP BY platform),
    best AS (SELECT platform, title AS top_song_title, count(*) AS top_song_plays
             FROM heard GROUP BY platform, title
             QUALIFY row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, title) = 1)
    SELECT * FROM figures JOIN best USING (platform)"""


@CAT.add("platform_performance", _platform_sql("true"))
def _(t):
    return L.get_platform_performance(t.songs, t.performance_logs)


@CAT.add(
    "platform_performance_filtered",
    _platform_sql("(contains(lower(title), 'brand#1') OR contains(lower(artist_name), 'brand#1')) AND platform = 'click'"),
)
def _(t):
    return L.get_platform_performance(t.songs, t.performance_logs, "Brand#1", "CLICK")


_TERMS = """
    SELECT DISTINCT artist_name AS term FROM {songs}
    UNION SELECT genre FROM {songs}
    UNION SELECT upper(title) FROM {songs}
    UNION SELECT 'qz-' || CAST(songwriter_id AS VARCHAR(20)) FROM {songwriters}
    UNION SELECT CAST(songwriter_id AS VARCHAR(20)) FROM {songwriters}"""


@CAT.add(
    "resolve_terms",
    f"""WITH terms AS ({_TERMS})
    SELECT term, song_id,
           CASE WHEN CAST(song_id AS VARCHAR) = term THEN 'song_id'
                WHEN upper(isrc_code) = upper(term) THEN 'isrc_code'
                WHEN contains(lower(title), lower(term)) THEN 'title'
                ELSE 'artist_name' END AS match_type
    FROM terms JOIN {{songs}}
      ON CAST(song_id AS VARCHAR) = term OR upper(isrc_code) = upper(term)
         OR contains(lower(title), lower(term)) OR contains(lower(artist_name), lower(term))""",
)
def _(t):
    terms = t.spark.sql(_TERMS, songs=t.songs, songwriters=t.songwriters)
    return resolve_terms(terms, t.songs, "song_id", "isrc_code", ["title", "artist_name"])


@CAT.add(
    "top_per_group",
    sql_int(f"""SELECT territory, licensee_name, count(*) AS licenses,
        row_number() OVER (PARTITION BY territory ORDER BY count(*) DESC, licensee_name) AS rank
        FROM {{licenses}} GROUP BY territory, licensee_name QUALIFY rank <= 3""", "rank"),
)
def _(t):
    return top_per_group(
        t.licenses, ["territory"], "licensee_name", F.count(F.lit(1)), n=3, name="licenses"
    )


@CAT.add(
    "optional_filter",
    """SELECT platform, territory, count(*) AS plays FROM {performance_logs}
       WHERE platform = 'purchase' GROUP BY platform, territory""",
)
def _(t):
    from royaltide.functions.columns import all_of, optional_eq

    wanted = all_of([optional_eq("platform", "PURCHASE"), optional_eq("territory", "Null")])
    return t.performance_logs.where(wanted).groupBy("platform", "territory").agg(
        F.count(F.lit(1)).alias("plays")
    )
