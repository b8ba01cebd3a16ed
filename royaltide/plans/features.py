"""Feature queries."""

import datetime

from royaltide.operators import features as X
from royaltide.operators import rolling as R
from royaltide.plans.common import AS_OF_TIME, Catalogue, sql_cents, sql_money, sql_round
from royaltide.session import durable, scratch_path
from royaltide.sources import partitioned as D
from royaltide.sources.files import replace_table

CAT = Catalogue()
DAYS = 14

_POPULAR = f"""
recent AS (SELECT song_id, count(*) AS n FROM {{performance_logs}}
           WHERE play_timestamp >= TIMESTAMP '{AS_OF_TIME}' - INTERVAL {DAYS} DAY GROUP BY song_id),
popular AS (
    SELECT s.song_id, coalesce(n, 0) AS play_count_90d,
           coalesce({sql_round("CAST(n - (SELECT min(n) FROM recent) AS DOUBLE) / ((SELECT max(n) FROM recent) - (SELECT min(n) FROM recent)) * 100", 2)}, 0) AS song_popularity_score
    FROM {{songs}} s LEFT JOIN recent USING (song_id))"""

_PER_PLAY = f"""
heard AS (SELECT song_id, count(*) AS total_plays FROM {{performance_logs}} GROUP BY song_id),
earned AS (SELECT song_id, {sql_money("net_amount")} AS net FROM {{royalty_payments}} GROUP BY song_id),
per_play AS (
    SELECT song_id, total_plays, coalesce(net, 0) AS total_net_royalties,
           {sql_round("coalesce(net, 0) / total_plays", 4)} AS royalty_per_play
    FROM heard LEFT JOIN earned USING (song_id))"""

_SPREAD = f"""
cells AS (SELECT song_id, territory, CAST(count(*) AS DOUBLE) AS n
          FROM {{performance_logs}} GROUP BY song_id, territory),
hhi AS (SELECT song_id, {sql_round("sum(n * n) / (sum(n) * sum(n))", 4)} AS c, count(*) AS k
        FROM cells GROUP BY song_id),
spread AS (SELECT song_id, coalesce(c, 1) AS territory_concentration, coalesce(k, 0) AS num_territories
           FROM {{songs}} LEFT JOIN hhi USING (song_id))"""

_ASSEMBLED = f"""
WITH {_POPULAR}, {_PER_PLAY}, {_SPREAD},
assembled AS (
    SELECT song_id, title, artist_name, genre, play_count_90d, song_popularity_score,
           coalesce(royalty_per_play, 0) AS royalty_per_play,
           coalesce(total_plays, 0) AS total_plays,
           coalesce(total_net_royalties, 0) AS total_net_royalties,
           territory_concentration, num_territories,
           '{AS_OF_TIME}.000000' AS feature_timestamp
    FROM {{songs}} JOIN popular USING (song_id) JOIN spread USING (song_id)
         LEFT JOIN per_play USING (song_id))"""


def _popular(t):
    return X.popularity(t.performance_logs, t.songs, AS_OF_TIME, DAYS)


def _assembled(t):
    return X.song_features(t.songs, t.performance_logs, t.royalty_payments, AS_OF_TIME, DAYS)


@CAT.add("popularity", f"WITH {_POPULAR} SELECT * FROM popular")
def _(t):
    return _popular(t)


@CAT.add("royalty_per_play", f"WITH {_PER_PLAY} SELECT * FROM per_play")
def _(t):
    return X.royalty_per_play(t.performance_logs, t.royalty_payments)


@CAT.add("concentration", f"WITH {_SPREAD} SELECT * FROM spread")
def _(t):
    return X.concentration(t.performance_logs, universe=t.songs)


@CAT.add(
    "licensee_risk",
    f"""WITH fanned AS (
        SELECT l.licensee_name, p.payment_status FROM {{royalty_payments}} p
        LEFT JOIN (SELECT DISTINCT song_id, licensee_name FROM {{licenses}}) l USING (song_id)),
    tallied AS (
        SELECT licensee_name, count(*) AS total_payments,
               count(*) FILTER (payment_status = 'completed') AS completed_payments,
               count(*) FILTER (payment_status = 'disputed') AS disputed_payments,
               count(*) FILTER (payment_status = 'on_hold') AS on_hold_payments,
               count(*) FILTER (payment_status IN ('pending', 'processing')) AS pending_payments
        FROM fanned GROUP BY licensee_name)
    SELECT *, {sql_round("(disputed_payments + on_hold_payments + pending_payments * CAST(0.5 AS DOUBLE)) / total_payments", 4)}
           AS licensee_risk_score FROM tallied""",
)
def _(t):
    return X.licensee_risk(t.royalty_payments, t.licenses)


@CAT.add("assemble_features", f"{_ASSEMBLED} SELECT * FROM assembled")
def _(t):
    return X.assemble_features(
        t.songs,
        _popular(t),
        X.royalty_per_play(t.performance_logs, t.royalty_payments),
        X.concentration(t.performance_logs, universe=t.songs),
        AS_OF_TIME,
    )


@CAT.add("song_features", f"{_ASSEMBLED} SELECT * FROM assembled")
def _(t):
    return _assembled(t)


@CAT.add("publish_features", f"{_ASSEMBLED} SELECT * FROM assembled")
def _(t):
    path = scratch_path(t.spark, "song-features")
    replace_table(_assembled(t), path)
    return t.spark.read.parquet(path)


_TALL = f"""{_ASSEMBLED},
tall AS (SELECT 'song_popularity_score' AS feature, song_popularity_score AS value FROM assembled
         UNION ALL SELECT 'royalty_per_play', royalty_per_play FROM assembled
         UNION ALL SELECT 'territory_concentration', territory_concentration FROM assembled)"""
_MEASURES = ["song_popularity_score", "royalty_per_play", "territory_concentration"]


@CAT.add(
    "feature_summary",
    f"""{_TALL} SELECT feature, count(value) AS count, round(avg(value), 6) AS mean,
        round(stddev_samp(value), 6) AS stddev, min(value) AS min,
        round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS p50,
        round(quantile_cont(value, 0.75), 9) AS p75, max(value) AS max
        FROM tall GROUP BY feature""",
)
def _(t):
    from pyspark.sql import functions as F

    summary = X.feature_summary(_assembled(t), _MEASURES)
    digits = {"mean": 6, "stddev": 6, "p25": 9, "p50": 9, "p75": 9}
    return summary.withColumns({c: F.round(c, d) for c, d in digits.items()})


@CAT.add(
    "feature_histogram",
    f"""{_TALL},
    ends AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM tall GROUP BY feature),
    binned AS (SELECT feature, least(CAST(floor((value - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin,
                      count(*) AS n
               FROM tall JOIN ends USING (feature) GROUP BY 1, 2)
    SELECT e.feature, g.bin, lo + g.bin * ((hi - lo) / 30) AS lower,
           lo + (g.bin + 1) * ((hi - lo) / 30) AS upper, coalesce(n, 0) AS count
    FROM ends e CROSS JOIN (SELECT unnest(range(30)) AS bin) g
         LEFT JOIN binned b ON b.feature = e.feature AND b.bin = g.bin""",
)
def _(t):
    return X.histograms(_assembled(t), _MEASURES)


@CAT.add("popularity_by_date", f"WITH {_POPULAR} SELECT * FROM popular")
def _(t):
    """Plays stored by date; the dates before the window are not read."""
    path = scratch_path(t.spark, "plays")
    D.write_plays(t.performance_logs, path)
    recent = D.recent_plays(t.spark, path, AS_OF_TIME, DAYS)
    return X.popularity(recent, t.songs, AS_OF_TIME, DAYS)


ROLLED = 7


@CAT.add(
    "rolling_popularity",
    f"""WITH recent AS (SELECT song_id, count(*) AS n FROM {{performance_logs}}
        WHERE play_timestamp >= TIMESTAMP '{AS_OF_TIME}' - INTERVAL {ROLLED} DAY AND play_timestamp < TIMESTAMP '{AS_OF_TIME}'
        GROUP BY song_id)
    SELECT s.song_id, coalesce(n, 0) AS play_count_90d,
           coalesce({sql_round("CAST(n - (SELECT min(n) FROM recent) AS DOUBLE) / ((SELECT max(n) FROM recent) - (SELECT min(n) FROM recent)) * 100", 2)}, 0) AS song_popularity_score
    FROM {{songs}} s LEFT JOIN recent USING (song_id)""",
)
def _(t):
    """A window of a week, started five days before the day of the report and moved on day by day."""
    path = scratch_path(t.spark, "daily-plays")
    R.store_days(t.performance_logs, path)
    end = datetime.date.fromisoformat(AS_OF_TIME[:10])
    days = [str(end - datetime.timedelta(n)) for n in range(5, -1, -1)]
    counts = durable(R.window_counts(t.spark, path, days[0], ROLLED))
    for before, after in zip(days, days[1:]):
        counts = durable(R.advance(counts, path, before, after, ROLLED))
    return R.rolling_popularity(counts, t.songs)
