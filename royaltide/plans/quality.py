"""Expectations and ingestion metrics over the play log."""

from royaltide.operators import quality as Q
from royaltide.plans.common import Catalogue

CAT = Catalogue()

DOMAIN = [f"T{i}" for i in range(12)]


def _rules():
    return [
        Q.matches("song_id", "^[0-9]{1,2}$", "is_valid_song_id", "valid_song_ids"),
        Q.inside("duration_played", 0, 40, "is_valid_duration", "valid_durations"),
        Q.member("territory", DOMAIN, "is_valid_territory", "valid_territories"),
    ]


_FLAGS = """
    regexp_matches(CAST(song_id AS VARCHAR), '^[0-9]{1,2}$') AS is_valid_song_id,
    duration_played > 0 AND duration_played < 40 AS is_valid_duration,
    territory IN ('T0','T1','T2','T3','T4','T5','T6','T7','T8','T9','T10','T11') AS is_valid_territory"""


@CAT.add("check_rows", f"SELECT log_id, {_FLAGS} FROM {{performance_logs}}")
def _(t):
    flagged = Q.check_rows(t.performance_logs, _rules())
    return flagged.select("log_id", *[r.flag for r in _rules()])


@CAT.add(
    "check_summary",
    f"""SELECT count(*) AS total_records,
        count(*) FILTER (is_valid_song_id) AS valid_song_ids,
        count(*) FILTER (is_valid_duration) AS valid_durations,
        count(*) FILTER (is_valid_territory) AS valid_territories
        FROM (SELECT {_FLAGS} FROM {{performance_logs}})""",
)
def _(t):
    return Q.check_summary(t.performance_logs, _rules())


@CAT.add(
    "volume_by_platform",
    """SELECT platform, count(*) AS play_count,
       CAST(sum(duration_played) AS DOUBLE) / count(duration_played) AS avg_duration
       FROM {performance_logs} GROUP BY platform""",
)
def _(t):
    return Q.volume_by(t.performance_logs, "platform", "duration_played")


@CAT.add(
    "reach_by_territory",
    """SELECT territory, count(*) AS play_count, count(DISTINCT song_id) AS unique_songs
       FROM {performance_logs} GROUP BY territory""",
)
def _(t):
    return Q.reach_by(t.performance_logs, "territory", "song_id")


@CAT.add(
    "ingestion_cardinality",
    """SELECT count(*) AS total_records, count(DISTINCT platform) AS platforms,
       count(DISTINCT territory) AS territories FROM {performance_logs}""",
)
def _(t):
    return Q.cardinality(t.performance_logs, {"platform": "platforms", "territory": "territories"})
