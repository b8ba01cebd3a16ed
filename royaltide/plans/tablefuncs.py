"""The lookups called as SQL table functions."""

from pyspark.sql import functions as F

from royaltide.functions.tablefuncs import register, term_weights
from royaltide.plans import lookups as K
from royaltide.plans.common import AS_OF_DATE, Catalogue
from royaltide.plans.search import metadata
from royaltide.plans.search import CAT as SEARCH

CAT = Catalogue()


def call(t, text, search=False):
    views = {
        "songs": K.songs_with_writers(t),
        "songwriters": t.songwriters,
        "royalty_payments": t.royalty_payments,
        "licenses": t.licenses,
        "performance_logs": t.performance_logs,
    }
    if search:
        views["song_terms"] = term_weights(metadata(t))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    register(t.spark)
    return t.spark.sql(text)


_CALLS = {
    "sql_song_royalties": ("song_royalties", f"SELECT * FROM lookup_song_royalties('{K.TERM}')"),
    "sql_licensing_summary": (
        "licensing_summary",
        f"SELECT * FROM get_licensing_summary(search_term => '{K.TERM}', as_of => DATE '{AS_OF_DATE}')",
    ),
    "sql_songwriter_earnings": (
        "songwriter_earnings", "SELECT * FROM lookup_songwriter_earnings('SUPPLIER')"
    ),
    "sql_top_royalty_songs": ("top_royalty_songs", "SELECT * FROM get_top_royalty_songs()"),
    "sql_top_royalty_songs_filtered": (
        "top_royalty_songs_filtered",
        f"SELECT * FROM get_top_royalty_songs(80, '{K.GENRE}', filter_period => '{K.PERIOD}')",
    ),
    "sql_catalog_overview": (
        "catalog_overview_by_genre",
        f"SELECT * FROM get_catalog_overview('{K.GENRE}', DATE '{AS_OF_DATE}')",
    ),
    "sql_revenue_by_territory": (
        "revenue_by_territory",
        f"SELECT * FROM get_revenue_by_territory(as_of => DATE '{AS_OF_DATE}')",
    ),
    "sql_platform_performance": (
        "platform_performance_filtered",
        "SELECT * FROM get_platform_performance('Brand#1', 'click')",
    ),
    "sql_royalty_split": (
        "royalty_split",
        """SELECT s.* FROM (SELECT song_id AS id, sum(floor(gross_amount * 100 + 0.5D)) / 100 AS gross
           FROM royalty_payments GROUP BY song_id) p, LATERAL calculate_royalty_split(p.id, p.gross) s""",
    ),
}


def _add(name, like, text):
    @CAT.add(name)
    def _(t):
        return call(t, text)

    CAT.checks[name] = K.CAT.checks[like]


for _name, (_like, _text) in _CALLS.items():
    _add(_name, _like, _text)


@CAT.add("sql_search_song_catalog")
def _(t):
    out = call(
        t,
        """SELECT q.query_id, s.* FROM (SELECT DISTINCT 'find ' || lower(genre) || ' by ' || artist_name
           AS query_id FROM songs) q, LATERAL search_song_catalog(q.query_id) s""",
        search=True,
    )
    return out.withColumn("similarity_score", F.round("similarity_score", 9))


CAT.checks["sql_search_song_catalog"] = SEARCH.checks["search_song_catalog"]
