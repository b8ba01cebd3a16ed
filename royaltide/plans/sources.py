"""Table registry, generators, record handling and change detection."""

from pyspark.sql import functions as F

from royaltide.functions.columns import derive_email, parse_partial_date, split_ids
from royaltide.operators import records as R
from royaltide.operators.quality import TERRITORIES
from royaltide.plans.common import AS_OF_DATE, Catalogue, sql_draw, sql_time
from royaltide.plans.lookups import songs_with_writers
from royaltide.session import scratch_path
from royaltide.sources import generate as N
from royaltide.sources.files import replace_table, write_records
from royaltide.sources.registry import RAW_TABLES, load_tables, row_counts, value_counts

CAT = Catalogue()
SEED = 42
AS_OF = "2025-06-30"


@CAT.add(
    "load_tables",
    """SELECT o_orderpriority, count(*) AS lines, count(DISTINCT o_orderkey) AS orders
       FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
)
def _(t):
    load_tables(t.spark, t.sf_dir, ["orders", "lineitem"])
    return t.spark.sql(
        """SELECT o_orderpriority, count(*) AS lines, count(DISTINCT o_orderkey) AS orders
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"""
    )


@CAT.add(
    "row_counts",
    " UNION ALL ".join(f'SELECT \'{n}\' AS "table", count(*) AS row_count FROM {n}' for n in RAW_TABLES),
)
def _(t):
    return row_counts(load_tables(t.spark, t.sf_dir, views=False))


@CAT.add("value_counts", "SELECT genre, count(*) AS count FROM {songs} GROUP BY genre")
def _(t):
    return value_counts(t.songs, "genre")


@CAT.add("replace_table", "SELECT song_id, title, genre FROM {songs}")
def _(t):
    path = scratch_path(t.spark, "replaced")
    replace_table(t.songs.select("song_id", "artist_name"), path)
    replace_table(t.songs.select("song_id", "title", "genre"), path)
    return t.spark.read.parquet(path)


@CAT.add(
    "write_records",
    "SELECT conv_id, turn, question, expected, query_type FROM {eval_pairs}",
)
def _(t):
    path = scratch_path(t.spark, "records")
    columns = ["conv_id", "turn", "question", "expected", "query_type"]
    write_records(t.eval_pairs.select(*columns), path)
    return t.spark.read.schema(
        "conv_id long, turn long, question string, expected string, query_type string"
    ).json(path)


# --- generators --------------------------------------------------------------------


def _between(row, stream, low, high):
    return f"({low} + ({sql_draw(row, stream, SEED)}) % {high - low + 1})"


def _choice(row, stream, values):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[1 + ({sql_draw(row, stream, SEED)}) % {len(values)}]"


_DRAWN = f"""numbered AS (SELECT p_partkey AS song_id, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM {{part}}),
drawn AS (SELECT n, ({sql_draw("n", 0, SEED)}) % (SELECT count(*) FROM {{part}}) AS pos
          FROM (SELECT unnest(range(1, 3 * (SELECT count(*) FROM {{part}}) + 1)) AS n)),
rows_ AS (SELECT n, song_id FROM drawn JOIN numbered USING (pos))"""


def _count(t):
    return 3 * t.part.count()


_KINDS = list(N.LICENSE_FEES)
_LOWS = "[" + ", ".join(str(v[0] * 100) for v in N.LICENSE_FEES.values()) + "]"
_HIGHS = "[" + ", ".join(str(v[1] * 100) for v in N.LICENSE_FEES.values()) + "]"


@CAT.add(
    "generate_licenses",
    f"""WITH {_DRAWN},
    typed AS (SELECT *, 1 + ({sql_draw("n", 2, SEED)}) % 6 AS kind,
                     DATE '{AS_OF}' - CAST({_between("n", 4, 0, 1825)} AS INT) AS started FROM rows_)
    SELECT printf('LIC%07d', n) AS license_id, song_id,
           {_choice("n", 1, N.LICENSEES)} AS licensee_name,
           (['streaming','radio','live_venue','digital','sync','mechanical'])[kind] AS license_type,
           {_choice("n", 3, TERRITORIES)} AS territory,
           CAST(started AS VARCHAR) AS start_date,
           CAST(started + CAST(365 * {_between("n", 5, 1, 5)} AS INT) AS VARCHAR) AS end_date,
           CAST({_LOWS}[kind] + ({sql_draw("n", 6, SEED)}) % ({_HIGHS}[kind] - {_LOWS}[kind] + 1) AS DOUBLE) / 100
               AS fee_amount
    FROM typed""",
)
def _(t):
    return N.gen_licenses(t.spark, _count(t), t.songs, AS_OF, SEED)


@CAT.add(
    "generate_plays",
    f"""WITH {_DRAWN},
    timed AS (SELECT *, TIMESTAMP '{AS_OF}' - to_hours(CAST({_between("n", 1, 0, 365)} * 24
                     + {_between("n", 2, 0, 23)} AS INT)) AS played FROM rows_)
    SELECT printf('LOG%08d', n) AS log_id, song_id, {_choice("n", 3, N.PLATFORMS)} AS platform,
           {sql_time("played")} AS play_timestamp, {_choice("n", 4, TERRITORIES)} AS territory,
           {_between("n", 5, 30, 420)} AS duration_played,
           {_choice("n", 6, N.LICENSEES[:10])} AS reported_by
    FROM timed""",
)
def _(t):
    return N.gen_plays(t.spark, _count(t), t.songs, AS_OF, SEED)


@CAT.add(
    "generate_payments",
    f"""WITH credits AS (SELECT song_id, list(songwriter_id ORDER BY songwriter_id) AS writers
                         FROM {{song_writers}} GROUP BY song_id),
    numbered AS (SELECT *, row_number() OVER (ORDER BY song_id) - 1 AS pos FROM credits),
    drawn AS (SELECT n, ({sql_draw("n", 0, SEED)}) % (SELECT count(*) FROM credits) AS pos
              FROM (SELECT unnest(range(1, 3 * (SELECT count(*) FROM {{part}}) + 1)) AS n)),
    base AS (SELECT n, song_id, writers[1 + ({sql_draw("n", 1, SEED)}) % len(writers)] AS songwriter_id,
                    {_between("n", 2, 0, 15)} AS q, {_between("n", 3, 10000, 1500000)} AS g,
                    {_between("n", 4, 1000, 2500)} AS r, ({sql_draw("n", 5, SEED)}) % 100 AS luck,
                    {_between("n", 6, 30, 90)} AS lag
             FROM drawn JOIN numbered USING (pos)),
    priced AS (SELECT *, (g * r + 5000) // 10000 AS d,
                      CASE WHEN luck < 80 THEN 'completed' WHEN luck < 88 THEN 'pending'
                           WHEN luck < 94 THEN 'processing' WHEN luck < 98 THEN 'disputed'
                           ELSE 'on_hold' END AS payment_status FROM base)
    SELECT printf('PAY%07d', n) AS payment_id, song_id, songwriter_id,
           CAST(2022 + q // 4 AS VARCHAR) || '-Q' || CAST(q % 4 + 1 AS VARCHAR) AS payment_period,
           CAST(g AS DOUBLE) / 100 AS gross_amount, CAST(d AS DOUBLE) / 100 AS deductions,
           CAST(g - d AS DOUBLE) / 100 AS net_amount, payment_status,
           CASE WHEN payment_status = 'completed' THEN CAST(make_date(2022 + q // 4, (q % 4 + 1) * 3, 28)
                + CAST(lag AS INT) AS VARCHAR) END AS payment_date
    FROM priced""",
)
def _(t):
    writers = t.song_writers.groupBy("song_id").agg(
        F.sort_array(F.collect_list("songwriter_id")).alias("writers")
    )
    return N.gen_payments(t.spark, _count(t), writers, SEED)


# --- nested records ------------------------------------------------------------------


def seed_list(t):
    """The songs to look up, one per order."""
    return t.orders.select(
        F.col("o_orderkey").alias("seed_id"),
        F.concat(F.lit("Seed "), "o_orderkey").alias("title"),
        F.col("o_orderstatus").alias("artist"),
        F.col("o_orderpriority").alias("genre"),
    )


def raw_records(t):
    """One JSON record per order, its order lines as nested lists."""
    role = F.element_at(
        F.array(*[F.lit(r) for r in ("composer", "arranger", "lyricist", "writer")]),
        (F.col("l_suppkey") % 4 + 1).cast("int"),
    )
    person = F.struct(
        role.alias("type"),
        F.struct(F.concat(F.lit("W"), F.col("l_suppkey") % 7).alias("name")).alias("artist"),
    )
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "A", "performance").otherwise("recording").alias("type"),
        person.alias("person"),
        F.date_format("l_shipdate", "yyyy-MM").alias("date"),
    )
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(line)).alias("lines")
    )
    kind = F.col("o_orderkey") % 5
    whole = F.struct(
        F.when(
            kind != 0,
            F.array(
                F.struct(
                    F.col("o_orderkey").cast("string").alias("id"),
                    F.when(kind != 1, F.concat(F.lit("Take "), "o_orderkey")).alias("title"),
                    F.col("o_orderpriority").alias("artist-credit-phrase"),
                    F.when(kind != 2, F.floor(F.col("o_totalprice")).cast("string")).alias("length"),
                )
            ),
        ).alias("recording-list"),
        F.floor(F.col("o_totalprice") * 2).cast("string").alias("length"),
        F.transform("lines", lambda x: x["l_partkey"].cast("string")).alias("isrc-list"),
        F.transform(
            "lines", lambda x: F.struct(F.when(x["l_linenumber"] > 1, x["date"]).alias("date"))
        ).alias("release-list"),
        F.transform(
            "lines",
            lambda x: F.struct(
                x["type"].alias("type"),
                F.struct(
                    x["l_partkey"].cast("string").alias("id"),
                    F.transform("lines", lambda y: y["person"]).alias("artist-relation-list"),
                ).alias("work"),
            ),
        ).alias("work-relation-list"),
    )
    return t.orders.join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("seed_id"),
        F.concat(F.lit("Seed "), "o_orderkey").alias("title"),
        F.col("o_orderstatus").alias("artist"),
        F.col("o_orderpriority").alias("genre"),
        F.to_json(whole).alias("record"),
    )


_RECORDS = """lines AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_returnflag = 'A' THEN 'performance' ELSE 'recording' END,
               strftime(l_shipdate, '%Y-%m')) AS pos
    FROM {lineitem}),
people AS (SELECT l_orderkey, 'W' || CAST(l_suppkey % 7 AS VARCHAR) AS name, min(pos) AS pos
           FROM lines WHERE l_suppkey % 4 <> 1 GROUP BY ALL),
credits AS (SELECT l_orderkey, string_agg(name, ',' ORDER BY pos) AS names FROM people GROUP BY 1),
flat AS (
    SELECT o_orderkey AS seed_id, o_orderkey % 5 <> 0 AS is_match,
        CASE WHEN o_orderkey % 5 <> 1 THEN 'Take ' ELSE 'Seed ' END || CAST(o_orderkey AS VARCHAR) AS title,
        o_orderpriority AS artist,
        CASE WHEN EXISTS (SELECT 1 FROM lines x WHERE x.l_orderkey = o_orderkey AND l_returnflag = 'A')
             THEN coalesce(names, '') ELSE '' END AS writers,
        (SELECT CAST(min_by(l_partkey, pos) AS VARCHAR) FROM lines x WHERE x.l_orderkey = o_orderkey) AS isrc,
        (SELECT strftime(min_by(l_shipdate, pos), '%Y-%m') FROM lines x
         WHERE x.l_orderkey = o_orderkey AND l_linenumber > 1) AS release_date,
        CAST(CASE WHEN o_orderkey % 5 <> 2 AND floor(o_totalprice) >= 1000 THEN floor(floor(o_totalprice) / 1000)
                  ELSE floor(floor(o_totalprice * 2) / 1000) END AS BIGINT) AS duration_seconds
    FROM {orders} LEFT JOIN credits ON l_orderkey = o_orderkey)"""


def _normalised(t):
    return R.normalise_records(raw_records(t), "record", "title", "artist")


@CAT.add(
    "normalise_records",
    f"""WITH {_RECORDS} SELECT seed_id, is_match, CASE WHEN is_match THEN title END AS title,
        CASE WHEN is_match THEN artist END AS artist, CASE WHEN is_match THEN writers END AS writers,
        CASE WHEN is_match THEN isrc END AS isrc, CASE WHEN is_match THEN release_date END AS release_date,
        CASE WHEN is_match THEN duration_seconds END AS duration_seconds FROM flat""",
)
def _(t):
    columns = ["seed_id", "is_match", "title", "artist", "isrc", "release_date", "duration_seconds"]
    return _normalised(t).select(*columns, F.array_join("writers", ",").alias("writers"))


_LETTERS = " || ".join(f"chr(CAST({_between('seed_id', s, 65, 90)} AS INT))" for s in (2, 3, 4))
_ENRICHED = f"""{_RECORDS},
good AS (SELECT * FROM flat WHERE is_match AND writers <> ''),
enriched AS (
    SELECT o_orderkey AS seed_id, coalesce(g.title, 'Seed ' || CAST(o_orderkey AS VARCHAR)) AS title,
           coalesce(g.artist, o_orderstatus) AS artist_name, o_orderpriority AS genre,
           coalesce(g.writers, o_orderstatus) AS writers, isrc, release_date, duration_seconds,
           g.seed_id IS NOT NULL AS is_matched
    FROM {{orders}} LEFT JOIN good g ON g.seed_id = o_orderkey)"""


def _enriched(t):
    # The lines of an order fill its record only; the list of seeds does not need them.
    return R.enrich_with_fallback(seed_list(t), _normalised(t), AS_OF_DATE, seed=SEED)


@CAT.add(
    "enrich_with_fallback",
    f"""WITH {_ENRICHED}
    SELECT seed_id, title, artist_name, genre, writers, is_matched,
        coalesce(isrc, {_choice("seed_id", 1, ("US", "GB", "CA", "AU"))} || {_LETTERS}
            || CAST({_between("seed_id", 5, 18, 25)} AS VARCHAR)
            || CAST({_between("seed_id", 6, 10000, 99999)} AS VARCHAR)) AS isrc_code,
        CAST(coalesce(CAST(try_strptime(release_date, '%Y-%m') AS DATE),
            DATE '{AS_OF_DATE}' - CAST({_between("seed_id", 7, 0, 10950)} AS INT)) AS VARCHAR) AS release_date,
        coalesce(nullif(duration_seconds, 0), {_between("seed_id", 8, 150, 360)}) AS duration_seconds
    FROM enriched""",
)
def _(t):
    return _enriched(t).withColumn("writers", F.array_join("writers", ","))


@CAT.add(
    "match_report",
    f"""WITH {_ENRICHED} SELECT count(*) FILTER (is_matched) AS matched,
        count(*) FILTER (NOT is_matched) AS fallback FROM enriched""",
)
def _(t):
    return R.match_report(_enriched(t))


_DATE_TEXT = """CASE o_orderkey % 7
    WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT00')
    WHEN 4 THEN strftime(o_orderdate, '%m') WHEN 5 THEN 'abcd-ef' END"""


@CAT.add(
    "partial_dates",
    f"""SELECT o_orderkey, CAST(CASE o_orderkey % 7
            WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate)
            WHEN 2 THEN o_orderdate WHEN 3 THEN o_orderdate END AS DATE)::VARCHAR AS parsed
        FROM {{orders}}""",
)
def _(t):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy"))
        .when(kind == 1, F.date_format(day, "yyyy-MM"))
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00")))
        .when(kind == 4, F.date_format(day, "MM"))
        .when(kind == 5, F.lit("abcd-ef"))
    )
    return t.orders.select("o_orderkey", parse_partial_date(text).alias("parsed"))


def _writer_lists(t):
    """Names of the customers that ordered each part, as a list per part."""
    return (
        t.licenses.select("song_id", "licensee_name").distinct()
        .groupBy("song_id")
        .agg(F.sort_array(F.collect_list("licensee_name"), asc=False).alias("names"))
    )


_NAMED = """named AS (SELECT name, printf('SW%05d', row_number() OVER (ORDER BY name)) AS id
    FROM (SELECT DISTINCT licensee_name AS name FROM {licenses}))"""


@CAT.add("assign_ids", f"WITH {_NAMED} SELECT id, name FROM named")
def _(t):
    return R.assign_ids(_writer_lists(t), "names")


@CAT.add(
    "map_list_to_ids",
    f"""WITH {_NAMED} SELECT song_id, string_agg(id, ',' ORDER BY name DESC) AS ids
        FROM (SELECT DISTINCT song_id, licensee_name AS name FROM {{licenses}})
             JOIN named USING (name) GROUP BY song_id""",
)
def _(t):
    lists = _writer_lists(t)
    return R.map_list_to_ids(lists, "names", R.assign_ids(lists, "names"), "song_id").select(
        "song_id", "ids"
    )


@CAT.add(
    "split_ids",
    "SELECT song_id, CAST(songwriter_id AS VARCHAR) AS songwriter_id FROM {song_writers}",
)
def _(t):
    return songs_with_writers(t).select(
        "song_id", F.explode(split_ids("songwriters")).alias("songwriter_id")
    )


@CAT.add(
    "derive_email",
    """SELECT p_partkey, CASE p_partkey % 3
        WHEN 0 THEN 'oneil.' || split_part(p_name, ' ', 1) WHEN 1 THEN lower(p_brand)
        ELSE replace(p_name, ' ', '.') END || '@email.com' AS email FROM {part}""",
)
def _(t):
    kind = F.col("p_partkey") % 3
    name = (
        F.when(kind == 0, F.concat(F.lit("O'Neil  "), "p_name", F.lit(" Jr.")))
        .when(kind == 1, F.concat(F.lit(" "), "p_brand"))
        .otherwise(F.concat("p_name", F.lit(" III")))
    )
    return t.part.select("p_partkey", derive_email(name).alias("email"))


def _snapshots(t):
    """Two snapshots of the parts: a type is gone, a brand is new, some values changed."""
    old = t.part.where("p_brand <> 'Brand#1'").select("p_partkey", "p_name", "p_type", "p_size")
    new = t.part.where("p_type <> 'ECONOMY'").select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_size") > 5, F.col("p_type")).alias("p_type"),
        (F.col("p_size") + F.when(F.col("p_name").startswith("red"), 1).otherwise(0)).alias("p_size"),
    )
    return old, new


@CAT.add(
    "snapshot_diff",
    """WITH o AS (SELECT p_partkey, p_name, p_type, p_size FROM {part} WHERE p_brand <> 'Brand#1'),
    n AS (SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN p_type END AS p_type,
                 p_size + CASE WHEN starts_with(p_name, 'red') THEN 1 ELSE 0 END AS p_size
          FROM {part} WHERE p_type <> 'ECONOMY')
    SELECT *, 'insert' AS change FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)
    UNION ALL SELECT *, 'delete' FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)
    UNION ALL SELECT n.*, 'update' FROM n JOIN o USING (p_partkey)
        WHERE n.p_type IS DISTINCT FROM o.p_type OR n.p_size <> o.p_size""",
)
def _(t):
    old, new = _snapshots(t)
    return R.snapshot_diff(old, new, ["p_partkey"], ["p_name", "p_type", "p_size"])
