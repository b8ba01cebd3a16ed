"""Nested metadata records: normalisation, enrichment, identifiers, change detection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from royaltide.functions.columns import draw_int, parse_partial_date
from royaltide.operators.ordering import running_weight, spread_join

# Field names of the incoming records.
RECORD_SCHEMA = """struct<
    `recording-list`: array<struct<
        id: string, title: string, `artist-credit-phrase`: string, length: string>>,
    length: string,
    `isrc-list`: array<string>,
    `release-list`: array<struct<date: string>>,
    `work-relation-list`: array<struct<
        type: string,
        work: struct<id: string, `artist-relation-list`: array<struct<
            type: string, artist: struct<name: string>>>>>>>
"""
# Relation types that count as writing.
WRITER_ROLES = ("composer", "lyricist", "writer")

DEFAULT_LENGTH = (150, 360)
DEFAULT_AGE_DAYS = 10950


def normalise_records(
    df: DataFrame,
    json_col: str,
    title_col: str | None = None,
    artist_col: str | None = None,
) -> DataFrame:
    """Flatten a record to title, artist, writers, isrc, release_date, duration_seconds.

    The first recording is the best match. Its length wins over the record's
    own; milliseconds are cut to seconds. Writers come from the first
    ``performance`` relation that has a work, each name once, in order. A record
    without recordings (or that is no JSON) gives NULLs and ``is_match`` false.
    """
    record = F.from_json(F.col(json_col), RECORD_SCHEMA)
    parsed = df.withColumn("_r", record)
    best = F.get(F.col("_r.recording-list"), F.lit(0))
    match = best.isNotNull()

    def seconds(milliseconds: Column) -> Column:
        return F.floor(milliseconds.try_cast("bigint") / 1000)

    def fallback(value: Column, column: str | None) -> Column:
        return value if column is None else F.coalesce(value, F.col(column))

    duration = F.coalesce(
        F.nullif(seconds(best.getField("length")), F.lit(0)), seconds(F.col("_r.length"))
    )
    dated = F.filter(F.col("_r.release-list"), lambda r: F.length(r["date"]) >= 4)
    works = F.filter(
        F.col("_r.work-relation-list"),
        lambda w: (w["type"] == "performance") & w["work"].isNotNull(),
    )
    people = F.get(works, F.lit(0)).getField("work").getField("artist-relation-list")
    credited = F.filter(people, lambda a: a["type"].isin(*WRITER_ROLES))
    names = F.array_distinct(F.transform(credited, lambda a: a["artist"]["name"]))
    fields = {
        "is_match": match,
        "title": F.when(match, fallback(best.getField("title"), title_col)),
        "artist": F.when(match, fallback(best.getField("artist-credit-phrase"), artist_col)),
        "writers": F.when(match, F.coalesce(names, F.array().cast("array<string>"))),
        "isrc": F.when(match, F.get(F.col("_r.isrc-list"), F.lit(0))),
        "release_date": F.when(match, F.get(dated, F.lit(0)).getField("date")),
        "duration_seconds": F.when(match, duration),
    }
    replaced = {c: F.col(c) for c in df.columns if c not in fields}
    return parsed.select(*replaced.values(), *[v.alias(k) for k, v in fields.items()])


def fallback_isrc(row: Column | str, seed: int = 42) -> Column:
    """Plausible, reproducible code for a song without one."""
    country = F.element_at(
        F.array(*[F.lit(c) for c in ("US", "GB", "CA", "AU")]),
        draw_int(row, 1, seed, 1, 4).cast("int"),
    )
    letters = [F.char(draw_int(row, stream, seed, 65, 90)) for stream in (2, 3, 4)]
    year = draw_int(row, 5, seed, 18, 25).cast("string")
    number = draw_int(row, 6, seed, 10000, 99999).cast("string")
    return F.concat(country, *letters, year, number)


def enrich_with_fallback(
    seed_list: DataFrame, records: DataFrame, as_of: str, key: str = "seed_id", seed: int = 42
) -> DataFrame:
    """Seed songs ``(key, title, artist, genre)`` filled from normalised records.

    A record counts only if it names writers. Otherwise the performing artist
    is the writer and the seed's own title and artist stay. Missing codes,
    dates and lengths are drawn from ``key``, so a rerun gives the same values.
    """
    # The filter stands behind a one-row explode: pushed into the records, it would parse each of them once more per column it reads.
    fields = F.struct(*[F.col(c) for c in dict.fromkeys((key, "title", "artist", "writers", "isrc", "release_date", "duration_seconds", "is_match"))])
    whole = records.select(F.explode_outer(F.array(fields)).alias("_record"))
    found = whole.where(F.col("_record.is_match") & (F.size("_record.writers") > 0)).select("_record.*").select(
        key,
        F.col("title").alias("_title"),
        F.col("artist").alias("_artist"),
        "writers",
        F.nullif("isrc", F.lit("")).alias("_isrc"),
        parse_partial_date("release_date").alias("_released"),
        F.nullif("duration_seconds", F.lit(0)).alias("_seconds"),
        F.lit(True).alias("_found"),
    )
    age = draw_int(key, 7, seed, 0, DEFAULT_AGE_DAYS).cast("int")
    drawn_length = draw_int(key, 8, seed, *DEFAULT_LENGTH)
    return seed_list.join(found, key, "left").select(
        key,
        F.coalesce("_title", "title").alias("title"),
        F.coalesce("_artist", "artist").alias("artist_name"),
        "genre",
        F.coalesce("writers", F.array("artist")).alias("writers"),
        F.coalesce("_isrc", fallback_isrc(key, seed)).alias("isrc_code"),
        F.coalesce("_released", F.date_sub(F.lit(as_of).cast("date"), age)).alias("release_date"),
        F.coalesce("_seconds", drawn_length).alias("duration_seconds"),
        F.coalesce("_found", F.lit(False)).alias("is_matched"),
    )


def match_report(enriched: DataFrame) -> DataFrame:
    """How many seeds were matched and how many fell back."""
    return enriched.agg(
        F.count_if("is_matched").alias("matched"), F.count_if(~F.col("is_matched")).alias("fallback")
    )


def assign_ids(df: DataFrame, list_col: str, prefix: str = "SW", width: int = 5) -> DataFrame:
    """Distinct names of all lists with dense ids in alphabetical order.

    Names are reduced before they are ordered; the numbering needs no
    single-task window (see :func:`running_weight`).
    """
    names = (
        df.select(F.explode(list_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    )
    numbered = running_weight(names, ["name"])
    return numbered.select(
        F.format_string(f"{prefix}%0{width}d", F.col("_before") + 1).alias("id"), "name"
    )


def map_list_to_ids(
    df: DataFrame, list_col: str, dim: DataFrame, key: str, name: str = "ids", delimiter: str = ","
) -> DataFrame:
    """Replace the names of a list by their ids, in list order, as delimited text.

    Names missing from ``dim(id, name)`` are left out; a row whose list has no
    known name is dropped. ``key`` is unique. A name that is on very many lists
    is joined in salted pieces.
    """
    listed = df.select(key, F.posexplode(list_col).alias("_pos", "name"))
    ids = (
        spread_join(listed, dim.select("id", "name"), ["name"], [key, "_pos"], how="inner")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "id"))).alias("_ids"))
        .select(key, F.array_join(F.col("_ids.id"), delimiter).alias(name))
    )
    return df.join(ids, key)


def snapshot_diff(
    old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Rows to insert, update or delete to turn ``old`` into ``new``.

    Values are compared NULL-safely and exactly. The result holds the key, the
    new values (the old ones for a delete) and ``change``.
    """
    key, cols = list(key), list(cols)
    left = old.select(*key, F.struct(*cols).alias("_old"), F.lit(True).alias("_in_old"))
    right = new.select(*key, F.struct(*cols).alias("_new"), F.lit(True).alias("_in_new"))
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in cols],
        F.lit(True),
    )
    change = (
        F.when(F.col("_in_old").isNull(), "insert")
        .when(F.col("_in_new").isNull(), "delete")
        .when(~same, "update")
    )
    kept = F.when(F.col("_in_new"), F.col("_new")).otherwise(F.col("_old"))
    return (
        left.join(right, key, "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*key, kept.alias("_row"), "change")
        .select(*key, "_row.*", "change")
    )


def apply_diff(old: DataFrame, diff: DataFrame, key: Sequence[str]) -> DataFrame:
    """Table after the changes; ``apply_diff(old, snapshot_diff(old, new)) == new``."""
    kept = old.join(diff.select(*key), list(key), "left_anti")
    arrived = diff.where(F.col("change") != "delete").drop("change")
    return kept.select(*old.columns).unionByName(arrived.select(*old.columns))
