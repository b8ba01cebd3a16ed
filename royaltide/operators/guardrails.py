"""Guardrail policies as data jobs: sensitive data, keywords, rate limits, traffic splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from royaltide.functions.columns import any_of, hash_bucket, percent
from royaltide.operators.ordering import spread_join


@dataclass(frozen=True)
class PiiPattern:
    """A regex; with ``context`` it only counts in texts holding one of the words.

    ``literal`` is a string every match contains. Texts without it (or without
    any context word) are passed over by a plain substring test, which is far
    cheaper than the regex.
    """

    regex: str
    context: Sequence[str] = ()
    literal: str | None = None

    def context_holds(self, text: Column) -> Column:
        if not self.context:
            return F.lit(True)
        nearby = any_of([text.contains(word) for word in self.context])
        return nearby & text.rlike(r"\b(" + "|".join(self.context) + r")\b")

    def possible(self, text: Column) -> Column:
        holds = self.context_holds(text)
        return holds if self.literal is None else text.contains(self.literal) & holds


# Sensitive-data patterns.
PII_PATTERNS = {
    "email": PiiPattern(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", literal="@"),
    "ipi_number": PiiPattern(r"\b\d{9,11}\b", ("IPI", "ipi", "publisher", "songwriter")),
    "phone": PiiPattern(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    "ssn": PiiPattern(r"\b\d{3}-\d{2}-\d{4}\b", literal="-"),
}
# Phrases refused in requests and in answers.
INPUT_KEYWORDS = (
    "write me a poem", "write a story", "what's the weather", "tell me a joke",
    "who is the president", "calculate math", "translate this",
)
OUTPUT_KEYWORDS = (
    "ASCAP rate schedule", "ASCAP fee structure", "BMI rate schedule", "BMI fee structure",
    "SESAC pricing", "SESAC rates",
)


def pii_hits(text: Column | str, pattern: PiiPattern) -> Column:
    """Number of matches in the whole text; 0 when the context word is missing."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.when(pattern.possible(text), F.regexp_count(text, F.lit(pattern.regex)))
    return F.coalesce(found, F.lit(0))


def detect_pii(
    df: DataFrame,
    text_col: str,
    patterns: Mapping[str, PiiPattern] = PII_PATTERNS,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per text and kind found: ``(keys, pii_type, hits)``."""
    counts = F.array(
        *[
            F.struct(F.lit(name).alias("pii_type"), pii_hits(text_col, p).alias("hits"))
            for name, p in patterns.items()
        ]
    )
    return df.select(*keys, F.inline(counts)).where(F.col("hits") > 0)


def apply_pii_policy(
    df: DataFrame,
    text_col: str,
    patterns: Mapping[str, PiiPattern] = PII_PATTERNS,
    action: str = "BLOCK",
) -> DataFrame:
    """Withhold or redact texts with sensitive data.

    ``BLOCK`` sets the text to NULL; ``REDACT`` puts ``[KIND]`` in place of
    each match. Either way ``blocked`` and ``reason`` say what was found, so no
    row disappears unexplained.
    """
    text = F.col(text_col)
    kinds = F.array_compact(
        F.array(*[F.when(pii_hits(text, p) > 0, F.lit(name)) for name, p in patterns.items()])
    )
    reason = F.when(F.size(kinds) > 0, F.array_join(kinds, ","))
    if action.upper() == "BLOCK":
        marked = df.withColumn("reason", reason)
        blocked = F.col("reason").isNotNull()
        return marked.withColumn("blocked", blocked).withColumn(text_col, F.when(~blocked, text))
    if action.upper() != "REDACT":
        raise ValueError("action is BLOCK or REDACT")

    def redact(current: Column, item: tuple[str, PiiPattern]) -> Column:
        name, pattern = item
        replaced = F.regexp_replace(current, pattern.regex, f"[{name.upper()}]")
        return F.when(pattern.possible(text), replaced).otherwise(current)

    return (
        df.withColumn("reason", reason)
        .withColumn("blocked", F.lit(False))
        .withColumn(text_col, reduce(redact, patterns.items(), text))
    )


def block_keywords(
    df: DataFrame, text_col: str, keywords: Sequence[str] = INPUT_KEYWORDS
) -> DataFrame:
    """Add ``matched_keyword`` (first of the list that occurs) and ``blocked``."""
    lowered = F.lower(text_col)
    listed = F.array(*[F.lit(k) for k in keywords])
    found = F.get(F.filter(listed, lambda k: F.contains(lowered, F.lower(k))), F.lit(0))
    return df.withColumn("matched_keyword", found).withColumn(
        "blocked", F.col("matched_keyword").isNotNull()
    )


@dataclass(frozen=True)
class RateLimit:
    """At most ``calls`` per value of ``key`` in each ``period`` (minute, hour)."""

    name: str
    calls: int
    key: str
    period: str = "MINUTE"


#: Largest rank that Spark turns into a limit of each task (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Default limits.
RATE_LIMITS = (
    RateLimit("user_minute", 10, "requester", "MINUTE"),
    RateLimit("endpoint_minute", 100, "served_entity_id", "MINUTE"),
    RateLimit("endpoint_hour", 1000, "served_entity_id", "HOUR"),
)


def rate_limit(
    requests: DataFrame,
    limits: Sequence[RateLimit] = RATE_LIMITS,
    time_col: str = "request_time",
    id_col: str = "client_request_id",
    salts: int = 16,
) -> DataFrame:
    """Admit or throttle each request under several fixed-window limits.

    Adds one flag per limit and ``admitted``. A window is never gathered whole:
    its first n + 1 requests are found with a per-task top-n (above GROUP_LIMIT calls a top-n per salt), and only a
    window that has so many gives a cut-off, so cut-offs are fewer than the requests by the factor n + 1.
    Every request is then compared with the cut-off of its window; that of a busy window is repeated
    per salt, so its requests are spread over ``salts`` tasks.
    """
    out = requests
    for limit in limits:
        window = F.date_trunc(limit.period, F.col(time_col))
        place = F.struct(F.col(time_col), F.col(id_col))
        order = W.partitionBy("_key", "_window").orderBy(time_col, id_col)
        early = requests.select(F.col(limit.key).alias("_key"), window.alias("_window"), time_col, id_col)
        first = limit.calls + 1
        if first > GROUP_LIMIT:
            # Beyond this Spark cuts no rows ahead of the window: each salt passes on its first rows only.
            part = W.partitionBy("_key", "_window", "_salt").orderBy(time_col, id_col)
            early = (
                early.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
                .withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= first).drop("_salt", "_rank"))
        cutoffs = (
            early.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= first)
            .groupBy("_key", "_window")
            .agg(F.max(F.when(F.col("_rank") <= limit.calls, place)).alias("_last"), F.count(F.lit(1)).alias("_n"))
            # Only a window with more requests than the limit can throttle.
            .where(F.col("_n") == first)
            .select(F.struct(F.col("_key").alias("k")).alias("_k"), F.col("_window").alias("_w"), "_last")
        )
        # Inside a struct null keys are equal, as they are in the windows.
        keyed = out.withColumns({"_k": F.struct(F.col(limit.key).alias("k")), "_w": window})
        joined = spread_join(keyed, cutoffs, ["_k", "_w"], [id_col], salts=salts)
        within = F.col("_last").isNull() | (place <= F.col("_last"))
        out = joined.withColumn(limit.name, within).drop("_k", "_w", "_last")
    admitted = reduce(lambda a, b: a & b, [F.col(x.name) for x in limits])
    return out.withColumn("admitted", admitted)


def assign_arm(key: Column | str, weights: Mapping[str, int]) -> Column:
    """Arm of a key: a stable hash in 0..99 against cumulative percentages."""
    if sum(weights.values()) != 100:
        raise ValueError("weights must add up to 100")
    bucket = hash_bucket(key, 100)
    upper, choices = 0, []
    for name, weight in weights.items():
        upper += weight
        choices.append(F.when(bucket < upper, F.lit(name)))
    return F.coalesce(*choices)


def split_traffic(
    requests: DataFrame, key: str, weights: Mapping[str, int], latency_col: str = "execution_time_ms"
) -> DataFrame:
    """Requests, error rate and mean latency per arm."""
    failed = F.count_if(F.col("status_code") != 200)
    total = F.count(F.lit(1))
    return (
        requests.withColumn("arm", assign_arm(key, weights))
        .groupBy("arm")
        .agg(
            total.alias("requests"),
            failed.alias("errors"),
            percent(failed, total).alias("error_rate_pct"),
            F.round(F.avg(latency_col), 2).alias("avg_latency_ms"),
        )
        .orderBy("arm")
    )
