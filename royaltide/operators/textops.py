"""Labelling, extraction and generation over text columns, in batch."""

from __future__ import annotations

import datetime
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from royaltide.functions.columns import best_label, money_sum, percent
from royaltide.operators.ordering import spread_join
from royaltide.session import durable
from royaltide.sources.partitioned import exists

# A backend turns a batch of prompts into a batch of answers of the same length.
Backend = Callable[[pd.Series], pd.Series]

# Label lists. The keywords belong to the default, model-free backend.
MOODS = {
    "Upbeat": ["happy", "dance", "party", "pop", "sun"],
    "Melancholy": ["sad", "tears", "alone", "blue", "goodbye"],
    "Energetic": ["rock", "fire", "run", "electronic", "power"],
    "Romantic": ["love", "heart", "kiss", "r&b", "forever"],
    "Dark": ["black", "night", "metal", "death", "shadow"],
    "Chill": ["dream", "acoustic", "slow", "folk", "jazz"],
}
SENTIMENTS = {
    "positive": ["thank", "appreciate", "helpful", "look forward"],
    "neutral": ["following up", "clarify", "please advise"],
    "negative": ["disappointed", "excessive", "penalties", "legal team"],
    "escalation": ["urgent:", "immediate technical", "deadline", "has been down"],
}
URGENT = ("negative", "escalation")
# Patterns of the default extraction backend; group 1 is the value.
LICENSE_FIELDS = {
    "licensee_name": r"(?:and|to|with) ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*(?: (?:Inc\.|LLC|Entertainment)))",
    "territory": r"(?:territory of |across the |Coverage: )([A-Z][A-Za-z]+(?: (?:and )?[A-Z][A-Za-z]+)*)",
    "effective_date": r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})",
    "fee_amount": r"([$€][\d,]+(?:\.\d{2})?)",
    "license_type": r"([A-Z][A-Za-z]+(?: Venue)?) License|This License",
}


def describe_song() -> Column:
    """Text a song is labelled by."""
    return F.format_string('Song: "%s" by %s (Genre: %s)', "title", "artist_name", "genre")


@dataclass(frozen=True)
class Ledger:
    """Answers kept for good below ``path``, for one ``version`` of a backend.

    A prompt that has an answer of the version is never asked again, by whichever job.
    """

    path: str
    version: str

    def _table(self, spark: SparkSession) -> DataFrame | None:
        return spark.read.parquet(self.path) if exists(spark, self.path) else None

    def answers(self, prompts: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``_prompt_key, _answer`` for all ``prompts(_prompt_key, _prompt)``; ``ask`` gets the new ones only.

        Answers are appended when the job that asked them ends. Of answers that two jobs gave
        to one prompt at a time, the same one is used from then on.
        """
        spark = prompts.sparkSession

        def known() -> DataFrame | None:
            table = self._table(spark)
            mine = None if table is None else table.where(F.col("version") == self.version)
            return None if mine is None else mine.groupBy("_prompt_key").agg(F.min_by("_answer", "asked_at").alias("_answer"))

        old = known()
        new = prompts if old is None else prompts.join(old.select("_prompt_key"), "_prompt_key", "left_anti")
        new = durable(new)
        if not new.isEmpty():
            # The clock is read once, so that a repeated task writes the same row.
            asked = ask(new).withColumn("asked_at", F.lit(datetime.datetime.now(datetime.timezone.utc))).withColumn("version", F.lit(self.version))
            asked.write.mode("append").partitionBy("version").parquet(self.path)
            spark.catalog.refreshByPath(self.path)
            old = known()
        if old is None:
            return new.select("_prompt_key", F.lit(None).cast("string").alias("_answer"))
        return prompts.select("_prompt_key").join(old, "_prompt_key")


def _chosen(answer: Column, labels: Sequence[str], default: str) -> Column:
    """The label that an answer names, in any case; the default if it names none."""
    plain = F.lower(F.trim(answer))
    named = F.coalesce(*[F.when(plain == label.lower(), F.lit(label)) for label in labels], F.lit(default))
    return F.when(answer.isNotNull(), named).otherwise(F.lit(default))


def classify(
    df: DataFrame,
    text_col: str,
    labels: Mapping[str, Sequence[str]],
    default: str,
    name: str = "label",
    backend: Backend | None = None,
    spread_by: Sequence[str] = (),
    ledger: Ledger | None = None,
) -> DataFrame:
    """Label with most keyword hits; the earlier label wins a tie.

    A ``backend`` is asked for one of the labels instead; an answer that is none of them, or none at
    all, gives the default.
    """
    if backend is None:
        return df.withColumn(name, best_label(text_col, labels, default))
    ask = F.lit("Answer with one of these labels: " + ", ".join(labels) + "\n")
    asked = generate(df, F.concat(ask, F.col(text_col)), backend, spread_by, "_answer", ledger)
    return asked.withColumn(name, _chosen(F.col("_answer"), list(labels), default)).drop("_answer")


def classify_filter(
    df: DataFrame,
    text_col: str,
    labels: Mapping[str, Sequence[str]],
    default: str,
    keep: Sequence[str],
    name: str = "label",
) -> DataFrame:
    """Rows whose label is wanted. The score array is computed once per row.

    The one-element array puts a generator between label and filter, which the
    optimizer does not merge, so the scoring expression is not evaluated again.
    """
    labelled = df.withColumn(name, F.explode(F.array(best_label(text_col, labels, default))))
    return labelled.where(F.col(name).isin(list(keep)))


def extract(
    df: DataFrame, text_col: str, patterns: Mapping[str, str], name: str = "extracted",
    backend: Backend | None = None, spread_by: Sequence[str] = (), ledger: Ledger | None = None,
) -> DataFrame:
    """Struct of the first match (group 1) of each pattern; NULL when absent.

    A ``backend`` is asked for a JSON object of the fields instead; what is missing, empty or no JSON is NULL.
    """
    if backend is None:
        fields = [
            F.nullif(F.regexp_extract(text_col, regex, 1), F.lit("")).alias(field)
            for field, regex in patterns.items()
        ]
        return df.withColumn(name, F.struct(*fields))
    ask = F.lit("Answer with a JSON object of these fields: " + ", ".join(patterns) + "\n")
    asked = generate(df, F.concat(ask, F.col(text_col)), backend, spread_by, "_answer", ledger)
    kind = T.StructType([T.StructField(field, T.StringType()) for field in patterns])
    parsed = F.from_json("_answer", kind)
    fields = [F.nullif(F.trim(parsed.getField(field)), F.lit("")).alias(field) for field in patterns]
    return asked.withColumn(name, F.struct(*fields)).drop("_answer")


_WORD = re.compile(r"[^\W_]{4,}")
_BLANKS = " \t\n\x0b\f\r"


def key_sentence(text: str | None) -> str | None:
    """The sentence whose words are the most frequent of the whole text.

    Sentences end at full stops, exclamation and question marks. A sentence is worth the mean
    count of its words of four letters or more, counted over the whole text; the first of equals
    wins. Without such words the first sentence that is not blank is taken.
    """
    if text is None:
        return None
    sentences = [s for s in (part.strip(_BLANKS) for part in re.split("[.!?]", text)) if s]
    words = [_WORD.findall(s.lower()) for s in sentences]
    counts = Counter(w for found in words for w in found)
    worth = [sum(counts[w] for w in found) / len(found) if found else 0.0 for found in words]
    return sentences[max(range(len(worth)), key=worth.__getitem__)] if sentences else ""


def key_sentences(text: Column | str) -> Column:
    """:func:`key_sentence` of every row, in Arrow batches."""

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        return texts.map(key_sentence)

    return pick(F.col(text) if isinstance(text, str) else text)


def sentence_backend(prompts: pd.Series) -> pd.Series:
    """Model-free backend: the key sentence of what follows the instruction line."""
    return prompts.str.split("\n", n=1).str[-1].map(key_sentence)


def generate(
    df: DataFrame,
    prompt: Column,
    backend: Backend = sentence_backend,
    spread_by: Sequence[str] = (),
    name: str = "generated",
    ledger: Ledger | None = None,
) -> DataFrame:
    """Answer a prompt per row, asking the backend once per distinct prompt.

    Answers are made durable, so a lost executor never asks again; with a ``ledger``
    no later run does either. A prompt
    shared by very many rows is joined back in salted pieces; ``spread_by``
    names the columns that tell rows apart.
    """
    asked = df.withColumn("_prompt", prompt).withColumn("_prompt_key", F.sha2("_prompt", 256))
    unique = (
        asked.select("_prompt_key", "_prompt")
        .where(F.col("_prompt").isNotNull())
        .dropDuplicates(["_prompt_key"])
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = backend(batch["_prompt"])
            if len(answers) != len(batch):
                raise ValueError("backend must return one answer per prompt")
            yield pd.DataFrame({"_prompt_key": batch["_prompt_key"], "_answer": list(answers)})

    def ask(prompts: DataFrame) -> DataFrame:
        return prompts.select("_prompt_key", "_prompt").mapInPandas(run, "_prompt_key string, _answer string")

    answers = durable(ask(unique)) if ledger is None else ledger.answers(unique, ask)
    answers = answers.withColumnRenamed("_answer", name)
    keys = list(spread_by) or [c for c in df.columns]
    joined = spread_join(asked.drop("_prompt"), answers, ["_prompt_key"], keys)
    return joined.drop("_prompt_key")


def notifications(
    writers: DataFrame, payments: DataFrame, period: str, n: int | None = None,
    backend: Backend | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """Message per writer with completed payments in the period, largest first.

    A ``backend`` writes the messages from name, period and amount; writers without an answer get the fixed one.
    """
    paid = (
        payments.where(
            (F.col("payment_period") == period) & (F.col("payment_status") == "completed")
        )
        .groupBy("songwriter_id")
        .agg(money_sum("net_amount").alias("total_payment"))
    )
    message = F.format_string(
        f"Dear %s, your royalty payment for {period} is $%.2f. Thank you for your music.",
        F.col("name"),
        F.col("total_payment"),
    )
    contact = [c for c in ("email",) if c in writers.columns]
    out = (
        writers.select("songwriter_id", "name", *contact)
        .join(paid, "songwriter_id")
        .withColumn("notification", message)
    )
    if backend is not None:
        prompt = F.format_string(
            f"Write a short note on a royalty payment.\nName: %s\nPeriod: {period}\nAmount: $%.2f", "name", "total_payment")
        out = generate(out, prompt, backend, ["songwriter_id"], "_answer", ledger)
        out = out.withColumn("notification", F.coalesce("_answer", "notification")).drop("_answer")
    out = (
        out.orderBy(F.desc("total_payment"), "songwriter_id")
    )
    return out if n is None else out.limit(n)


def triage(
    df: DataFrame,
    text_col: str,
    labels: Mapping[str, Sequence[str]] = SENTIMENTS,
    urgent: Sequence[str] = URGENT,
    default: str = "neutral",
    backend: Backend | None = None,
    spread_by: Sequence[str] = (),
    ledger: Ledger | None = None,
) -> DataFrame:
    """Messages that need attention, with a one-line summary of each."""
    kept = classify_filter(df, text_col, labels, default, urgent, name="sentiment")
    if backend is None:
        summary = F.concat(F.lit("["), F.col("sentiment"), F.lit("] "), key_sentences(text_col))
        return kept.withColumn("issue_summary", summary)
    prompt = F.concat(F.lit("Summarise the issue and its urgency in one sentence:\n"), F.col(text_col))
    return generate(kept, prompt, backend, spread_by, "issue_summary", ledger)


def label_distribution(df: DataFrame, label: str, group: str) -> DataFrame:
    """Rows per label, share in percent, and the distinct groups, listed in order."""
    cells = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("_n"))
    counted = cells.groupBy(label).agg(
        F.sum("_n").alias("song_count"), F.sort_array(F.collect_set(group)).alias("_groups")
    )
    # One row per label of a fixed list reaches the window.
    whole = F.sum("song_count").over(W.partitionBy())
    return counted.select(
        label,
        "song_count",
        percent(F.col("song_count"), whole, 1).alias("pct_of_catalog"),
        F.array_join("_groups", ", ").alias("genres_represented"),
    ).orderBy(F.desc("song_count"), label)
