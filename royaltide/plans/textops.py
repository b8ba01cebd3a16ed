"""Text labelling, extraction and generation."""

from pyspark.sql import functions as F

from royaltide.operators import textops as X
from royaltide.plans.common import Catalogue, sql_money, sql_round
from royaltide.session import scratch_path

CAT = Catalogue()

# Labels on words that do occur in the test texts.
TOPICS = {
    "legal": ["license", "copyright", "rights"],
    "technical": ["token", "key", "http", "@"],
    "english": ["the ", "and ", "ing "],
    "german": ["der ", "und ", "sch"],
    "french": ["le ", "que ", "les "],
}
TITLE_MOODS = {
    "Upbeat": ["new", "hot", "ring"],
    "Melancholy": ["blue", "cold"],
    "Energetic": ["red", "hot", "large"],
    "Romantic": ["small", "ring"],
    "Dark": ["rod", "plate"],
}
URGENT = ["german", "french"]


def _label_sql(text, labels, default):
    scores = {
        name: " + ".join(f"CAST(contains(lower({text}), '{k}') AS INT)" for k in keys)
        for name, keys in labels.items()
    }
    top = f"greatest({', '.join(scores.values())})"
    whens = " ".join(f"WHEN {s} = {top} THEN '{name}'" for name, s in scores.items())
    return f"CASE WHEN {top} = 0 THEN '{default}' {whens} END"


_DOC_LABEL = _label_sql("text", TOPICS, "other")
_SONG_TEXT = """('Song: "' || title || '" by ' || artist_name || ' (Genre: ' || genre || ')')"""
_MOOD = _label_sql(_SONG_TEXT, TITLE_MOODS, "Chill")


@CAT.add("classify_text", f"SELECT doc_id, {_DOC_LABEL} AS label FROM {{documents}}")
def _(t):
    return X.classify(t.spread("documents"), "text", TOPICS, "other").select("doc_id", "label")


def _keyword_answers(prompts):
    """A stand-in for a model: the label of the text behind the instruction line, loosely written."""
    def answer(prompt):
        text = prompt.split("\n", 1)[1].lower()
        hits = {name: sum(k in text for k in keys) for name, keys in TOPICS.items()}
        best = max(hits, key=hits.get)
        return f" {best.upper()} " if hits[best] else "none of them"

    return prompts.map(answer)


@CAT.add("classify_backend", f"SELECT doc_id, {_DOC_LABEL} AS label FROM {{documents}}")
def _(t):
    """Labels by a backend whose answers are kept; a ledger filled by half of the texts answers the rest only."""
    ledger = X.Ledger(scratch_path(t.spark, "answers"), "keywords-1")
    docs = t.spread("documents")
    X.classify(docs.where("doc_id % 2 = 0"), "text", TOPICS, "other", "label", _keyword_answers, ["doc_id"], ledger)
    return X.classify(docs, "text", TOPICS, "other", "label", _keyword_answers, ["doc_id"], ledger).select("doc_id", "label")


@CAT.add(
    "classify_filter",
    f"""SELECT song_id, title, artist_name, genre, mood
        FROM (SELECT *, {_MOOD} AS mood FROM {{songs}}) WHERE mood = 'Romantic'""",
)
def _(t):
    described = t.songs.withColumn("text", X.describe_song())
    kept = X.classify_filter(described, "text", TITLE_MOODS, "Chill", ["Romantic"], name="mood")
    return kept.select("song_id", "title", "artist_name", "genre", "mood")


FIELDS = {
    "email": r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    "phone": r"(\+1 \(\d{3}\) \d{3}-\d{4})",
    "address": r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})",
    "license_word": r"([Ll]icen[cs]e[a-z]*)",
}


@CAT.add(
    "extract_fields",
    "SELECT doc_id, "
    + ", ".join(f"nullif(regexp_extract(text, '{r}', 1), '') AS {n}" for n, r in FIELDS.items())
    + " FROM {documents}",
)
def _(t):
    found = X.extract(t.spread("documents"), "text", FIELDS)
    return found.select("doc_id", "extracted.*")


def _summary_sql(rows: str, *keys: str) -> str:
    """``keys, summary`` of ``rows(keys, text)``: the sentence with the most frequent words of its text."""
    key = ", ".join(keys)
    return f"""
    cut AS (SELECT {key}, unnest(regexp_split_to_array(text, '[.!?]')) AS raw,
                   generate_subscripts(regexp_split_to_array(text, '[.!?]'), 1) AS place FROM ({rows})),
    sentences AS (SELECT {key}, place, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM cut),
    terms AS (SELECT {key}, place, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]{{4,}}')) AS term FROM sentences),
    told AS (SELECT {key}, term, count(*) AS n FROM terms GROUP BY ALL),
    worth AS (SELECT {key}, place, avg(n) AS worth FROM terms JOIN told USING ({key}, term) GROUP BY ALL),
    ranked AS (SELECT {key}, sentence, row_number() OVER (
                   PARTITION BY {key} ORDER BY coalesce(worth, 0) DESC, place) AS best
               FROM sentences LEFT JOIN worth USING ({key}, place) WHERE sentence <> ''),
    chosen AS (SELECT {key}, sentence AS summary FROM ranked WHERE best = 1)"""


@CAT.add(
    "generate_summaries",
    f"""WITH {_summary_sql("SELECT doc_id, text FROM {documents}", "doc_id")}
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(summary, '') END AS executive_summary
    FROM {{documents}} LEFT JOIN chosen USING (doc_id)""",
)
def _(t):
    prompt = F.concat(F.lit("Summarise for an executive:\n"), F.col("text"))
    out = X.generate(t.spread("documents"), prompt, spread_by=["doc_id"], name="executive_summary")
    return out.select("doc_id", "executive_summary")


@CAT.add(
    "payment_notifications",
    f"""WITH paid AS (
        SELECT songwriter_id, name, {sql_money("net_amount")} AS total_payment
        FROM {{songwriters}} JOIN {{royalty_payments}} USING (songwriter_id)
        WHERE payment_period = '1999-Q4' AND payment_status = 'completed'
        GROUP BY songwriter_id, name)
    SELECT *, 'Dear ' || name || ', your royalty payment for 1999-Q4 is $'
           || printf('%.2f', total_payment) || '. Thank you for your music.' AS notification
    FROM paid""",
)
def _(t):
    return X.notifications(t.songwriters, t.royalty_payments, "1999-Q4")


@CAT.add(
    "triage_messages",
    f"""WITH {_summary_sql("SELECT conv_id, turn, content AS text FROM {messages}", "conv_id", "turn")}
    SELECT conv_id, turn, sentiment, '[' || sentiment || '] ' || coalesce(summary, '') AS issue_summary
        FROM (SELECT *, {_label_sql("content", TOPICS, "neutral")} AS sentiment FROM {{messages}})
             LEFT JOIN chosen USING (conv_id, turn)
        WHERE sentiment IN ('german', 'french')""",
)
def _(t):
    kept = X.triage(t.messages, "content", TOPICS, URGENT)
    return kept.select("conv_id", "turn", "sentiment", "issue_summary")


@CAT.add(
    "label_distribution",
    f"""WITH moods AS (SELECT genre, {_MOOD} AS mood FROM {{songs}})
    SELECT mood, count(*) AS song_count,
           {sql_round("CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM moods)", 1)} AS pct_of_catalog,
           string_agg(DISTINCT genre, ', ' ORDER BY genre) AS genres_represented
    FROM moods GROUP BY mood""",
)
def _(t):
    described = t.songs.withColumn("text", X.describe_song())
    return X.label_distribution(
        X.classify(described, "text", TITLE_MOODS, "Chill", name="mood"), "mood", "genre"
    )
