"""Reusable column expressions. Everything here stays inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- money -----------------------------------------------------------------


def micros(value: Column | str) -> Column:
    """Amount in millionths as a long, so that sums are quick and do not depend on order.

    What is no finite number is NULL. A sum beyond nine trillion is an error, never a wrong number.
    """
    amount = as_col(value).try_cast("double")
    whole = F.floor(amount)
    part = F.round((amount - whole) * F.lit(1_000_000)).cast("bigint")
    return F.when(F.abs(amount) < F.lit(float("inf")), whole * F.lit(1_000_000) + part)


def money(total_micros: Column) -> Column:
    """A sum of millionths as an amount, rounded to the cent here and only here."""
    return F.round(total_micros.cast("decimal(20, 0)") / F.lit(1_000_000), 2).cast("double")


def money_sum(value: Column | str) -> Column:
    """Sum of an amount; parts below a cent count, the sum is rounded once."""
    return money(F.sum(micros(value)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


# --- optional arguments ------------------------------------------------------


def is_absent(value: str | None) -> bool:
    """NULL and the text ``NULL`` in any case both mean "no filter"."""
    return value is None or value.upper() == "NULL"


def optional_eq(column: Column | str, value: str | None) -> Column:
    """Case-insensitive equality, or TRUE when the argument is absent.

    The choice is made while the plan is built, so that the scan receives
    either a plain comparison or nothing at all.
    """
    if is_absent(value):
        return F.lit(True)
    return F.lower(as_col(column)) == F.lit(value.lower())


def matches_text(column: Column | str, term: str) -> Column:
    """Case-insensitive ``LIKE '%term%'``."""
    pattern = "%" + term.lower().replace("\\", "\\\\") + "%"
    return F.lower(as_col(column)).like(pattern)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- text rules --------------------------------------------------------------


@dataclass(frozen=True)
class TextRule:
    """``label`` applies if one of ``include`` fits and none of ``exclude`` does.

    An ``include`` entry is one LIKE pattern, or a tuple of patterns that must
    all fit. Matching ignores case.
    """

    label: str
    include: Sequence[str | tuple[str, ...]]
    exclude: Sequence[str] = field(default_factory=tuple)

    def condition(self, text: Column) -> Column:
        lowered = F.lower(text)

        def fits(entry: str | tuple[str, ...]) -> Column:
            patterns = (entry,) if isinstance(entry, str) else entry
            return all_of([lowered.like(p) for p in patterns])

        hit = any_of([fits(entry) for entry in self.include])
        return all_of([hit] + [~lowered.like(p) for p in self.exclude])


def first_rule(text: Column | str, rules: Sequence[TextRule], default: str) -> Column:
    """Label of the first rule that applies; rule order is significant."""
    text = as_col(text)
    return F.coalesce(*[F.when(r.condition(text), F.lit(r.label)) for r in rules], F.lit(default))


def every_rule(text: Column | str, rules: Sequence[TextRule]) -> Column:
    """Array of the labels of all rules that apply, in rule order."""
    text = as_col(text)
    return F.array_compact(
        F.array(*[F.when(r.condition(text), F.lit(r.label)) for r in rules])
    )


# --- keyed pseudo-random draws -----------------------------------------------

DRAW_MODULUS = 2147483647


def draw(row: Column | str, stream: int, seed: int) -> Column:
    """Reproducible integer in ``[0, 2^31 - 1)`` for a row number and stream.

    Depends only on its arguments, so a recomputed partition produces the same
    rows. Uses plain integer arithmetic that never exceeds 64 bits.
    """
    row = as_col(row).cast("bigint")
    m = F.lit(DRAW_MODULUS).cast("bigint")
    start = (
        (row % m) * F.lit(48271).cast("bigint")
        + F.floor(row / m) * F.lit(69621).cast("bigint")
        + F.lit((stream * 1299709 + seed * 15485863) % DRAW_MODULUS).cast("bigint")
    ) % m
    squared = (start * start + F.lit(12345).cast("bigint")) % m
    return (squared * F.lit(40692).cast("bigint")) % m


def draw_int(row: Column | str, stream: int, seed: int, low: int, high: int) -> Column:
    """Draw from ``low..high`` (both inclusive)."""
    return F.lit(low).cast("bigint") + draw(row, stream, seed) % F.lit(high - low + 1)


def pick(row: Column | str, stream: int, seed: int, values: Sequence[str]) -> Column:
    """Uniform choice from a fixed list."""
    position = (draw(row, stream, seed) % len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), position)


def hash_bucket(value: Column | str, buckets: int) -> Column:
    """Stable bucket ``0..buckets-1`` of any value, the same on every engine."""
    digest = F.substring(F.md5(as_col(value).cast("string").cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % F.lit(buckets)


# --- names and dates ---------------------------------------------------------


def parse_partial_date(value: Column | str) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD...`` to a date; anything else is NULL."""
    text = as_col(value)
    length = F.length(text)

    def attempt(fmt: str, source: Column) -> Column:
        return F.to_date(F.try_to_timestamp(source, F.lit(fmt)))

    parsed = (
        F.when(length == 4, attempt("yyyy", text))
        .when(length == 7, attempt("yyyy-MM", text))
        .otherwise(attempt("yyyy-M-d", F.substring(text, 1, 10)))
    )
    return F.when(F.year(parsed) >= 1, parsed)


def derive_email(name: Column | str, domain: str = "email.com") -> Column:
    """``first.second@domain`` from the first two words of a name."""
    cleaned = F.trim(F.regexp_replace(F.lower(as_col(name)), "['.]", ""))
    words = F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")
    local = F.array_join(F.slice(words, 1, 2), ".")
    return F.when(F.size(words) > 0, F.concat(local, F.lit("@" + domain)))


def split_ids(value: Column | str, delimiter: str = ",") -> Column:
    """Delimited text to an array of trimmed identifiers."""
    return F.transform(F.split(as_col(value), delimiter), lambda x: F.trim(x))


def words(text: Column | str) -> Column:
    """Lower-case ASCII word tokens, in order, empty ones removed."""
    pieces = F.split(F.lower(as_col(text)), "[^a-z0-9]+")
    return F.filter(pieces, lambda w: w != "")


def keyword_hits(text: Column | str, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in the text."""
    lowered = F.lower(as_col(text))
    return reduce(
        lambda a, b: a + b,
        [F.coalesce(lowered.contains(k.lower()).cast("int"), F.lit(0)) for k in keywords],
        F.lit(0),
    )


def best_label(text: Column | str, labels: Mapping[str, Sequence[str]], default: str) -> Column:
    """Label with most keyword hits; ties go to the earlier label, no hit to ``default``."""
    scores = [keyword_hits(text, keys) for keys in labels.values()]
    top = F.greatest(*scores, F.lit(0)) if len(scores) > 0 else F.lit(0)
    choice = [F.when(s == top, F.lit(name)) for name, s in zip(labels, scores)]
    return F.when(top == 0, F.lit(default)).otherwise(F.coalesce(*choice))
