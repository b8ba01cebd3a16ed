"""Conversation structure repair by iterative-deepening A*.

A conversation is repaired by the cheapest edits that make its role initials read
``(s?(ua)+)?``. The search is a depth-first search in the ASCII order of the edits under
increasing cost bounds. A table remembers, for each failed (row, state), the least cost that
is still open from there, so no state is entered twice with a budget that cannot
do. The first accepting path is the answer: the cheapest one, ties ASCII-least.

Long conversations are searched in pieces of ``PIECE`` rows, from the last to the first; what a piece
leaves open at its end is the exact cost of the pieces behind it, for each
state. Inserts belong to the row that follows them, so the audits of a piece are prefix-free
and the ASCII-least whole audit is made of ASCII-least pieces.

A task holds one byte a row and state of a conversation, and later its audit; texts only stream
through. One digest covers all texts of a conversation, so they pass one task in order.

Defined cases: a null conversation id is a conversation of its own; null ids and turns count as one
space in the damage key, null roles and texts are one space. Rows of equal turn stand by
role, then by the digest of role and text. An empty or unknown role matches no initial,
so such rows are reroled or deleted. Empty tables give empty results; other columns are ignored.
Repeated rows are rows of their own (all but the first are duplicates).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import arrow_schema, pick, stored

PIECE = 32
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, KEEP, REROLE = "DIKR"
SPACES = " \t\n\x0b\f\r"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
_NEXT = (2, 2, 3, 2)
_ASKED = (1, 1, 2, 1)
#: Cost and edits that end a conversation in each state.
_END_COST, _END_EDITS = (0, 4, 2, 0), ("", "II", "I", "")
#: Adjacent initials (0 system, 1 user, 2 assistant, 3 other) that may stand.
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


class _Piece:
    """Search over the rows of one piece; ``behind`` is the open cost of each end state."""

    def __init__(self, codes: bytes, behind: Sequence[int]):
        self.rows = [(c & 3, c >> 2) for c in codes]
        self.behind = behind
        self.failed: dict[tuple[int, int], int] = {}
        self.floor = [min(behind)]
        for _, fault in reversed(self.rows):
            self.floor.append(self.floor[-1] + (3 if fault in (BLANK, DUPLICATE) else fault == TRUNCATED))
        self.floor.reverse()

    def open(self, i: int, state: int) -> int:
        """A cost that no completion from here stays below."""
        if i == len(self.rows):
            return self.behind[state]
        return self.failed.get((i, state), self.floor[i])

    def moves(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: letter, cost, next row, next state."""
        initial, fault = self.rows[i]
        yield DELETE, 3, i + 1, state
        yield INSERT, 2, i, _NEXT[state]
        if fault in (BLANK, DUPLICATE):
            return
        extra = 1 if fault == TRUNCATED else 0
        if initial == _ASKED[state]:
            yield KEEP, extra, i + 1, _NEXT[state]
        elif initial == 0 and state == 0:
            yield KEEP, extra, i + 1, 1
        yield REROLE, 2 + extra, i + 1, _NEXT[state]

    def descend(self, i: int, state: int, budget: int, path: list[str]) -> int | None:
        """End state of the first path within the budget, its edits in ``path``."""
        if i == len(self.rows):
            return state
        least = None
        for letter, cost, row, after in self.moves(i, state):
            if cost + self.open(row, after) <= budget:
                path.append(letter)
                end = self.descend(row, after, budget - cost, path)
                if end is not None:
                    return end
                path.pop()
            ahead = cost + self.open(row, after)
            least = ahead if least is None else min(least, ahead)
        self.failed[i, state] = max(self.open(i, state), least)
        return None

    def solve(self, state: int) -> tuple[int, str, int]:
        """Cost to the very end, edits of this piece, and the state it ends in."""
        while True:
            bound, path = self.open(0, state), []
            end = self.descend(0, state, bound, path)
            if end is not None:
                return bound, "".join(path), end


@lru_cache(maxsize=50_000)
def _solved(codes: bytes, behind: tuple[int, ...], states: tuple[int, ...]) -> tuple:
    piece = _Piece(codes, behind)
    return tuple(piece.solve(state) for state in states)


def plan(codes: bytes) -> tuple[int, str]:
    """Least cost and its ASCII-least audit; a code is ``initial + 4 * fault`` of a row."""
    starts = range(0, len(codes), PIECE)
    behind, kept, after = _END_COST, [], 0
    for at in reversed(starts):
        low = min(behind)
        states = (0,) if at == 0 else (0, 1, 2, 3)
        found = _solved(codes[at:at + PIECE], tuple(c - low for c in behind), states)
        kept.append(found)
        after += low
        behind = tuple(cost for cost, _, _ in found)
    state, edits = 0, []
    for found in reversed(kept):
        _, letters, state = found[state]
        edits.append(letters)
    return behind[0] + after if kept else 0, "".join(edits) + (_END_EDITS[state] if kept else "")


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations with the contract's faults put in, by a hash of conversation and turn."""
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("act"))
    copies = F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("act <> 0").select(
        "conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with their order, role initial and what their own text tells of faults."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("dated"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        "role", "text", F.unhex(F.sha2(whole, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"),
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))


_ORDER = ("none", "conv", "dated", "turn", "role", "digest", "row")
_FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _figures(codes: np.ndarray, dated: np.ndarray, turns: np.ndarray) -> tuple:
    initial, fault = codes & 3, codes >> 2
    turns = turns[dated]
    gaps = int(turns[-1]) - int(turns[0]) - int((turns[1:] != turns[:-1]).sum()) if len(turns) else 0
    cost, audit = plan(codes.astype(np.uint8).tobytes())
    counts = [int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return gaps, *counts, int((~_LEGAL[initial[:-1], initial[1:]]).sum()), cost, audit


def _by_conversation(batches, columns: Sequence[str]):
    """Arrays of each conversation of a sorted partition, gathered over batches."""
    key, held = None, []
    for batch in batches:
        none, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("none", "conv"))
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        edges = np.flatnonzero((none[1:] != none[:-1]) | (conv[1:] != conv[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(conv)]):
            if a == b:
                continue
            here = (bool(none[a]), int(conv[a]))
            if here != key and held:
                yield key, [np.concatenate(x) for x in zip(*held)]
                held = []
            key = here
            held.append([x[a:b] for x in arrays])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held)]


def _emit(make, spec: str, size: int = 2000):
    """Turn a generator of row tuples over batches into one of record batches."""
    _, schema = arrow_schema(spec)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        rows = []
        for row in make(batches):
            rows.append(row)
            if len(rows) == size:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return run


def _plans(batches) -> Iterator[tuple]:
    for key, (codes, dated, turns) in _by_conversation(batches, ("code", "dated", "turn")):
        yield *key, *_figures(codes, dated, turns)


class _Digest:
    """Digest of a repaired conversation whose rows come one by one."""

    def __init__(self, head: tuple, audit: str):
        self.head, self.audit, self.at, self.state = head, audit, 0, 0
        self.hash, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == INSERT:
            self._put("user" if _ASKED[self.state] == 1 else "assistant", "")
            self.state = _NEXT[self.state]
            self.at += 1

    def row(self, initial: int, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE:
            return
        self._put(role if edit == KEEP else ("user" if _ASKED[self.state] == 1 else "assistant"), text)
        self.state = 1 if edit == KEEP and initial == 0 else _NEXT[self.state]

    def end(self) -> tuple:
        self._inserts()
        return (*self.head, self.hash.hexdigest())


def _digests(batches) -> Iterator[tuple]:
    current = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("none", "conv", "head", "initial", "role", "text")]
        for none, conv, head, initial, role, text in zip(*columns):
            if head is None:
                current.row(initial, role, text)
                continue
            if current:
                yield current.end()
            current = _Digest((None if none else conv, *head.values()), head["audit"])
    if current:
        yield current.end()


def repair(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation of ``rows(conv_id, turn, role, text)``.

    ``everyone(conv_id)`` names the conversations to report, those without rows included.
    """
    ids = (rows if everyone is None else everyone).select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv")).distinct()
    marked = stored(_marked(rows), "turns")
    firsts = (
        marked.where("not blank").groupBy("none", "conv", "digest")
        .agg(F.min(F.struct("dated", "turn", "row")).alias("at"))
        .select("none", "conv", "digest", F.col("at.row").alias("row"), F.lit(True).alias("first")))
    light = marked.drop("text").join(firsts, ["none", "conv", "digest", "row"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    plans = (
        light.select(*_ORDER, (F.col("initial") + 4 * fault).alias("code")).repartition("none", "conv").sortWithinPartitions(*_ORDER)
        .mapInArrow(_emit(_plans, "none boolean, conv bigint, " + _FIGURES), "none boolean, conv bigint, " + _FIGURES))
    spec = "conv_id bigint, " + _FIGURES + ", repaired_sha256 string"
    names = [f.name for f in arrow_schema(_FIGURES)[0]]
    heads = ids.join(plans, ["none", "conv"], "left").select(
        "none", "conv", F.struct(*[
            F.coalesce(F.col(c), F.lit("" if c == "audit" else 0)).alias(c) for c in names]).alias("head"))
    nothing = {"dated": F.lit(False), "turn": F.lit(None).cast("bigint"), "role": F.lit(""), "digest": F.lit(None).cast("binary"),
               "row": F.lit(-1).cast("bigint"), "initial": F.lit(3), "text": F.lit("")}
    both = heads.withColumn("kind", F.lit(0)).withColumns(nothing).unionByName(
        marked.select("none", "conv", "dated", "turn", "role", "digest", "row", "initial", "text")
        .withColumn("kind", F.lit(1)).withColumn("head", F.lit(None).cast(heads.schema["head"].dataType)))
    return (
        both.repartition("none", "conv").sortWithinPartitions("none", "conv", "kind", *_ORDER[2:])
        .select("none", "conv", "head", "initial", "role", "text")
        .mapInArrow(_emit(_digests, spec), spec))
