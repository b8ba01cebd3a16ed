"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The pieces of a given vocabulary form a transducer over normalised characters
(spaces become U+2581, one stands before the text): a path through the piece trie emits a
piece at the cost of minus its score, and a path through the UTF-8 bytes of one character
emits byte pieces at a cost above every piece. Composition with an input is
lazy; the encoding is the shortest path in the tropical semiring, ties
going to the longer last piece. This is the Viterbi reading of the scores; for a
vocabulary built by merges it need not equal the merge order, but it always decodes
to the input. Cuts between two characters that no piece holds side by side change nothing, so
text is composed chunk by chunk, and chunks are remembered.

Defined cases: null and empty texts have no ids; repeated rows each get a row; a
U+2581 in a text is written in byte pieces, so decoding restores it.
"""

from __future__ import annotations

import re
import uuid
from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from royaltide.llm.common import doc_texts, map_slices

SPACE = "▁"
CHUNK = re.compile(r" *[^ ]+| +$")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBER = 400_000


def load_pieces(model_file: str = DEFAULT_MODEL) -> list[tuple[str, float, str]]:
    """``(piece, score, kind)`` by id; kind is piece, byte or other. Read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = [
        "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
        for i in range(model.get_piece_size())
    ]
    return [(model.id_to_piece(i), model.get_score(i), kinds[i]) for i in range(len(kinds))]


class Transducer:
    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        self.final = {p: (-s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"}
        # Piece trie: a state maps the next character to the state behind it and the cost and id of the piece that ends there.
        self.trie: dict = {}
        for piece, (cost, number) in self.final.items():
            state = self.trie
            for sign in piece[:-1]:
                state = state.setdefault(sign, ({}, float("inf"), -1))[0]
            behind = state[piece[-1]][0] if piece[-1] in state else {}
            state[piece[-1]] = (behind, cost, number)
        self.pairs = {p[i:i + 2] for p in self.final for i in range(len(p) - 1)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.by_bytes = 1.0 + max((c for c, _ in self.final.values()), default=0.0)
        self.out = [
            bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "other" else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        # Only an input of spaces before other characters is cut at spaces.
        self.at_spaces = not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}

    def shortest(self, text: str) -> list[int]:
        """Ids of the cheapest path through one run of normalised characters."""
        n, trie, by_bytes = len(text), self.trie, self.by_bytes
        # The arc that ends at a place: where it starts and its piece, -1 for the bytes of one character.
        cost, start, arc = [0.0] + [float("inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, state, j = cost[i], trie, i
            while j < n:
                found = state.get(text[j])
                if found is None:
                    break
                state, more, number = found
                j += 1
                more += here
                if more < cost[j]:
                    cost[j], start[j], arc[j] = more, i, number
                if not state:
                    break
            if here + by_bytes < cost[i + 1]:
                length = len(text[i].encode("utf-8", "surrogatepass"))
                if here + by_bytes * length < cost[i + 1]:
                    cost[i + 1], start[i + 1], arc[i + 1] = here + by_bytes * length, i, -1
        out: list[int] = []
        while n:
            i = start[n]
            if arc[n] >= 0:
                out.append(arc[n])
            else:
                out.extend(reversed(self.spell(text[i])))
            n = i
        out.reverse()
        return out

    def spell(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk of raw text as packed numbers."""
        ids, start = [], 0
        # A literal U+2581 is not a space: no path through a piece may read it.
        text = chunk.replace(" ", SPACE) if SPACE not in chunk else None
        if text is None:
            for part in re.split(f"({SPACE})", chunk):
                ids += self.spell(part) if part == SPACE else array("i", self._chunk(part)) if part else []
            return array("i", ids).tobytes()
        if self.pairs.issuperset(map(add, text, text[1:])):
            # One part, which the caller remembers.
            return array("i", self.shortest(text)).tobytes()
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1:i + 1] not in self.pairs:
                part = text[start:i]
                found = self.parts.get(part)
                if found is None:
                    found = self.shortest(part)
                    if len(self.parts) >= REMEMBER:
                        self.parts.clear()
                    if len(part) <= 64:
                        self.parts[part] = found
                ids += found
                start = i
        return array("i", ids).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a text, and whether they decode to it.

        Decoding joins what each id stands for, so it is checked chunk by chunk.
        """
        if not text:
            return np.empty(0, dtype=np.int32), True
        full = " " + text
        chunks = CHUNK.findall(full) if self.at_spaces else [full]
        found = list(map(self.known.get, chunks))
        same = True
        for i, hit in enumerate(found):
            if hit is None:
                chunk = chunks[i]
                hit = found[i] = self.known.get(chunk) or self._chunk(chunk)
                right = self.spoken(array("i", hit)) == chunk.encode("utf-8", "surrogatepass")
                same = same and right
                if right and len(chunk) <= 64:
                    if len(self.known) >= REMEMBER:
                        self.known.clear()
                    self.known[chunk] = hit
        return np.frombuffer(b"".join(found), dtype=np.int32), same

    def spoken(self, ids) -> bytes:
        return b"".join(map(self.out.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.spoken(ids)[1:].decode("utf-8", "surrogatepass")


#: The transducer of the last vocabulary, kept with what it remembers as long as the worker lives.
_OPEN: dict[str, Transducer] = {}


def _opened(key: str, shared) -> Transducer:
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Transducer(shared.value)
    return _OPEN[key]


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` for every row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file)), uuid.uuid4().hex

    def make():
        fst = _opened(key, shared)

        def work(batch):
            ids, same = [], []
            for text in batch.column(1).to_pylist():
                code, right = fst.encode(text)
                ids.append(code)
                same.append(right)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            return [batch.column(0), np.diff(ends).astype(np.int64), lists, same]

        return work

    return map_slices(doc_texts(docs, id_col, text_col), make, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(codes: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids are an empty text."""
    shared, key = codes.sparkSession.sparkContext.broadcast(load_pieces(model_file)), uuid.uuid4().hex

    def run(batches):
        fst = _opened(key, shared)
        for batch in batches:
            texts = [fst.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return codes.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
