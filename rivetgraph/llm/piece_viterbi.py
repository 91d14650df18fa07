"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass; and decoding.

The automaton holds all pieces. As it reads a text, every state's output links name the
pieces that end there; each relaxes the best score of its end from the best score of its
start. A character that no piece covers costs ``UNKNOWN`` more than the worst piece and is
written as byte pieces. Of equal scores the longer last piece wins.

Pieces never reach across the start of a word, so a text's best path is that of its words,
which are remembered in a table of bounded size.

Text is marked as the model's plain form does: a word mark in front, one for every space.
Decoding joins the pieces' bytes and takes the mark in front off, so every text without the
mark character itself comes back as it was.

Defined cases: a null text has null ids; an empty text has none; a text that holds the mark
character comes back with a space in its place; repeated rows each get a row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rivetgraph.llm.common import mapped

MARK = "▁"  # fixed value: the library's word mark
UNKNOWN = 10.0
CACHE = 300_000
_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Recent(dict):
    """Key → ``make(key)``, in a table of at most ``size`` keys. A full half makes way as a whole;
    what was asked for since the last time stays, so keys in use are not made again."""

    def __init__(self, make: Callable, size: int) -> None:
        self.make, self.half, self.older = make, max(1, size // 2), {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """The pieces of a model file: automaton, scores, bytes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes: list[bytes] = [b""] * n
        self.byte_id: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.length = [1] * n
        worst = 0.0
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = name.replace(MARK, " ").encode()
                worst = min(worst, model.get_score(i))
                self.length[i] = len(name)
                self.automaton.add_word(name, (len(name), model.get_score(i), i))
        self.automaton.make_automaton()
        self.unk_id, self.unknown = model.unk_id(), worst - UNKNOWN
        self.across = any(MARK in x.lstrip(MARK) for x in names)
        self.joined = pa.array(self.bytes, pa.binary())
        self.known = Recent(lambda part: np.array(self.best(part), "<i4").tobytes(), CACHE)

    def best(self, part: str) -> list[int]:
        """Ids of the best path through one part."""
        n, unknown = len(part), self.unknown
        # best score up to each place, and the piece that ends there
        score, back, at = [0.0], [-1], 0
        for end, (length, gain, i) in self.automaton.iter(part):
            while at <= end:
                # no piece, or none from a reached place: the character stands alone
                score.append(score[at] + unknown)
                back.append(-1)
                at += 1
            reached = score[at - length] + gain
            if reached > score[at]:
                score[at], back[at] = reached, i
        back += [-1] * (n - at)
        out: list[int] = []
        at = n
        while at:
            i = back[at]
            if i >= 0:
                out.append(i)
                at -= self.length[i]
            else:
                out += [self.byte_id.get(b, self.unk_id) for b in reversed(part[at - 1].encode())]
                at -= 1
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        parts = [marked] if self.across else _PARTS.findall(marked)
        return b"".join(map(self.known.__getitem__, parts))

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each list of ids: all pieces' bytes in a row, cut where a list ends."""
        flat = self.joined.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64)])
        whole = bytes(flat.buffers()[2] or b"")
        sizes = ids.value_lengths().fill_null(0).to_numpy()
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [
            None if null else whole[a:b].decode("utf-8", "replace")[1:]
            for null, a, b in zip(ids.is_null().to_pylist(), bounds, bounds[1:])
        ]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]


def _on_worker(path: str) -> Callable[[], Pieces]:
    state: dict = {}

    def get() -> Pieces:
        if not state:
            state["p"] = Pieces(path)
        return state["p"]

    return get


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    pieces = _on_worker(path)

    def run(c: dict) -> dict:
        got = [None if t is None else pieces().encode(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "ids": _lists(got)}

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>")


def _lists(got: list[bytes | None]) -> pa.Array:
    ends = np.cumsum([0] + [len(b) // 4 if b is not None else 0 for b in got]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(b for b in got if b is not None), "<i4"))
    mask = pa.array([b is None for b in got], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=mask)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of :func:`encode`."""
    pieces = _on_worker(path)

    def run(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "text": pieces().decode_all(pa.array(c["ids"], pa.list_(pa.int32())))}

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def encode_report(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids, n_ids, ids_crc32, and whether decoding gives the text back."""
    pieces = _on_worker(path)

    def run(c: dict) -> dict:
        got = [None if t is None else pieces().encode(t) for t in c["text"]]
        ids = _lists(got)
        back = pieces().decode_all(ids)
        return {
            "doc_id": c["doc_id"],
            "ids": ids,
            "n_ids": [None if b is None else len(b) // 4 for b in got],
            "ids_crc32": [None if b is None else zlib.crc32(b) for b in got],
            "round_trip": [None if t is None else t == x for t, x in zip(c["text"], back)],
        }

    schema = "doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, round_trip boolean"
    return mapped(docs.select("doc_id", "text"), run, schema)
