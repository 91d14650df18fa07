"""Secrets: known forms, and strings that a battery of randomness tests cannot tell from noise.

A candidate is a run of 20 or more characters ``[A-Za-z0-9+/_-]`` that is not made of digits
alone. Its encoding is the smallest alphabet that holds it (hex, letters of one case, base 32,
base 36, base 62, base 64). Three tests ask whether its symbols are random: chi-squared
uniformity over the alphabet, Wald-Wolfowitz runs about the median, and serial correlation.
Fisher's statistic joins their p-values.

How likely ordinary text would look as random is read from ordinary text itself: the plain
words of all different texts, joined to strings of each length, give mean and spread of the
log statistic by length class. Within a length class, Benjamini-Hochberg at ``FDR`` is applied to all
candidates of the corpus; p-values are counted in cells of a logarithmic scale (upper edges,
so the control errs to the safe side), which is a table of fixed size.

Defined cases: a null text is empty and has no spans; repeated rows are counted and reported
each; candidates within a known form are not reported again; an empty table has no thresholds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivetgraph.llm.common import mapped, sliced, text_key

FDR = 0.01
MIN_LENGTH = 20
LENGTH_EDGES = (20, 24, 28, 32, 40, 48, 64, 96, 128)
P_CELLS = 200
CELL = 0.25  # of log10 p

# fixed values: the base forms of a secret
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)
_SETS = [(set(a), {c: i for i, c in enumerate(a)}) for a in ALPHABETS]
_CODES = np.array([[o.get(chr(c), -1) for c in range(128)] for _, o in _SETS], np.int64)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if has_long(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def has_long(text: str) -> bool:
    """Whether any stretch without white space can hold a candidate."""
    return max(map(len, text.split()), default=0) >= MIN_LENGTH


def length_class(n: int) -> int:
    return sum(n >= e for e in LENGTH_EDGES) - 1


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _tails(z: np.ndarray) -> np.ndarray:
    return np.fromiter(map(_normal_tail, z.tolist()), float, len(z))


def _battery(x: np.ndarray, k: int) -> np.ndarray:
    """Fisher's statistic of each row of ``x``, symbols of an alphabet of ``k``."""
    m, n = x.shape
    counts = np.bincount((x + np.arange(m)[:, None] * k).ravel(), minlength=m * k).reshape(m, k)
    chi = (counts**2).sum(axis=1) * k / n - n
    # Wilson-Hilferty
    d = k - 1
    p1 = _tails(((np.maximum(chi, 1e-9) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = x >= k / 2
    up = high.sum(axis=1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p2 = np.where(var > 0, 2 * _tails(np.abs(runs - mean) / np.sqrt(np.where(var > 0, var, 1.0))), 1e-12)
    c = x - x.mean(axis=1, keepdims=True)
    r = (c[:, 1:] * c[:, :-1]).sum(axis=1) / np.maximum((c * c).sum(axis=1), 1e-12)
    p3 = 2 * _tails(np.abs(r + 1 / n) * math.sqrt(n))
    return -2 * sum(np.log(np.clip(p, 1e-300, 1.0)) for p in (p1, p2, p3))


def statistic(s: str) -> float | None:
    """Fisher's statistic of the battery: about 6 for noise, large for text."""
    chars = set(s)
    order = next((o for a, o in _SETS if chars <= a), None)
    if order is None or s.isdigit():
        return None
    return float(_battery(np.fromiter((order[c] for c in s), np.int64, len(s))[None], len(order))[0])


def statistics(pieces: np.ndarray) -> np.ndarray:
    """:func:`statistic` of strings of letters of one length, given as rows of their codes."""
    out, left = np.empty(len(pieces)), np.arange(len(pieces))
    for codes, alphabet in zip(_CODES, ALPHABETS):
        x = codes[pieces[left]]
        fits = (x >= 0).all(axis=1)
        if fits.any():
            out[left[fits]] = _battery(x[fits], len(alphabet))
        left = left[~fits]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, statistic) of candidates that lie in no base form."""
    out = []
    if has_long(text):
        for m in CANDIDATE.finditer(text):
            if not any(a < m.end() and m.start() < b for a, _, b in base):
                t = statistic(m.group())
                if t is not None:
                    out.append((m.start(), m.end(), t))
    return out


PLAIN = re.compile(r"(?<!\S)[A-Za-z]{1,19}(?!\S)")


def ordinary(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of squares [texts, length classes] of the log statistic of strings
    joined from all plain words of each text, one of each length class in turn: what
    candidates of ordinary text would look like."""
    turn = sum(LENGTH_EDGES)
    joined = ["".join(PLAIN.findall(t)) if t else "" for t in texts]
    size = np.fromiter(map(len, joined), np.int64, len(joined))
    lines = -(-size // turn)
    owner = np.repeat(np.arange(len(joined)), lines)
    letters = "".join(w.ljust(n * turn, "\0") for w, n in zip(joined, lines.tolist()))
    rows = np.frombuffer(letters.encode("ascii"), np.uint8).reshape(-1, turn)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lines) - lines, lines)
    fill = size[owner] - place * turn
    sums, at = np.zeros((3, len(LENGTH_EDGES), len(joined))), 0
    for i, n in enumerate(LENGTH_EDGES):
        full = np.flatnonzero(fill >= at + n)
        for part in np.array_split(full, len(full) // 10_000 + 1):
            t = np.log(statistics(rows[part, at : at + n]) + 1e-6)
            for j in range(3):
                sums[j, i] += np.bincount(owner[part], t**j, len(joined))
        at += n
    return sums[0].T, sums[1].T, sums[2].T


def _spread(docs: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean and deviation of ordinary text's log statistic by length class, over all
    different texts; a text's copies count once."""

    def measured(c: dict) -> dict:
        n, total, squares = ordinary(c["text"])
        some = np.flatnonzero(n[:, 0])
        return {"key": [c["key"][i] for i in some]} | {
            name: x[some].tolist() for name, x in (("n", n), ("total", total), ("squares", squares))
        }

    keyed = docs.select("text", text_key().alias("key"))
    schema = "key binary, n array<double>, total array<double>, squares array<double>"
    each = mapped(keyed, measured, schema).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "total", "squares")])
    by_class = each.select(F.posexplode(F.arrays_zip("n", "total", "squares")).alias("cls", "x"))
    grouped = by_class.where("x.n > 0").groupBy("cls").agg(
        F.sum("x.n").alias("n"), F.sum("x.total").alias("total"), F.sum("x.squares").alias("squares")
    )
    out = {}
    for r in grouped.collect():  # a row per length class
        mean = r.total / r.n
        var = max(r.squares - r.n * mean * mean, 0.0) / (r.n - 1) if r.n > 1 else 0.0
        out[r.cls] = (mean, max(math.sqrt(var), 0.05))
    return out


def log_p(t: float, n: int, spread: dict[int, tuple[float, float]]) -> float:
    """log10 of the chance that ordinary text of this length looks as random."""
    known = spread.get(length_class(n)) or (spread[max(spread)] if spread else None)
    if known is None:
        return 0.0
    z = (known[0] - math.log(t + 1e-6)) / known[1]
    return math.log10(max(_normal_tail(z), 1e-49))


def fit(docs: DataFrame, fdr: float = FDR) -> tuple[dict, dict[int, float]]:
    """(spread of ordinary text, largest accepted log10 p by length class) for a corpus."""
    spread = _spread(docs)

    def cells(c: dict) -> dict:
        out = []
        for t in c["text"]:
            for a, b, s in candidates(t, base_spans(t)) if t else []:
                out.append((length_class(b - a), min(P_CELLS - 1, int(-log_p(s, b - a, spread) / CELL))))
        return {"cls": [a for a, _ in out], "cell": [b for _, b in out]}

    counts = mapped(docs.select("text"), cells, "cls int, cell int").groupBy("cls", "cell").count()
    limits: dict[int, float] = {}
    table = counts.toPandas()  # at most length classes x cells rows
    for cls, rows in table.groupby("cls"):
        total, above = rows["count"].sum(), 0
        for cell, n in sorted(zip(rows["cell"], rows["count"]), reverse=True):
            above += n
            if 10 ** (-cell * CELL) <= fdr * above / total:
                limits[int(cls)] = -cell * CELL
    return spread, limits


def spans_of(text: str | None, model: tuple[dict, dict[int, float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, by start, then kind."""
    if not text:
        return []
    spread, limits = model
    base = base_spans(text)
    out = list(base)
    for a, b, t in candidates(text, base):
        limit = limits.get(length_class(b - a))
        if limit is not None and log_p(t, b - a, spread) <= limit:
            out.append((a, 3, b))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_report(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, and all spans."""
    model = fit(docs) if model is None else model

    def report(c: dict) -> dict:
        found = [spans_of(t, model) for t in c["text"]]
        base = [[s for s in x if s[1] < 3] for x in found]
        counts = {f"n_{KINDS[k]}": [sum(s[1] == k for s in x) for x in base] for k in range(3)}
        digest = [hashlib.sha256(shown(x).encode()).hexdigest() for x in base]
        return {"doc_id": c["doc_id"]} | counts | {"base_sha256": digest, "spans": [shown(x) for x in found]}

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return mapped(docs.select("doc_id", "text"), report, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (and ``n_chars`` made to fit)."""
    model = fit(docs)

    def cleaned(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, b in spans_of(text, model):
            if b > at:
                out += [text[at:a], mark] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    def hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for piece in sliced(batch, 2 << 20):
                texts = pa.array(map(cleaned, piece.column(at).to_pylist()), batch.schema.field(at).type)
                yield piece.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(hidden, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
