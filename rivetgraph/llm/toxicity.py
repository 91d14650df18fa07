"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The gap-weighted kernel of order ``ORDER`` compares words through all their letter triples in
order, each weighted by ``DECAY`` to the length it spans, so ``i*d*i.o-t`` and ``idiiot`` stay
near ``idiot``. Landmarks are words and word beginnings, so that a stem is known with endings
never seen. A sentence is seen through its best match with each landmark string; the
Nyström map turns these into features, and a squared-hinge SVM separates them. A document
scores as its most toxic sentence; a logistic curve makes that a probability.

Landmarks and SVM are fitted on a bounded sample of labelled documents (``TRAIN_DOCS`` of each
label, the smallest by hash). A toxic label speaks of the document, not of its sentences: the
SVM starts from the sentence nearest to a landmark and chooses its witnesses anew each round.

Every whole text is scored: words longer than ``SPAN`` letters by overlapping windows, and
runs of single characters (``i d i o t``) as one word. Labels, lang, source and doc_id are no
input of a score.

Defined cases: null and empty texts score as a sentence without any match; null labels are
not learnt from; with labels of one kind only, every score is that kind's smoothed share;
a null doc_id is not held out; repeated rows each get a row.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph.llm.common import mapped, sliced

ORDER = 3
DECAY = 0.6
SPAN = 16
STRIDE = 8
TRAIN_DOCS = 1500
SHORT = 6  # letters of the windows that find a stem in a longer word
TOXIC_LANDMARKS = 40
SENTENCE_WORDS = 40
CACHE_WORDS = 300_000
STAGE_WORDS = 60_000
CANDIDATES = 600
MIN_ODDS = 4  # a toxic landmark is found in so many toxic texts for one other, in a sample of both
EDGES = ".,;:!?'\"()[]{}<>*%&$#|-_"
SVM_COST = 10.0
POWER = 4  # the normalised kernel to this power is a kernel too; it parts near matches from chance ones
MIN_SHARE = 0.01  # of the toxic sample's texts that a toxic landmark is found in

SENTENCE = re.compile(r"[.!?\n]\s+|\n")
SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_FOLD = {ord(a): b for a, b in zip("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")}


def letter_codes(word: str) -> bytes:
    """1 to 26 for letters, accents dropped; 0 for all else, cut off at both ends."""
    folded = word if word.isascii() else word.translate(_FOLD)
    return folded.encode("ascii", "replace").translate(_CODES).strip(b"\0")


_CODES = bytes(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 0 for c in range(256))


def windows(codes: bytes) -> list[bytes]:
    """The word itself, or overlapping pieces of it if it is long; and all its short windows."""
    n = len(codes)
    if n <= SHORT:
        return [codes]
    whole = [codes] if n <= SPAN else [codes[i : i + SPAN] for i in range(0, n - SPAN + STRIDE, STRIDE)]
    return whole + [codes[i : i + SHORT] for i in range(n - SHORT + 1)]


def beginnings(word: str) -> list[str]:
    """The word (up to SPAN letters) and its beginnings of 4 to 10 letters."""
    return [word] * (len(word) <= SPAN) + [word[:n] for n in range(4, min(len(word), 11))]


def best_rows(rows: np.ndarray, at: np.ndarray, groups: list[list]) -> np.ndarray:
    """The column-wise maximum over each group's rows; ``at`` lists the rows group by group."""
    starts = np.cumsum([0] + [len(g) for g in groups[:-1]])
    return np.maximum.reduceat(rows[at], starts, axis=0)


def _matrix(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(SPAN, b"\0") for p in pieces), np.uint8).reshape(-1, SPAN)


def self_kernel(c: np.ndarray) -> np.ndarray:
    """K(w, w) of every row of codes, by the kernel's recursion over prefix pairs."""
    cols = np.ascontiguousarray(c.T)
    width, n = cols.shape
    sq = DECAY * DECAY
    # inner[l][j]: weight of common subsequences of length l of the prefixes up to i and j
    inner = [np.ones((width + 1, n), np.float64)] + [np.zeros((width + 1, n)) for _ in range(ORDER - 1)]
    total = np.zeros(n)
    for i in range(width):
        alike = (cols == cols[i]) & (cols[i] > 0)
        weight = alike * sq
        total += (weight * inner[ORDER - 1][:-1]).sum(axis=0)
        # the longest first: each order reads the next shorter one as it was at the last i
        for order in range(ORDER - 1, 0, -1):
            run = np.zeros(n)
            inner[order] *= DECAY
            for j in range(width):
                run *= DECAY
                run += weight[j] * inner[order - 1][j]
                inner[order][j + 1] += run
    return total


@dataclasses.dataclass
class Landmarks:
    """Unit vectors of the landmark strings over letter triples."""

    strings: list[str]

    def __post_init__(self) -> None:
        c = _matrix([letter_codes(s)[:SPAN] for s in self.strings])
        self.table = np.zeros((27**3, len(c)), np.float32)
        for m, row in enumerate(c.tolist()):
            for i, j, k in itertools.combinations(range(SPAN), 3):
                if row[i] and row[j] and row[k]:
                    self.table[(row[i] * 27 + row[j]) * 27 + row[k], m] += DECAY ** (k - i + 1)
        self.table /= np.maximum(np.sqrt((self.table**2).sum(axis=0)), 1e-12)
        self.used = self.table.any(axis=1)

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernel, to ``POWER``, of each word with each landmark (best window)."""
        pieces = [windows(letter_codes(w)) for w in words]
        place: dict[bytes, int] = {}
        at = np.fromiter((place.setdefault(p, len(place)) for ps in pieces for p in ps), np.int64)
        return best_rows(self.kernel(list(place)), at, pieces)

    def kernel(self, pieces: list[bytes]) -> np.ndarray:
        """The same for pieces of words, each of at most ``SPAN`` letters."""
        c, size = _matrix(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros((len(c), self.table.shape[1]), np.float32)
        low = ORDER - 1
        for width in range(ORDER, SPAN + 1):
            some = np.flatnonzero((size > low) & (size <= width))
            if len(some) < 500 and width < SPAN:
                continue  # few: with the next wider ones
            low = width
            for part in np.array_split(some, max(1, len(some) // 20_000)):
                if len(part):
                    out[part] = self._rows(c[part, :width])
        return out

    def _rows(self, c: np.ndarray) -> np.ndarray:
        acc = np.zeros((len(c), self.table.shape[1]), np.float32)
        cols = np.ascontiguousarray(c.T).astype(np.int32)
        for i, j in itertools.combinations(range(len(cols) - 1), 2):
            pair = (cols[i] * 27 + cols[j]) * 27
            for k in range(j + 1, len(cols)):
                code = pair + cols[k]
                hit = np.flatnonzero(self.used[code])
                if len(hit):
                    acc[hit] += np.float32(DECAY ** (k - i + 1)) * self.table[code[hit]]
        near = np.flatnonzero(acc.any(axis=1))
        norm = np.sqrt(self_kernel(c[near])).astype(np.float32)
        acc[near] = (acc[near] / np.maximum(norm, 1e-12)[:, None]) ** POWER
        return acc


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words by sentence, at most ``SENTENCE_WORDS`` each; spaced-out runs joined."""
    if not text:
        return []
    low = text.lower()
    out = [[re.sub(r"\s+", "", m.group())] for m in SPACED.finditer(low)]
    for s in SENTENCE.split(low):
        words = s.split()
        out.extend(words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS))
    return out


class Features:
    """Sentence features. Words, and the windows of words, seen so far are kept in tables of
    fixed size; words of equal letters share a row."""

    def __init__(self, marks: Landmarks, words: int = CACHE_WORDS) -> None:
        self.marks, self.width = marks, len(marks.strings)
        self.index: dict[str, int] = {}
        self.rows: dict[bytes, int] = {}
        self.pieces: dict[bytes, int] = {}
        self.table = np.zeros((words, self.width), np.float32)
        self.piece_table = np.zeros((words, self.width), np.float32)

    def of(self, texts: list[list[list[str]]]) -> list[np.ndarray]:
        """Features of each text's sentences; a text without any is a sentence without match."""
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 100):
            out += self._of(texts[i : i + 100])
        return out

    def _learn(self, words: list[str]) -> None:
        fresh = []
        for w in words:
            codes = letter_codes(w)
            row = self.rows.get(codes)
            if row is None:
                row = self.rows[codes] = len(self.rows)
                fresh.append(codes)
            self.index[w] = row
        for i in range(0, len(fresh), 5000):
            some = fresh[i : i + 5000]
            base = self.rows[some[0]]
            self.table[base : base + len(some)] = self._similarity(some)

    def _similarity(self, words: list[bytes]) -> np.ndarray:
        groups = [windows(c) for c in words]
        new = list({p for g in groups for p in g if p not in self.pieces})
        if len(self.pieces) + len(new) > len(self.piece_table):
            self.pieces = {}
            new = list({p for g in groups for p in g})
            if len(new) > len(self.piece_table):
                self.piece_table = np.zeros((len(new), self.width), np.float32)
        base = len(self.pieces)
        self.pieces.update(zip(new, range(base, base + len(new))))
        self.piece_table[base : base + len(new)] = self.marks.kernel(new)
        at = np.array([self.pieces[p] for g in groups for p in g], np.int64)
        return best_rows(self.piece_table, at, groups)

    def _of(self, texts: list[list[list[str]]]) -> list[np.ndarray]:
        new = list({w for t in texts for s in t for w in s if w not in self.index})
        if len(self.index) + len(new) > len(self.table):
            self.index, self.rows = {}, {}
            new = list({w for t in texts for s in t for w in s})
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.width), np.float32)
        self._learn(new)
        out = []
        for t in texts:
            if not t:
                out.append(np.zeros((1, self.width), np.float32))
                continue
            at = np.array([self.index[w] for s in t for w in s], np.int64)
            out.append(best_rows(self.table, at, t))
        return out


@dataclasses.dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, features: list[np.ndarray]) -> list[float]:
        best = np.array([(x @ self.weights).max() + self.bias for x in features])
        return (1 / (1 + np.exp(-(self.slope * best + self.shift)))).tolist()


def held_out(doc_id: str = "doc_id") -> Column:
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(fold == 0, F.lit(False))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = None
    for _ in range(50):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
    return w


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a probability curve through decision values, with softened targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z, w = np.stack([f, np.ones_like(f)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - t) + 1e-6 * w)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def diverse(strings: list[str], most: int) -> list[str]:
    """The first strings that are neither part of, nor much like, one taken before."""
    alike = Landmarks(strings).similarity(strings) if strings else None
    taken: list[int] = []
    for i, s in enumerate(strings):
        if len(taken) == most:
            break
        if all(s not in strings[j] and strings[j] not in s and alike[i, j] < 0.3 for j in taken):
            taken.append(i)
    return [strings[i] for i in taken]


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | float:
    """The model, or the smoothed share of toxic labels if they are all alike."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda v: known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # at most 2 * train_docs rows of two numbers
    sample = F.broadcast(pick(1).unionByName(pick(0)))
    # copies count once
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", "text").distinct()
    def strings(c: dict) -> dict:
        out: dict = {"toxic": [], "s": []}
        for v, t in zip(c["toxic"], c["text"]):
            words = {w for s in sentences(t) for x in s if (w := x.strip(EDGES)).isalpha()}
            for x in words.union(*map(beginnings, words)):
                out["toxic"].append(v)
                out["s"].append(x)
        return out

    counts = mapped(texts, strings, "toxic int, s string").groupBy("s").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")
    )
    counts = counts.where(F.char_length("s").between(4, SPAN))
    odds = F.col("p") * F.log((F.col("p") + 0.5) / (F.col("n") + 0.5))
    toxic_texts = texts.where("toxic = 1").count()
    telling = (F.col("p") >= MIN_SHARE * toxic_texts) & (F.col("p") >= MIN_ODDS * F.col("n"))
    ranked = counts.where(telling).orderBy(odds.desc(), F.char_length("s").desc(), "s")
    marks = diverse([r.s for r in ranked.limit(CANDIDATES).collect()], TOXIC_LANDMARKS)
    if not marks:
        return 0.0

    def sampled(c: dict) -> dict:
        feats = Features(Landmarks(marks)).of([sentences(t) for t in c["text"]])
        keep = [x[np.argsort(-x.max(axis=1), kind="stable")[:8]] for x in feats]
        return {"toxic": c["toxic"], "x": [x.ravel().astype(float).tolist() for x in keep]}

    rows = mapped(texts, sampled, "toxic int, x array<double>").collect()  # bounded: eight sentences a document
    y = np.array([r.toxic for r in rows])
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.0
    bags = [np.array(r.x).reshape(-1, len(marks)) for r in rows]
    gram = np.clip(Landmarks(marks).similarity(marks), 0, 1).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    nystrom = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    mapped_bags = [b @ nystrom for b in bags]
    witness = [0] * len(bags)
    for _ in range(6):
        plus = np.array([b[i] for b, i, v in zip(mapped_bags, witness, y) if v])
        minus = np.concatenate([b for b, v in zip(mapped_bags, y) if not v])
        x, s = np.concatenate([plus, minus]), np.r_[np.ones(len(plus)), -np.ones(len(minus))]
        w = svm(x, s, SVM_COST * np.where(s > 0, 1.0, len(plus) / len(minus)))
        chosen = [int((b @ w[:-1]).argmax()) for b in mapped_bags]
        if chosen == witness:
            break
        witness = chosen
    best = np.array([(b @ w[:-1]).max() + w[-1] for b in mapped_bags])
    return Model(marks, nystrom @ w[:-1], float(w[-1]), *logistic(best, y))


# Features of the landmarks last used, kept for the next task of a reused worker process
_KEPT: dict[tuple[str, ...], Features] = {}


def kept_features(landmarks: list[str]) -> Features:
    key = tuple(landmarks)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Features(Landmarks(landmarks))
    return _KEPT[key]


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    if not isinstance(model, Model):
        return docs.select("doc_id", F.lit(model).alias("score"))

    def scored(c: dict) -> dict:
        features = kept_features(model.landmarks)
        return {"doc_id": c["doc_id"], "score": model.scores(features.of([sentences(t) for t in c["text"]]))}

    return mapped(docs.select("doc_id", "text"), scored, "doc_id bigint, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scores = score(docs, train(docs, labels))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scores.select("doc_id", held_out().alias("held_out"), "score", predicted)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model calls toxic."""
    model = train(docs, labels)
    if not isinstance(model, Model):
        return docs if model < 0.5 else docs.limit(0)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of this task only and small: other stages share the executor's memory
        features = Features(Landmarks(model.landmarks), STAGE_WORDS)
        for batch in batches:
            for piece in sliced(batch, 2 << 20):
                texts = piece.column("text").to_pylist()
                clean = np.array(model.scores(features.of([sentences(t) for t in texts]))) < 0.5
                yield piece.filter(pa.array(clean))

    return docs.mapInArrow(kept, docs.schema)
