"""Sparse suffix arrays: find passages that occur again, within or across documents.

* Of every text only the suffixes at minimiser positions are kept: in any ``guarantee``
  consecutive words one position is chosen by content alone, so two copies of a passage keep
  the same suffixes. A suffix is known by a 64-bit hash of its first ``anchor`` words.
* Suffixes whose anchor occurs once are dropped (a grouped count, combined before the
  shuffle). The others get their context, the word hashes left and right of the anchor.
* Around each kept suffix every window of ``min_words`` words that holds the anchor is hashed.
  Of the suffixes with the same window hash all but the earliest have the window marked as
  repeated. Two copies of a window choose the same suffix in it, so none is missed.
* An anchor with many suffixes is dealt out in salted parts. The earliest occurrences of a
  part's windows meet in a grouped minimum per window hash, a row per part and window.

Order of occurrences: doc_id (null first), then the text's hash, then place. Defined cases:
null and empty texts, and texts of fewer than ``min_words`` words, have no repeats; repeated
rows (same doc_id and text) count as one occurrence and get the same spans; spans are in
words ``[^\\x20\\x09-\\x0D]+``, end exclusive, merged and sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rivetgraph.llm.common import WORD, grams, mapped, mixed, word_hashes, words_of
from rivetgraph.session import cut

MIN_WORDS = 50
GRAM = 5
GUARANTEE = 33
SALT_ROWS = 20_000

SUFFIX = "anchor bigint, doc_id bigint, k64 bigint, pos int, salts int, lctx binary, rctx binary"
OUT = "doc_id bigint, k64 bigint, start int, end int, head bigint"


def minimisers(h: np.ndarray, min_words: int, gram: int, guarantee: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sparse suffixes of a text's word hashes and their anchors' hashes."""
    if len(h) < min_words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    window = guarantee - gram + 1
    anchor = min_words - window + 1
    g = grams(h, gram)
    seen = np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1)
    pos = np.unique(seen + np.arange(len(seen)))
    pos = pos[pos + anchor <= len(h)]
    hashed = np.zeros(len(pos), np.uint64)
    for j in range(anchor):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + (h[pos + j] ^ (hashed >> np.uint64(29)))
    return pos, hashed


def _suffixes(docs: DataFrame, min_words: int, gram: int, guarantee: int) -> DataFrame:
    def pick(c: dict) -> dict:
        keys, places, anchors = [], [], []
        for k64, text in zip(c["k64"], c["text"]):
            pos, hashed = minimisers(word_hashes(words_of(text)), min_words, gram, guarantee)
            keys.append(np.full(len(pos), k64, np.int64))
            places.append(pos.astype(np.int32))
            anchors.append(hashed.view(np.int64))
        if not keys:
            keys, places, anchors = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        return {
            "anchor": pa.array(np.concatenate(anchors)),
            "k64": pa.array(np.concatenate(keys)),
            "pos": pa.array(np.concatenate(places)),
        }

    return mapped(docs.select("k64", "text"), pick, "anchor bigint, k64 bigint, pos int")


def _with_context(docs: DataFrame, min_words: int, gram: int, guarantee: int) -> DataFrame:
    """docs(doc_id, k64, text, places) → the suffixes at their places, with context."""
    reach = guarantee - gram
    anchor = min_words - reach

    def cutout(c: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("anchor", "doc_id", "k64", "pos", "salts", "lctx", "rctx")}
        for doc_id, k64, text, places in zip(c["doc_id"], c["k64"], c["text"], c["places"]):
            h = word_hashes(words_of(text))
            pos, hashed = minimisers(h, min_words, gram, guarantee)
            salts = {p["pos"]: p["salts"] for p in places}
            words = (h >> np.uint64(32)).astype("<u4")
            for p, a in zip(pos.tolist(), hashed.view(np.int64).tolist()):
                if p in salts:
                    out["anchor"].append(a)
                    out["doc_id"].append(doc_id)
                    out["k64"].append(k64)
                    out["pos"].append(p)
                    out["salts"].append(salts[p])
                    out["lctx"].append(words[max(0, p - reach) : p][::-1].tobytes())
                    out["rctx"].append(words[p + anchor : p + anchor + reach].tobytes())
        return out

    return mapped(docs, cutout, SUFFIX)


def _context(side: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes [n, reach + 1] of the first 0, 1, .. words of each context, and the contexts' lengths."""
    words = np.frombuffer(b"".join(c.ljust(4 * reach, b"\0") for c in side), "<u4").reshape(len(side), reach)
    out = np.zeros((len(side), reach + 1), np.uint64)
    for i in range(reach):
        out[:, i + 1] = mixed(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + words[:, i] + np.uint64(1))
    return out, np.fromiter((len(c) // 4 for c in side), np.int64, len(side))


def _compare(min_words: int, anchor: int):
    """Marks the windows around sorted suffixes whose equal has come before in the anchor's part;
    ``head`` names the windows of a part's earliest occurrences where there are several parts."""
    target = to_arrow_schema(StructType.fromDDL(OUT))
    reach = min_words - anchor

    def marked(t: pa.Table) -> pa.RecordBatch:
        k64, pos, keys = (t.column(n).to_numpy() for n in ("k64", "pos", "anchor"))
        salts, salt = t.column("salts").to_numpy(), t.column("salt").to_numpy()
        left, n_left = _context(t.column("lctx").to_pylist(), reach)
        right, n_right = _context(t.column("rctx").to_pylist(), reach)
        doc = t.column("doc_id")
        order = np.rec.fromarrays([doc.is_valid().to_numpy(), doc.fill_null(0).to_numpy(), k64, pos])
        low, high = np.full(len(pos), reach + 1), np.full(len(pos), -1)
        rows, starts, heads = [], [], []
        for n in range(reach + 1):
            at = np.flatnonzero((n_left >= n) & (n_right >= reach - n))
            window = mixed(mixed(left[at, n] + np.uint64(n + 1)) + right[at, reach - n] + keys[at].view(np.uint64))
            part = mixed(window + salt[at].astype(np.uint64))
            _, first, same = np.unique(part, return_index=True, return_inverse=True)
            # a repeated row is no later occurrence
            again = order[at] != order[at[first[same]]]
            low[at[again]] = np.minimum(low[at[again]], n)
            high[at[again]] = n
            top = first[salts[at[first]] > 1]
            rows.append(at[top])
            starts.append(pos[at[top]] - n)
            heads.append(window[top].view(np.int64))
        hit = np.flatnonzero(high >= 0)
        rows, start = np.concatenate([hit, *rows]), np.concatenate([pos[hit] - high[hit], *starts])
        end = np.concatenate([pos[hit] - low[hit] + min_words, start[len(hit) :] + min_words])
        head = pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(np.concatenate(heads))])
        of = t.select(["doc_id", "k64"]).take(pa.array(rows)).combine_chunks()
        doc_id, k = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in of.columns)
        return pa.RecordBatch.from_arrays(
            [doc_id, k, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), head], schema=target
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the suffixes of a part that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, salt = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
            ends = np.flatnonzero((keys != keys[-1]) | (salt != salt[-1]))
            cut_at = int(ends[-1]) + 1 if len(ends) else 0
            if held and not cut_at:
                last = held[-1]
                if last.column("anchor")[-1].as_py() == keys[0] and last.column("salt")[-1].as_py() == salt[0]:
                    held.append(batch)
                    continue
            if held or cut_at:
                yield marked(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
            held = [batch.slice(cut_at)]
        if held:
            yield marked(pa.Table.from_batches(held))

    return walk


def repeated_spans(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    gram: int = GRAM,
    guarantee: int = GUARANTEE,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """doc_id, k64 (hash of the text) and spans (array of start, end in words) for each text
    with a passage of ``min_words`` words that occurs earlier."""
    docs = docs.select("doc_id", "text").withColumn("k64", F.xxhash64("text"))
    suffixes = cut(_suffixes(docs, min_words, gram, guarantee))
    often = suffixes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = often.select("anchor", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    # one row per text, no longer than the text itself
    places = (
        suffixes.join(salted, "anchor").groupBy("k64").agg(F.collect_set(F.struct("pos", "salts")).alias("places"))
    )
    rows = _with_context(docs.join(places, "k64").select("doc_id", "k64", "text", "places"), min_words, gram, guarantee)
    walk = _compare(min_words, min_words - guarantee + gram)
    salt = F.pmod(F.xxhash64("doc_id", "k64", "pos"), F.col("salts").cast("bigint"))
    dealt = rows.withColumn("salt", salt).repartition("anchor", "salt")
    found = cut(dealt.sortWithinPartitions("anchor", "salt", "doc_id", "k64", "pos").mapInArrow(walk, OUT))
    heads = found.where("head is not null")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "k64", "start")
    first = heads.groupBy("head").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    again = heads.join(first, "head").where(order != F.col("first")).select(*found.columns)
    marks = found.where("head is null").unionByName(again).select("doc_id", "k64", F.struct("start", "end").alias("s"))
    return marks.groupBy("doc_id", "k64").agg(_merged(F.sort_array(F.collect_set("s"))).alias("spans"))


def _merged(spans):
    """Sorted spans with those that overlap or touch made one."""
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))),
    )
    return F.aggregate(
        spans,
        F.slice(spans, 1, 1),
        lambda acc, x: F.when(x["start"] <= last(acc)["end"], joined(acc, x)).otherwise(F.concat(acc, F.array(x))),
    )


def repeat_report(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_repeated (words in repeated passages), spans."""
    spans = repeated_spans(docs, **how)
    rows = docs.select("doc_id", F.xxhash64("text").alias("k64"))
    joined = rows.alias("r").join(
        spans.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.k64") == F.col("s.k64")), "left"
    )
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return joined.select(
        "r.doc_id",
        F.coalesce(total, F.lit(0).cast("bigint")).alias("n_repeated"),
        F.coalesce(shown, F.lit("")).alias("spans"),
    )


def without_words(text: str, spans: list) -> str:
    """The text without the words of ``spans``; the white space after a removed passage goes with it."""
    words = list(WORD.finditer(text))
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]].start()])
        at = words[s["end"]].start() if s["end"] < len(words) else len(text)
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence taken out of ``text``
    (and ``n_chars`` made to fit, where there is one). Texts that had words and lose all of
    them are dropped; all others stay."""
    spans = repeated_spans(docs, **how)
    keyed = docs.withColumn("__k", F.xxhash64("text"))
    named = spans.select(F.col("doc_id").alias("__d"), F.col("k64").alias("__s"), "spans").withColumnRenamed("spans", "__spans")
    joined = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__s")), "left")

    @F.pandas_udf("string")
    def kept(text, spans):
        return text.combine(spans, lambda t, s: t if s is None else without_words(t, s))

    out = joined.where("__spans is null").select(*docs.columns)
    changed = joined.where("__spans is not null").withColumn("text", kept("text", "__spans"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.unionByName(changed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns))
