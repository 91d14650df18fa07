"""Packing by deficit round-robin: every window takes from each source its target share.

Sources are queues of tokens. In every round a source's deficit grows by its share of a
window and it is served up to it; what is left over is carried to the next round, so the
tokens of source *s* served up to round *r* are ``floor(r * share_s * window)``, and a
document's place in its queue tells its rounds. Documents are cut where a round ends. A queue
that runs dry leaves the rounds to the others, which keep their proportions.

Rounds follow one another, and in a round the sources by name; that order, without gaps, is
cut into sequences. So padding is left in the last sequence only. All running sums are made
in levels (within a bucket, then over bucket totals): no source and no round order passes
through one task, and only (row, length) pairs are summed. Tokens are made once, written to
the shared folder, and meet their pieces by row number.

Target shares default to each source's share of all tokens, which keeps the mixture from the
first window to the last; other targets may be given.

Defined cases: a null text is empty and has the end token only; a null source is a queue of
its own; a source without a target gets the smallest share given; repeated rows are packed
each; an empty table has no pieces.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rivetgraph.llm.common import mapped
from rivetgraph.session import cut

SEQUENCE = 2048
WINDOW = 32 * SEQUENCE
BUCKETS = 1024
END_ID = 1
LONG_SPACE = 50_000
END_OF_TEXT = "<|endoftext|>"  # fixed value: the vocabulary's special token


def running_start(
    df: DataFrame, value: str, out: str, keys: Sequence[str], levels: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same ``keys``, in the order
    of ``levels``, then ``order``. Each level holds a bounded part of the one above, and
    only its totals are ordered there."""
    scope = [*keys, *levels]
    inside = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if not levels:
        return here
    totals = df.groupBy(*scope).agg(F.sum(value).alias("__sum"))
    carried = f"__before{len(levels)}"
    before = running_start(totals, "__sum", carried, keys, levels[:-1], [levels[-1]])
    before = before.select(*[F.col(c).alias(f"__{c}") for c in scope], carried)
    same = F.lit(True)
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = here.join(before, same)
    return joined.select(*df.columns, (F.col(out) + F.col(carried)).alias(out))


# fixed value: the byte-level pretoken rule
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


@functools.cache
def encoder(path: str, ranks: str):
    """text → token ids as bytes, by the byte-level BPE file at ``path``; made once a worker.

    ``ranks`` holds the same vocabulary as ranks for a faster reader of it. Texts with letters
    beyond Latin, where the readers' character tables may differ, texts with the special token
    and those with ``LONG_SPACE`` white space in a row, too much for the faster reader, go
    through the tokenizer of ``path`` itself.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("bytes", pat_str=PRETOKENS, mergeable_ranks=table, special_tokens={})
    # Latin letters, digits, marks and the usual white space
    plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")

    spaces = re.compile(r"\s{%d}" % LONG_SPACE)

    def ids(texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            fits = len(t) < LONG_SPACE or not spaces.search(t)
            if fits and plain.fullmatch(t) and END_OF_TEXT not in t:
                out.append(packed(fast.encode_ordinary(t)))
            else:
                out.append(packed(tokenizer.encode(t, add_special_tokens=False).ids))
        return out

    return ids


def tokens(docs: DataFrame, path: str, ranks: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, ids (binary, two bytes an id, the end token last) and n_tokens."""

    def made(c: dict) -> dict:
        end = int(end_id).to_bytes(2, "little")
        ids = [x + end for x in encoder(path, ranks)([t or "" for t in c["text"]])]
        return {"doc_id": c["doc_id"], "source": c["source"], "ids": ids, "n_tokens": [len(x) // 2 for x in ids]}

    schema = "doc_id bigint, source string, ids binary, n_tokens bigint"
    return mapped(docs.select("doc_id", "source", "text"), made, schema, 2 << 20)


def _rounds(queued: DataFrame, targets: dict[str | None, float] | None, window: int) -> DataFrame:
    """queued(rid, source, n_tokens, at) → parts of documents by round:
    rid, source, doc_tokens, start, length, round."""
    totals = queued.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    if targets:
        least = min(targets.values())
        weight = F.lit(float(least))
        for name, share in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(share)).otherwise(weight)
        totals = totals.withColumn("w", weight)
    else:
        totals = totals.withColumn("w", F.col("total").cast("double"))
    shares = _shared(totals)
    quantum = (F.col("w") / F.col("all") * window).alias("quantum")
    q = shares.select(F.col("source").alias("s"), quantum)
    rows = queued.join(q, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = F.floor(F.col("at") / F.col("quantum"))
    last = F.floor((F.col("at") + F.col("n_tokens") - 1) / F.col("quantum"))
    # a bound is an integer; a part may come out empty by rounding
    spanned = F.sequence(F.greatest(first - 1, F.lit(0)), last + 1)
    # a quantum below one token leaves most rounds without any: list those of each token
    of_token = lambda k: F.greatest(F.ceil((k + 1) / F.col("quantum")) - 1, F.lit(1).cast("bigint"))
    each = F.transform(
        F.sequence("at", F.col("at") + F.col("n_tokens") - 1),
        lambda k: F.array(of_token(k) - 1, of_token(k), of_token(k) + 1),
    )
    listed = F.when(F.col("quantum") < 1, F.array_distinct(F.flatten(each))).otherwise(spanned)
    parts = rows.withColumn("round", F.explode(listed))
    low = F.greatest(F.floor(F.col("round") * F.col("quantum")), F.col("at"))
    high = F.least(F.floor((F.col("round") + 1) * F.col("quantum")), F.col("at") + F.col("n_tokens"))
    return parts.select(
        "rid", "source", F.col("n_tokens").alias("doc_tokens"), (low - F.col("at")).alias("start"),
        (high - low).alias("length"), F.col("round"),
    ).where("length > 0")


def _shared(totals: DataFrame) -> DataFrame:
    """Adds ``all``, the sum of the weights, to a row per source."""
    return totals.withColumn("__one", F.lit(1)).join(
        totals.agg(F.sum("w").alias("all")).withColumn("__one", F.lit(1)), "__one"
    ).drop("__one")


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    targets: dict[str | None, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    buckets: int = BUCKETS,
    digest: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (binary), doc_tokens,
    sequence_id, offset, round. With ``digest`` the ids' CRC-32 (ids_crc32) is in place of ids."""
    # numbered in the written table: a recomputed partition must not renumber rows
    made = cut(tokens(docs, tokenizer, ranks).withColumn("rid", F.monotonically_increasing_id()))
    sizes = made.select(
        "rid", "source", "n_tokens", F.xxhash64("doc_id").alias("h")
    ).withColumn("bucket", F.shiftrightunsigned("h", 64 - (buckets - 1).bit_length()))
    queued = running_start(sizes, "n_tokens", "at", ["source"], ["bucket"], ["h", "rid"])
    parts = cut(_rounds(queued.select("rid", "source", "n_tokens", "at"), targets, window))
    served = parts.groupBy("round", "source").agg(F.sum("length").alias("served"))
    served = served.withColumn("top", F.floor(F.col("round") / 4096)).withColumn("all", F.floor(F.col("top") / 4096))
    turns = running_start(served, "served", "before", [], ["all", "top", "round"], ["source"])
    turns = turns.select(F.col("round").alias("r"), F.col("source").alias("s"), "before")
    inside = Window.partitionBy("round", "source").orderBy("rid", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.withColumn("within", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .join(turns, (F.col("round") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
        .withColumn("position", F.col("before") + F.col("within"))
    )
    end = F.col("position") + F.col("length")
    cutup = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(F.col("position") / sequence), F.floor((end - 1) / sequence)))
    )
    low = F.greatest(F.col("position"), F.col("sequence_id") * sequence)
    high = F.least(end, (F.col("sequence_id") + 1) * sequence)
    pieces = cutup.select(
        "rid",
        F.struct(
            (F.col("start") + low - F.col("position")).alias("start"),
            (high - low).alias("length"),
            "sequence_id",
            (low - F.col("sequence_id") * sequence).alias("offset"),
            "round",
        ).alias("piece"),
    )
    # the pieces of one document, no more than its tokens
    by_doc = pieces.groupBy("rid").agg(F.collect_list("piece").alias("pieces"))

    shown = ("ids_crc32", "bigint", ids_crc32) if digest else ("ids", "binary", bytes)

    def slices(c: dict) -> dict:
        found = c["pieces"]
        doc = [i for i, pieces in enumerate(found) for _ in pieces]
        out = {"doc_id": [c["doc_id"][i] for i in doc], "source": [c["source"][i] for i in doc]}
        out["doc_tokens"] = [c["n_tokens"][i] for i in doc]
        for name in ("start", "length", "sequence_id", "offset", "round"):
            out[name] = [p[name] for pieces in found for p in pieces]
        spans = zip(doc, out["start"], out["length"])
        out[shown[0]] = [shown[2](c["ids"][i][2 * at : 2 * (at + n)]) for i, at, n in spans]
        return out

    return mapped(
        made.join(by_doc, "rid").select("doc_id", "source", "ids", "n_tokens", "pieces"),
        slices,
        "doc_id bigint, source string, doc_tokens bigint, start bigint, length bigint, "
        f"sequence_id bigint, offset bigint, round bigint, {shown[0]} {shown[1]}",
    )


def ids_crc32(ids: bytes) -> int:
    """CRC-32 of two-byte ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pack_report(docs: DataFrame, tokenizer: str, ranks: str, **how) -> DataFrame:
    """The pieces of :func:`pack` with the ids' CRC-32 in place of the ids."""
    return pack(docs, tokenizer, ranks, digest=True, **how).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
