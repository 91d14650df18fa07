"""Source divergence audit: how a source's words differ from other sources of its language.

Frequencies by single-pass in-memory indexing:

1. a task holds a block of texts until ``BLOCK_BYTES`` are full, makes postings (language,
   source, term) → occurrences and document counts of (language, term) of it, and spills them
   as a term-sorted run, cut by the term's hash into shards and there into slices of about
   ``SLICE`` postings;
2. the slices of a shard reach one task ordered by their first term and are merged through a
   heap that holds one open slice of each run; a term's postings are summed on the way out.
   At most ``FAN_IN`` runs meet in one merge: more runs take more levels, so memory depends on
   neither the corpus nor the number of runs.

A hot source or word is one posting a block, whatever its share of the rows.

Kept terms of a language are those in ``MIN_DOCS`` of its documents or more. With N the
occurrences of kept terms in a group and V their number, p = 1 + floor(10^9 (n + 1) / (N + V))
of every kept term, absent ones included, and the divergence of p from q sums
f = floor((p − q)² / q), all in integers.

Pairs of sources are not compared term by term: a term absent from both adds the same for
every such term, a term of one source alone adds by its count there (summed over the source's
distinct counts), and only terms of both need a correction, which is streamed: sorted
postings of one term after the other update a matrix of at most ``TILE`` × ``TILE`` sources;
languages of more sources are cut into pairs of tiles, every posting goes to those of its own.

Defined cases: null text, lang and source are ''; groups without terms take part with N = 0;
a language without kept terms has pairs of value 0 and no terms; one source alone has no
pairs; equal values are ordered by item; repeated rows count each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import collections
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rivetgraph.llm.common import sliced
from rivetgraph.operators.blocks import top_per_key
from rivetgraph.session import cut, settings

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 2 << 20
SLICE = 4096
SHARDS = 256
FAN_IN = 256
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
TILE = 1024

# bytes of letters and above ASCII are kept, capitals lowered, all others part terms
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RUN = (
    "shard int, run bigint, lang string, first string, terms array<string>, docs array<bigint>, "
    "sizes array<int>, sources array<string>, n array<bigint>"
)
_LIST = {"terms": pa.string(), "docs": pa.int64(), "sizes": pa.int32(), "sources": pa.string(), "n": pa.int64()}
_RUN = pa.schema(
    [("shard", pa.int32()), ("run", pa.int64()), ("lang", pa.string()), ("first", pa.string())]
    + [(c, pa.list_(t)) for c, t in _LIST.items()]
)
POSTINGS = "lang string, term string, docs bigint, lang_n bigint, lead boolean, source string, n bigint"
_POSTINGS = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("lang_n", pa.int64())]
    + [("lead", pa.bool_()), ("source", pa.string()), ("n", pa.int64())]
)


def _first(keys: np.ndarray) -> np.ndarray:
    """Sorts ``keys`` in place; true at the first of each."""
    keys.sort()
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def _counts(first: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(first), append=len(first))


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts' terms, the terms' lengths, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    letter = joined != 32
    edge = np.diff(letter, prepend=False)
    begin, end = np.flatnonzero(edge & letter), np.flatnonzero(edge & ~letter)
    counts = np.diff(np.searchsorted(begin, np.cumsum(lengths + 1)), prepend=0)
    return joined[letter], (end - begin).astype(np.int32), counts


class Block:
    """Texts held until memory is full, then indexed at once: occurrences per (language,
    source, term) and documents per (language, term)."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.groups: list[tuple[str, str]] = []
        self.held = 0

    def add(self, lang: str, source: str, text: str) -> None:
        self.texts.append(text.encode().translate(_KEPT))
        self.groups.append((lang, source))
        self.held += len(self.texts[-1])

    def run(self, number: int, shards: int, size: int) -> Iterator[pa.RecordBatch]:
        """The postings as slices of a run, in order of (language, shard, term, source).

        It empties the block, and few arrays as long as its tokens live at a time.
        """
        parts, some = [], 1 + len(self.texts) // 32
        while self.texts:
            parts.append(_terms(self.texts[:some]))
            del self.texts[:some]
        self.held = 0
        if not sum(len(sizes) for _, sizes, _ in parts):
            return
        packed, sizes, counts = (np.concatenate(x) for x in zip(*parts))
        del parts
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        # the terms one after the other, as a string array over the same bytes
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        del sizes
        tokens = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
        ).dictionary_encode()
        codes, terms = tokens.indices.to_numpy(), tokens.dictionary
        del offsets, packed, tokens
        shard = np.fromiter((zlib.crc32(t) % shards for t in terms.to_pylist()), np.int64, len(terms))
        by_term = pc.sort_indices(terms).to_numpy()
        by_shard = by_term[np.argsort(shard[by_term], kind="stable")]
        place = np.empty(len(terms), np.int64)
        place[by_shard] = np.arange(len(terms))
        langs, sources = (sorted(set(names)) for names in zip(*self.groups))
        lang_at, source_at = ({x: i for i, x in enumerate(names)} for names in (langs, sources))
        lang = np.array([lang_at[g] for g, _ in self.groups])
        source = np.array([source_at[x] for _, x in self.groups])

        seen = place[codes]
        seen += (np.arange(len(counts)) * len(terms))[doc]
        seen = seen[_first(seen)]
        in_lang = lang[seen // len(terms)]
        in_lang *= len(terms)
        seen %= len(terms)
        in_lang += seen
        del seen
        docs = _counts(_first(in_lang))
        del in_lang
        posting = (place * len(sources))[codes]
        posting += (lang * len(terms) * len(sources) + source)[doc]
        del doc, codes
        first = _first(posting)
        posting, n = posting[first], _counts(first)
        entry = posting // len(sources)
        starts = np.flatnonzero(np.diff(entry, prepend=-1))

        # slices: a new one where language or shard changes, or ``size`` postings are full
        entry = entry[starts]
        scope = entry // len(terms) * shards + shard[by_shard][entry % len(terms)]
        opens = np.flatnonzero(np.diff(scope, prepend=-1))
        since = starts - np.repeat(starts[opens], np.diff(np.append(opens, len(starts))))
        cuts = np.flatnonzero((np.diff(scope, prepend=-1) != 0) | (np.diff(since // size, prepend=-1) != 0))
        at_term = pa.array(np.append(cuts, len(starts)).astype(np.int32))
        at_posting = pa.array(np.append(starts, len(posting))[np.append(cuts, len(starts))].astype(np.int32))
        names = terms.take(pa.array(by_shard[entry % len(terms)])).cast(pa.large_string()).cast(pa.string())
        lists = [
            (at_term, names),
            (at_term, pa.array(docs)),
            (at_term, pa.array(np.diff(np.append(starts, len(posting))).astype(np.int32))),
            (at_posting, pa.array(sources, pa.string()).take(pa.array(posting % len(sources)))),
            (at_posting, pa.array(n)),
        ]
        whole = pa.RecordBatch.from_arrays(
            [
                pa.array((scope[cuts] % shards).astype(np.int32)),
                pa.array(np.full(len(cuts), number, np.int64)),
                pa.array(langs, pa.string()).take(pa.array(scope[cuts] // shards)),
                names.take(pa.array(cuts)),
                *(pa.ListArray.from_arrays(at, values) for at, values in lists),
            ],
            schema=_RUN,
        )
        for i in range(0, len(cuts), 64):
            yield whole.slice(i, 64)


class Slices:
    """Gathers entries of one run and language into rows of about ``size`` postings."""

    def __init__(self, number: int, lang: str, size: int) -> None:
        self.number, self.lang, self.size, self.shard = number, lang, size, -1
        self.columns: tuple[list, ...] = ([], [], [], [], [])

    def add(self, shard: int, term: str, docs: int, sources: list, n: list) -> tuple | None:
        """A full row, if this entry begins the next one."""
        full = self.flush() if shard != self.shard or len(self.columns[3]) >= self.size else None
        self.shard = shard
        terms, all_docs, sizes, all_sources, all_n = self.columns
        terms.append(term)
        all_docs.append(docs)
        sizes.append(len(sources))
        all_sources.extend(sources)
        all_n.extend(n)
        return full

    def flush(self) -> tuple | None:
        if not self.columns[0]:
            return None
        full = (self.shard, self.number, self.lang, self.columns[0][0], *self.columns)
        self.columns = ([], [], [], [], [])
        return full


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    for some in iter(lambda: list(itertools.islice(rows, size)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def spilled_runs(docs: DataFrame, *, block: int, shards: int, size: int) -> DataFrame:
    """One run for every block of postings that a task fills."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, spilled, held = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for piece in sliced(batch, BATCH_BYTES):
                for text, lang, source in zip(*(piece.column(c).to_pylist() for c in ("text", "lang", "source"))):
                    held.add(lang, source, text)
                    if held.held >= block:
                        yield from held.run(first + spilled, shards, size)
                        held, spilled = Block(), spilled + 1
        yield from held.run(first + spilled, shards, size)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("text"), text("lang"), text("source")).mapInArrow(build, RUN)


def heap_merge(slices: Iterator[tuple]) -> Iterator[tuple]:
    """Slices of sorted runs, ordered by (shard, run group, language, first term), into
    entries (shard, group, lang, term, docs, sources, n) in that order, one for each term.

    Slices of one run do not overlap and do not part a term, so the heap holds one slice of
    each run at the most.
    """
    heap: list = []
    scope: tuple | None = None
    entered = itertools.count()

    def entries(limit: str | None) -> Iterator[tuple]:
        """Of terms before ``limit``, where the next slice begins; all of them if None."""
        while heap and (limit is None or heap[0][0] < limit):
            term, docs, parts = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, place, row, i, at = heap[0]
                end = at + row[6][i]
                docs += row[5][i]
                parts.append((row[7][at:end], row[8][at:end]))
                i += 1
                if i < len(row[4]):
                    heapq.heapreplace(heap, (row[4][i], place, row, i, end))
                else:
                    heapq.heappop(heap)
            sources, n = parts[0]
            if len(parts) > 1:
                total: dict[str, int] = dict(zip(sources, n))
                for more, k in parts[1:]:
                    for s, x in zip(more, k):
                        total[s] = total.get(s, 0) + x
                sources = sorted(total)
                n = [total[s] for s in sources]
            yield (*scope, term, docs, sources, n)

    for row in slices:
        if row[:3] != scope:
            yield from entries(None)
            scope = row[:3]
        yield from entries(row[3])
        heapq.heappush(heap, (row[3], next(entered), row, 0, 0))
    yield from entries(None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a run. A list column is turned into objects once, then cut by its offsets."""
    def objects(c: pa.Array) -> list:
        if not pa.types.is_string(c.type):
            return c.to_numpy().tolist()
        coded = c.dictionary_encode()
        return np.array(coded.dictionary.to_pylist(), object)[coded.indices.to_numpy()].tolist()

    for batch in batches:
        for piece in sliced(batch):
            plain = [objects(c) for c in piece.columns[:4]]
            lists = [
                (objects(c.flatten()), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist()) for c in piece.columns[4:]
            ]
            for k, row in enumerate(zip(*plain)):
                yield (*row, *(values[at[k] : at[k + 1]] for values, at in lists))


def frequencies(
    docs: DataFrame,
    *,
    min_docs: int = 1,
    block: int = BLOCK_BYTES,
    shards: int = SHARDS,
    size: int = SLICE,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(lang, term, docs, lang_n, lead, source, n) of every term in ``min_docs`` documents of
    its language: its documents and occurrences there, and its occurrences in each source;
    ``lead`` marks one row of each term."""

    def to_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            out = None
            for shard, group, lang, *entry in heap_merge(_rows(batches)):
                full = None
                if out is None or (group, lang) != (out.number, out.lang):
                    full = out and out.flush()
                    out = Slices(group, lang, size)
                full = out.add(shard, *entry) or full
                if full:
                    yield full
            if full := out and out.flush():
                yield full

        yield from _batches(rows(), _RUN, 64)

    def to_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (e[2:] for e in heap_merge(_rows(batches)) if e[4] >= min_docs)
        for some in iter(lambda: list(itertools.islice(entries, 5000)), []):
            lang, term, count, sources, n = zip(*some)
            sizes = np.fromiter(map(len, sources), np.int64, len(sources))
            at = pa.array(np.repeat(np.arange(len(some)), sizes))
            lead = np.zeros(sizes.sum(), bool)
            lead[np.cumsum(sizes) - sizes] = True
            lang_n = pa.array([sum(k) for k in n], pa.int64())
            parts = [pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(count, pa.int64()), lang_n]
            yield pa.RecordBatch.from_arrays(
                [c.take(at) for c in parts]
                + [pa.array(lead), pa.array(list(itertools.chain(*sources)), pa.string())]
                + [pa.array(list(itertools.chain(*n)), pa.int64())],
                schema=_POSTINGS,
            )

    # a task holds one block; the texts on their way to it come in batches that are small beside it
    with settings(docs.sparkSession, **{BATCH_CONF: str(BATCH_BYTES)}):
        runs = cut(spilled_runs(docs, block=block, shards=shards, size=size))
    waiting = runs.agg(F.count_distinct("run")).first()[0]
    while True:
        groups = -(-waiting // fan_in)
        group = (F.pmod(F.xxhash64("run"), F.lit(groups)) if groups > 1 else F.lit(0)).cast("bigint")
        ordered = (
            runs.withColumn("run", group)
            .repartition("shard", "run")
            .sortWithinPartitions("shard", "run", "lang", "first")
        )
        if groups <= 1:
            return cut(ordered.mapInArrow(to_postings, POSTINGS))
        runs, waiting = cut(ordered.mapInArrow(to_run, RUN)), groups


def corrections(postings: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value): Σ over the terms of both sources a and b of what their meeting
    changes. ``postings``: lang, term, s (number of the source), p, p0 (p of an absent term)
    and tiles (how many tiles of sources the language has)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, matrix = None, np.zeros((tile, tile), np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            if scope is not None:
                a, b = np.nonzero(matrix)
                lang, i, j = scope
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a), pa.string()), pa.array(a + i * tile), pa.array(b + j * tile), pa.array(matrix[a, b])],
                    names=["lang", "a", "b", "value"],
                )
                matrix[:] = 0

        def meet(table: pa.Table, starts: np.ndarray, ends: np.ndarray, i: int, j: int) -> None:
            """Terms with equal numbers of sources in both tiles are done together."""
            s, p, p0 = (table.column(c).to_numpy() for c in ("s", "p", "p0"))
            low = np.concatenate([[0], np.cumsum(s // tile == min(i, j))])
            in_low = low[ends] - low[starts]
            in_high = ends - starts if i == j else ends - starts - in_low
            shape = in_low * (2 * tile + 1) + in_high
            for key in np.unique(shape):
                of = starts[shape == key]
                k, m = divmod(int(key), 2 * tile + 1)
                if not k or not m:
                    continue
                # sources ascend inside a term, so those of the lower tile come first
                first, second = np.arange(k), np.arange(m) + (0 if i == j else k)
                if i > j:
                    first, second = second, first
                for some in np.array_split(of, 1 + len(of) * k * m // 1_000_000):
                    ra, rb = some[:, None] + first, some[:, None] + second
                    qa, qa0, qb, qb0 = p[ra][:, :, None], p0[ra][:, :, None], p[rb][:, None, :], p0[rb][:, None, :]
                    gain = f(qa, qb) - f(qa, qb0) - f(qa0, qb) + f(qa0, qb0)
                    at = (s[ra] - i * tile)[:, :, None] * tile + (s[rb] - j * tile)[:, None, :]
                    np.add.at(matrix.reshape(-1), at.ravel(), gain.ravel())

        carried: pa.Table | None = None
        for batch in itertools.chain((b for b in batches if b.num_rows), [None]):
            parts = [t for t in (carried, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not parts:
                break
            table = pa.concat_tables(parts).combine_chunks()
            heads = [table.column(c).combine_chunks() for c in ("lang", "i", "j", "term")]
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for c in heads:
                change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], table.num_rows)
            if batch is not None:
                # the last term may go on in the next batch
                carried = table.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            scopes = list(zip(*(c.take(pa.array(starts)).to_pylist() for c in heads[:3])))
            at = 0
            while at < len(starts):
                end = bisect.bisect_right(scopes, scopes[at], at)
                if scopes[at] != scope:
                    yield from emit()
                    scope = scopes[at]
                meet(table, starts[at:end], ends[at:end], scope[1], scope[2])
                at = end
        yield from emit()

    own = F.floor(F.col("s") / tile)
    others = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)
    pairs = F.array_distinct(
        F.concat(
            F.transform(others, lambda t: F.struct(own.alias("i"), t.alias("j"))),
            F.transform(others, lambda t: F.struct(t.alias("i"), own.alias("j"))),
        )
    )
    placed = postings.select("lang", "term", "s", "p", "p0", F.inline(pairs))
    spread = placed.repartition("lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term", "s")
    parts = spread.mapInArrow(streamed, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _p(n: str, total: str, v: str) -> Column:
    """p of a term with ``n`` occurrences among ``total`` in a group of ``v`` kept terms."""
    return F.expr(f"cast(1 + ({SCALE}bd * ({n} + 1)) div ({total} + {v}) as bigint)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE, **index: int
) -> DataFrame:
    """lang, source, part, item, value and rank: per source its divergence from every other
    source of its language (part ``pair``) and the terms it has more of than its language
    (part ``term``, the first ``top_terms``)."""
    counts = frequencies(docs, min_docs=min_docs, **index)
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_total"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = cut(
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "v", "lang_total"])
        # sources of one language: as many as its pairs per source
        .withColumn("s", (F.row_number().over(by_name) - 1).cast("bigint"))
        .withColumn("tiles", F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / tile) + 1)
        .withColumn("p0", F.when(F.col("v") > 0, _p("0L", "total", "v")))
    )
    seen = counts.join(groups, ["lang", "source"])
    seen = seen.withColumn("p", _p("n", "total", "v")).withColumn("q", _p("lang_n", "lang_total", "v"))

    terms = seen.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    terms = top_per_key(terms, ["lang", "source"], [F.col("value").desc(), F.col("item")], top_terms, "rank")

    a = groups.select("lang", F.col("s").alias("a"), "source", F.col("p0").alias("pa0"), "v")
    b = groups.select("lang", F.col("s").alias("b"), F.col("source").alias("item"), F.col("p0").alias("pb0"))
    pairs = a.join(b, "lang").where("a <> b")
    # how often each count occurs in a source: as many rows as it has different counts
    spread = cut(seen.groupBy("lang", "s", "p", "p0").agg(F.count(F.lit(1)).alias("m")))
    one = pairs.join(spread.withColumnRenamed("s", "a").drop("p0"), ["lang", "a"]).select(
        "lang", "a", "b", (F.col("m") * (_f("p", "pb0") - _f("pa0", "pb0"))).alias("value")
    )
    other = pairs.join(spread.withColumnRenamed("s", "b").drop("p0"), ["lang", "b"]).select(
        "lang", "a", "b", (F.col("m") * (_f("pa0", "p") - _f("pa0", "pb0"))).alias("value")
    )
    alone = one.unionByName(other).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    met = corrections(seen.select("lang", "term", "s", "p", "p0", "tiles"), tile)
    changes = alone.unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("change"))
    valued = pairs.join(changes, ["lang", "a", "b"], "left").select(
        "lang", "source", "item",
        (F.coalesce(F.col("v") * _f("pa0", "pb0"), F.lit(0)) + F.coalesce("change", F.lit(0))).cast("bigint").alias("value"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = valued.withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns)
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
freq AS (SELECT lang, source, term, count(DISTINCT id) AS docs, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM freq GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM kept GROUP BY ALL),
groups AS (SELECT g.lang, g.source, CAST(coalesce(t.total, 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) g
           LEFT JOIN (SELECT lang, source, sum(n) AS total FROM freq JOIN kept USING (lang, term) GROUP BY ALL) t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(f.n, 0) AS HUGEINT) + 1)) // (g.total + l.v) AS p,
             1 + (1000000000 * (k.lang_n + 1)) // (l.lang_total + l.v) AS q
      FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN freq f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 200"""
