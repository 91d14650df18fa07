"""Language of web pages: Bayesian fusion of four kinds of evidence.

* Text: naive Bayes over hashed letter trigrams of the visible text, fitted on a bounded
  sample of labelled documents (``TRAIN_DOCS`` of each language, smallest hash first); the
  likelihood is tempered, as trigrams overlap.
* Declared markup language (``<html lang>``) and address suffix: likelihood ratios from how
  often they go with each language over all pages, by grouped aggregation.
* Host prior: soft counts of the first three, smoothed along host → domain → suffix → all.

The posterior is the normalised product. Counts weigh a page by its text posterior, so no
page votes with certainty; a page's own vote is taken out of its host's count.

Defined cases: null or empty html has no text and no declaration, so suffix and host decide;
a null url has no host of its own and falls back to the overall prior; repeated rows each get
a row; without any labelled document the result has null languages.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph.llm.common import mapped

TRAIN_DOCS = 1000
CELLS = 1 << 15
TEMPER = 0.1
STRENGTH = 5.0  # pseudo-counts that a level of the host hierarchy takes from the one above
MAX_LANGUAGES = 64

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible(page: str | None) -> str:
    return entities.unescape(_HIDDEN.sub(" ", page)) if page else ""


def trigram_cells(text: str) -> np.ndarray:
    """Cells of the text's letter trigrams; runs of other characters count as one space."""
    low = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    c = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) ^ (
        c[1:-1] << np.uint64(7)
    )
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    return h.astype(np.int64) % CELLS


def trained(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each cell [CELLS, languages]."""
    known = docs.where("lang is not null and lang <> '' and text is not null").select("doc_id", "lang")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    langs = sorted(r.lang for r in most)
    if not langs:
        return [], np.zeros((CELLS, 0))
    picked = None
    for lang in langs:
        some = known.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        picked = some if picked is None else picked.unionByName(some)
    # at most MAX_LANGUAGES * train_docs rows
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text")

    def counted(c: dict) -> dict:
        out: dict = {"lang": [], "cell": [], "n": []}
        for lang, text in zip(c["lang"], c["text"]):
            cell, n = np.unique(trigram_cells(text), return_counts=True)
            out["lang"] += [lang] * len(cell)
            out["cell"] += cell.tolist()
            out["n"] += n.tolist()
        return out

    rows = mapped(texts, counted, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = np.full((CELLS, len(langs)), 0.2)
    for r in rows.toPandas().itertuples():  # at most CELLS rows per language
        table[r.cell, langs.index(r.lang)] += r.n
    return langs, np.log(table / table.sum(axis=0))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, declared, host, domain, suffix, and ``text_log`` (tempered log-likelihoods)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    base = pages.select(
        "page_id", "html",
        F.nullif(F.coalesce(declared, F.lit("")), F.lit("")).alias("declared"),
        F.nullif(F.coalesce(host, F.lit("")), F.lit("")).alias("host"),
    )
    base = base.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)).withColumn(
        "domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    )
    wide = table.astype(np.float32)

    def read(c: dict) -> dict:
        logs = []
        for page in c["html"]:
            cells = trigram_cells(visible(page))
            x = wide[cells].sum(axis=0, dtype=np.float64) * TEMPER if len(cells) else np.zeros(len(langs))
            logs.append((x - x.max()).tolist())
        return {n: c[n] for n in ("page_id", "declared", "host", "domain", "suffix")} | {"text_log": logs}

    schema = "page_id bigint, declared string, host string, domain string, suffix string, text_log array<double>"
    return mapped(base.select("page_id", "declared", "host", "domain", "suffix", "html"), read, schema)


def _softmaxed(logs: Column) -> Column:
    """A posterior from log weights."""
    e = F.transform(logs, lambda x: F.exp(x))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], votes: str, k: int, out: str) -> DataFrame:
    """Votes (arrays of ``k``) summed by key, combined before the shuffle."""
    cols = [F.sum(F.col(votes)[i]).alias(f"v{i}") for i in range(k)]
    return rows.groupBy(*keys).agg(*cols).select(*keys, F.array(*[f"v{i}" for i in range(k)]).alias(out))


def identify(pages: DataFrame, docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """One row per page: page_id, lang, p (its posterior), text_lang, declared, host."""
    langs, table = trained(docs)
    k = len(langs)
    if not k:
        none = F.lit(None)
        return pages.select(
            "page_id", none.cast("string").alias("lang"), none.cast("double").alias("p"),
            none.cast("string").alias("text_lang"), none.cast("string").alias("declared"), none.cast("string").alias("host"),
        )
    from rivetgraph.session import cut

    rows = cut(evidence(pages, langs, table).withColumn("rid", F.monotonically_increasing_id()))
    soft = F.array(*[F.col("e")[i] / F.expr("aggregate(e, 0D, (s, x) -> s + x)") for i in range(k)])
    rows = rows.withColumn("e", F.transform("text_log", lambda x: F.exp(x))).withColumn("vote", soft).drop("e")

    total = _sums(rows, [], "vote", k, "t").select(F.transform("t", lambda x: (x + 1.0)).alias("t")).first()
    everywhere = np.array(total.t if total and total.t else [1.0] * k)
    prior = (everywhere / everywhere.sum()).tolist()
    flat = F.array(*[F.lit(float(p)) for p in prior])

    def smoothed(counts: str, above: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, above, lambda x, a: (x + strength * a) / (n + strength))

    def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return left.join(right.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left").drop("__k")

    # suffix → domain → host, a row per key
    s = _sums(rows.where("suffix is not null"), ["suffix"], "vote", k, "n")
    s = s.select("suffix", smoothed("n", flat).alias("suffix_prior"))
    d = _sums(rows.where("domain <> ''"), ["domain", "suffix"], "vote", k, "n")
    d = joined(d, s, "suffix").select("domain", smoothed("n", F.col("suffix_prior")).alias("domain_prior"))
    h = _sums(rows.where("host is not null"), ["host", "domain", "suffix"], "vote", k, "host_n")
    h = joined(joined(h, d, "domain"), s, "suffix")
    h = h.select("host", "host_n", F.coalesce("domain_prior", "suffix_prior").alias("above"), "suffix_prior")
    # what a declaration says: P(declared | language), from all pages
    c = _sums(rows.where("declared is not null"), ["declared"], "vote", k, "n")
    spread = [F.lit(float(x)) for x in everywhere]
    c = c.select(
        "declared",
        F.array(*[(F.col("n")[i] + 0.5) / (spread[i] + 0.5 * 20) for i in range(k)]).alias("declared_like"),
    )
    full = joined(joined(rows, h, "host"), c, "declared")
    rest = F.zip_with("host_n", "vote", lambda n, v: F.greatest(n - v, F.lit(0.0)))  # without the page itself
    host_prior = F.coalesce(smoothed("rest", F.col("above")), flat)
    full = full.withColumn("rest", rest)
    logs = F.array(
        *[
            F.col("text_log")[i]
            + F.log(F.coalesce(F.col("declared_like")[i], F.lit(1.0)))
            + F.log(F.coalesce(F.col("hp")[i], F.lit(prior[i])))
            for i in range(k)
        ]
    )
    full = full.withColumn("hp", host_prior).withColumn("w", logs).withColumn("top", F.array_max("w"))
    full = full.withColumn("post", F.transform("w", lambda x: F.exp(x - F.col("top"))))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("w", F.array_max("w")).cast("int")
    sure = F.element_at("post", best) / F.aggregate("post", F.lit(0.0), lambda a, x: a + x)
    spoken = F.element_at(names, F.array_position("text_log", F.array_max("text_log")).cast("int"))
    return full.select(
        "page_id", F.element_at(names, best).alias("lang"), F.round(sure, 6).alias("p"),
        spoken.alias("text_lang"), "declared", "host",
    )
