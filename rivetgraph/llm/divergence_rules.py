"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms are compared with the reference of the document's ``lang`` by Jensen-Shannon
distance (base 2, 0 to 1): character classes, and the language's most common words with
all other words as one more cell. References are totals over the whole corpus; the common
words are the ``TOP_WORDS`` most frequent of each language (ties: the smaller word).

Only DataFrame functions: text is split once, three-word windows are compared after sorting
their hashes inside the row, no row is exploded in the pass that judges.

Defined cases: a null text has no words; a null lang is a language of its own; texts of fewer
than ``MIN_WORDS`` words, and languages with fewer than ``MIN_LANG_WORDS`` words in all, are
not judged by distance; repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivetgraph.session import cut

BASE_WORDS = 50
TOP_WORDS = 20
MIN_WORDS = 80
MIN_LANG_WORDS = 2000
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.55

SPACES = r"[\x20\x09-\x0D]+"
DIGITS = "0-9"
POINTS = r"""\-.,;:!?'"()"""
SYMBOLS = r"#*$%&|<>@=+/\\_~\^\[\]{}`"
CLASSES = ("space", "letter", "wide", "digit", "point", "symbol")


def words_col(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def letters_in(words: str) -> Column:
    return F.char_length(F.array_join(words, ""))


def _count(text: str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def marks_in(text: str) -> Column:
    """The text's digits, points and symbols: all that the counts by class look at."""
    return F.regexp_replace(text, f"[^{DIGITS}{POINTS}{SYMBOLS}]+", "")


def class_counts(text: str, word_chars: Column, marks: str) -> list[Column]:
    """Characters of each class; ``wide`` are those beyond ASCII, ``letter`` is the rest."""
    size = F.char_length(text)
    space = size - word_chars
    # only texts with a character beyond ASCII have more bytes than characters
    beyond = F.char_length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    wide = F.when(F.octet_length(text) == size, F.lit(0)).otherwise(beyond)
    digit = _count(marks, f"[{DIGITS}]")
    point = _count(marks, f"[{POINTS}]")
    symbol = F.char_length(marks) - digit - point
    return [space, size - space - wide - digit - point - symbol, wide, digit, point, symbol]


def windows(words: str, n_words: str) -> Column:
    """Hashes of the three-word windows by place; none of fewer words."""
    at = F.when(F.col(n_words) >= 3, F.sequence(F.lit(0), F.col(n_words) - 3))
    at = F.coalesce(at, F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)))


def sorted_windows(hashes: str) -> Column:
    """(hash, place) of the windows, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_words(srt: str) -> Column:
    """Words that lie in a three-word window found twice or more in the text: a window is
    repeated if its hash equals a neighbour's; by place, each adds the words not yet in."""
    at = F.filter(
        F.transform(
            srt,
            lambda x, j: F.when((F.get(srt, j - 1)["h"] == x["h"]) | (F.get(srt, j + 1)["h"] == x["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    return F.coalesce(_covered(F.sort_array(at)), F.lit(0))


def _covered(at: Column) -> Column:
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(
        at,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def js_distance(p: str, p_total: str, q: str, q_total: str) -> Column:
    """Jensen-Shannon distance of two histograms (columns of counts and their totals)."""
    side = lambda v, m: F.when(v > 0, v * F.log2(v / m) / 2).otherwise(F.lit(0.0))
    cells = F.zip_with(
        p, q, lambda x, y: F.struct((x / F.col(p_total)).alias("p"), (y / F.col(q_total)).alias("q"))
    )
    both = F.aggregate(
        cells,
        F.lit(0.0),
        lambda s, c: s + side(c["p"], (c["p"] + c["q"]) / 2) + side(c["q"], (c["p"] + c["q"]) / 2),
    )
    return F.sqrt(F.greatest(both, F.lit(0.0)))


def measured(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, the base measures, ``classes`` and, given each language's common
    words, ``hist`` (their counts, then the rest) of every document."""
    text = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", words_col(F.col("text"))).withColumn("n_words", F.size("words"))
    chars = split.withColumns(
        {
            "word_chars": letters_in("words"),
            "windows": windows("words", "n_words"),
            "marks": marks_in("text"),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    # windows are sorted with their places only where one occurs twice
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    lined = chars.withColumn("srt", F.when(again, sorted_windows("windows")))
    hist = []
    if words is not None:
        lined = _with_words(lined, words)
        lined = lined.withColumn("common", F.filter("words", lambda w: F.array_contains("top", w)))
        seen = F.transform("top", lambda w: F.size("common") - F.size(F.array_remove("common", w)))
        hist = [F.concat(seen, F.array((F.col("n_words") - F.size("common")).cast("int"))).alias("hist")]
    return lined.select(
        "doc_id",
        "lang",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        _count("marks", "[#*$%&|<>]").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("srt").isNull(), F.lit(0)).otherwise(repeated_words("srt")).cast("bigint").alias("n_repeat_words"),
        F.array(*class_counts("text", F.col("word_chars"), "marks")).alias("classes"),
        F.char_length("text").alias("n_chars"),
        *hist,
    )


def word_references(docs: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """Per lang: top (its most common words), word_ref (their counts, then the rest) and
    lang_words. One small row per language that has a word."""
    words = docs.select("lang", F.explode(words_col(F.col("text"))).alias("w")).groupBy("lang", "w").count()
    total = words.groupBy("lang").agg(F.sum("count").alias("lang_words"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))
    best = words.withColumn("r", rank).where(F.col("r") <= top_words)
    tops = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "count"))).alias("t"))
    joined = tops.join(total, tops["lang"].eqNullSafe(total["lang"])).select(
        tops["lang"], F.col("t.w").alias("top"), F.col("t.count").alias("n"), "lang_words"
    )
    rest = F.col("lang_words") - F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return joined.select("lang", "top", F.concat("n", F.array(rest)).alias("word_ref"), "lang_words")


def class_references(rows: DataFrame) -> DataFrame:
    """Measured rows → per lang: class_ref, the characters of each class."""
    sums = rows.groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(n) for i, n in enumerate(CLASSES)])
    return sums.select("lang", F.array(*CLASSES).alias("class_ref"))


def _by_lang(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds a language's columns. The references are written tables of one row per language,
    so Spark knows their size and broadcasts them while they are small."""
    r = refs.withColumnRenamed("lang", "ref_lang")
    return rows.join(r, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").drop("ref_lang")


def _with_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    return _by_lang(rows, words.select("lang", "top"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document with the base measures, both distances and the verdict."""
    words = cut(word_references(docs))
    rows = cut(measured(docs, words))
    classes = cut(class_references(rows))
    rows = _by_lang(_by_lang(rows, classes), words)
    total = F.aggregate("class_ref", F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = rows.withColumn("class_total", total)
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = (F.col("n_words") >= MIN_WORDS) & (F.coalesce("lang_words", F.lit(0)) >= MIN_LANG_WORDS)
    char_js = F.when(judged, F.round(js_distance("classes", "n_chars", "class_ref", "class_total"), 4))
    word_js = F.when(judged, F.round(js_distance("hist", "n_words", "word_ref", "lang_words"), 4))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), char_js.alias("char_distance"), word_js.alias("word_distance"),
    )
    far = (F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, text, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
n AS (
  SELECT *, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit,
    length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')) AS point,
    length(regexp_replace(text, '[^#*$%&|<>@=+/\\\\_~^\\[\\]{{}}`]', '', 'g')) AS symbol,
    length(text) AS size, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS wide
  FROM w),
c AS (SELECT *, size - word_chars AS space FROM n),
k AS (SELECT *, [space, size - space - wide - digit - point - symbol, wide, digit, point, symbol] AS classes FROM c),
u AS (SELECT rid, lang, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM k),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup FROM lines
        WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
tri AS (SELECT rid, i, x AS a, lead(x, 1) OVER q AS b, lead(x, 2) OVER q AS c FROM u WINDOW q AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS m FROM tri WHERE c IS NOT NULL) WHERE m > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
lw AS (SELECT lang, x, count(*) AS m FROM u GROUP BY lang, x),
lt AS (SELECT lang, sum(m) AS lang_words FROM lw GROUP BY lang),
lr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m DESC, x) AS r FROM lw),
top AS (SELECT lang, x, m, r FROM lr WHERE r <= {TOP_WORDS}),
ref AS (SELECT lang, r, m::DOUBLE AS m FROM top UNION ALL
        SELECT t.lang, {TOP_WORDS} + 1, any_value(lang_words) - sum(m) FROM top t JOIN lt ON t.lang IS NOT DISTINCT FROM lt.lang GROUP BY t.lang),
own AS (SELECT u.rid, t.r, count(*) AS m FROM u JOIN top t ON u.lang IS NOT DISTINCT FROM t.lang AND u.x = t.x GROUP BY u.rid, t.r),
cells AS (SELECT k.rid, ref.r, ref.m AS q,
            CASE WHEN ref.r <= {TOP_WORDS} THEN coalesce(own.m, 0)
                 ELSE k.n_words - coalesce((SELECT sum(m) FROM own o WHERE o.rid = k.rid), 0) END::DOUBLE AS p
          FROM k JOIN ref ON k.lang IS NOT DISTINCT FROM ref.lang LEFT JOIN own ON own.rid = k.rid AND own.r = ref.r
          WHERE k.n_words >= {MIN_WORDS}),
cc AS (SELECT rid, lang, unnest(classes)::DOUBLE AS p, unnest(range(6)) AS r FROM k),
cref AS (SELECT lang, r, sum(p) AS q FROM cc GROUP BY lang, r),
allc AS (SELECT rid, 'w' AS kind, p, q FROM cells UNION ALL
         SELECT cc.rid, 'c', cc.p, cref.q FROM cc JOIN cref ON cc.r = cref.r AND cc.lang IS NOT DISTINCT FROM cref.lang),
sh AS (SELECT rid, kind, p / sum(p) OVER g AS p, q / sum(q) OVER g AS q FROM allc WINDOW g AS (PARTITION BY rid, kind)),
js AS (SELECT rid, kind, round(sqrt(greatest(sum(
          CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 0)), 4) AS d FROM sh GROUP BY rid, kind),
v AS (SELECT k.doc_id, k.n_words, k.word_chars, k.n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
        coalesce(n_rep, 0) AS n_repeat_words,
        k.n_words < {BASE_WORDS} OR 100 * coalesce(n_rep, 0) > 50 * k.n_words AS base_failed,
        CASE WHEN k.n_words >= {MIN_WORDS} AND lang_words >= {MIN_LANG_WORDS} THEN jc.d END AS char_distance,
        CASE WHEN k.n_words >= {MIN_WORDS} AND lang_words >= {MIN_LANG_WORDS} THEN jw.d END AS word_distance
      FROM k LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lt ON lt.lang IS NOT DISTINCT FROM k.lang
        LEFT JOIN js jc ON jc.rid = k.rid AND jc.kind = 'c' LEFT JOIN js jw ON jw.rid = k.rid AND jw.kind = 'w')
SELECT *, NOT base_failed AND NOT coalesce(char_distance > {MAX_CHAR_DISTANCE} OR word_distance > {MAX_WORD_DISTANCE}, false) AS kept
FROM v
"""
