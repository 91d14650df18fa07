"""Source divergence audit, chat formatting and importance resampling against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from rivetgraph.llm import chat_formatting as chat, importance_resampling as sampling, secrets, source_divergence as audit, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n string, term string, rank int, s bigint, p double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(spark, n=160, seed=3):
    rng = random.Random(seed)
    vocab = [a + b for a in ("ba", "Ke", "lo", "mí", "ñu") for b in ("n", "R", "st", "ß")]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab[: 4 + i % 16]) + rng.choice([" ", ", ", "7", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{rng.randrange(7)}"))
    rows += [(200, None, "en", None), (201, "", None, "s1"), (202, "Ban ban BAN", None, None), (203, "ban " * 3000, "en", "s0"), (204, "日本 語 日本", "ja", "x")]
    rows += [rows[5]] * 3 + [(None, "lost loR", "de", "s1")]
    return spark.createDataFrame([(*r, "a", "b", 1, 2, 3.0) for r in rows], DOCS).repartition(5)


def brute_audit(rows, top=200):
    docs = [((r.text or "").translate(LOWER), r.lang or "", r.source or "") for r in rows]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, source) for t, lang, source in docs]
    out = []
    for lang in {g for _, g, _ in found}:
        here = [(w, s) for w, g, s in found if g == lang]
        df = collections.Counter(t for w, _ in here for t in set(w))
        kept = [t for t in df if df[t] >= 3]
        counts = {s: collections.Counter() for _, s in here}
        for w, s in here:
            counts[s].update(t for t in w if df[t] >= 3)
        whole = sum(counts.values(), collections.Counter())

        def p(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:limit], 1)]
    return sorted(out)


def test_an_audit_block_is_indexed_in_little_memory():
    """The index of a block holds few arrays of the length of its tokens, and lets its texts go."""
    rng = random.Random(1)
    words = ["".join(p) + "x" for p in itertools.product("abcdefgh", repeat=4)]

    def filled(n):
        block = audit.Block()
        while block.held < n:
            block.add("en", f"s{rng.randrange(9)}", " ".join(rng.choices(words, k=300)))
        return block

    list(filled(1000).run(0, 7, 4096))  # what is imported on the way is not counted
    block = filled(1 << 20)
    held = block.held
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in block.run(0, 7, 4096))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and not block.texts and peak < 7 * held


def test_audit_texts_arrive_in_small_batches(spark, monkeypatch, tmp_path):
    """Batches on their way to the index are small, and the session's own setting comes back."""
    seen, before = [], spark.conf.get(audit.BATCH_CONF, None)
    spilled = audit.spilled_runs
    monkeypatch.setattr(audit, "spilled_runs", lambda *a, **k: seen.append(spark.conf.get(audit.BATCH_CONF)) or spilled(*a, **k))
    audit.frequencies(corpus(spark, 20))
    assert seen == [str(audit.BATCH_BYTES)] and spark.conf.get(audit.BATCH_CONF, None) == before


@pytest.mark.parametrize("index", [{}, {"block": 250, "shards": 3, "size": 4, "fan_in": 2}])
@pytest.mark.parametrize("tile", [1024, 2])
def test_audit_equals_brute_force(spark, index, tile):
    docs = corpus(spark)
    got = audit.audit(docs, tile=tile, **index)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs.collect())


def test_audit_of_few_and_no_rows(spark):
    docs = corpus(spark)
    assert audit.audit(docs.limit(0)).count() == 0
    lone = docs.where("doc_id = 204")
    assert audit.audit(lone).count() == 0
    got = sorted(map(tuple, audit.audit(docs.where("doc_id in (200, 203)")).collect()))
    # no term is in three documents: pairs of value 0
    assert got == [("en", "", "pair", "s0", 0, 1), ("en", "s0", "pair", "", 0, 1)]


def test_top_terms_are_cut_by_value_then_item(spark):
    docs = corpus(spark)
    got = sorted(map(tuple, audit.audit(docs, top_terms=2).collect()))
    assert got == brute_audit(docs.collect(), top=2)


def test_heap_merge_of_many_runs():
    rng = random.Random(1)
    runs, want, slices = [], collections.Counter(), []
    for _ in range(9):
        runs.append({f"t{rng.randrange(60)}": {f"s{rng.randrange(4)}": rng.randrange(1, 5) for _ in range(3)} for _ in range(40)})
    for number, run in enumerate(runs):
        out = audit.Slices(number, "en", 7)
        rows = [r for t in sorted(run) if (r := out.add(0, t, 1, list(run[t]), list(run[t].values())))] + [out.flush()]
        assert all(len(r[7]) < 7 + 4 for r in rows)
        slices += [(r[0], 0, *r[2:]) for r in rows]
        for t, held in run.items():
            for s, n in held.items():
                want[t, s] += n
    slices.sort(key=lambda r: r[:4])
    merged = list(audit.heap_merge(iter(slices)))
    assert [e[3] for e in merged] == sorted({t for t, _ in want})
    assert {(e[3], s): n for e in merged for s, n in zip(e[5], e[6])} == want
    assert all(e[4] == sum(e[3] in run for run in runs) for e in merged)


CHATS = "conv_id bigint, turn bigint, role string, text string, turns string, segments int, read int"


def chats(spark):
    control = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]", "[NEXT]"]
    rng = random.Random(4)
    pieces = control + ["\\", "<", "[", "\\\\", "hello", "ü日", "\n", " ", "/s>", "INST]", "$1", ""]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "a[TEXT]b\\", "", None]), text))
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 2, "assistant", "b"), (101, 2, "assistant", "a"), (101, None, "user", "first")]
    rows += [(102, 0, "assistant", "same")] * 3 + [(None, 0, "user", "no id"), (103, 0, "assistant", "x" * 200_000)]
    rows += [(104, i, "user" if i % 5 else "assistant", f"t{i}") for i in range(1500)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CHATS).repartition(4)


def expected_chats(rows):
    convs = collections.defaultdict(list)
    for r in rows:
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for *_, role, t in turns if role == "assistant")
        listed = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_formatted_chats_read_back(spark):
    df = chat.with_probe(chats(spark))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_report(df).collect()}
    assert got == expected_chats(df.collect()) and got[-7][0] == 2


def test_chat_template_and_mask(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "user", "there"), (1, 3, "assistant", "</s>\\"), (1, 4, "tool", "[x]")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_chats(df).first()
    assert row.formatted == "<<SYS>>be brief<</SYS>>[INST]hi[NEXT]there[/INST]<s><\\/s>\\\\</s>[ROLE]tool[TEXT][x][/ROLE]"
    assert [s.text for s in row.segments if s.trained] == ["<\\/s>\\\\"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_no_control_string_is_left_in_texts(spark):
    texts = chats(spark).select(chat.escaped(F.col("text")).alias("t")).where("t is not null")
    assert texts.where(F.col("t").rlike(chat.CONTROL)).count() == 0


def test_buckets_are_crc32():
    rng = random.Random(6)
    features = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 3, 7, 7, 7, 40, 3000]))) for _ in range(300)] + [b""]
    assert sampling.buckets(features, 9973).tolist() == [zlib.crc32(f) % 9973 for f in features]
    assert sampling.buckets([]).tolist() == []


def brute_sample(rows, target, percent, least, m):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % m
    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(map(bucket, words(r.text)))
    for r in target:
        t.update(map(bucket, words(r.text)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + m) / ((s[b] + 1.0) * (T + m))))
    out = []
    for r in rows:
        ws = words(r.text)
        weight = sum(gain(bucket(w)) for w in ws) // len(ws) if ws else 0
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = {id(x): i for i, x in enumerate(long[: percent * len(long) // 100], 1)}
    return sorted(((*x, drawn.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize("percent,least,m", [(10, 20, 10_000), (55, 5, 13)])
def test_resampling_equals_brute_force(spark, percent, least, m):
    docs = corpus(spark)
    target = spark.createDataFrame([(1, "ban ban lor mist"), (2, None), (3, "KEST 日本")], "item_id bigint, text string")
    got = sampling.resample(docs, target, percent=percent, min_words=least, n_buckets=m)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_sample(docs.collect(), target.collect(), percent, least, m)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_resampling_of_empty_tables(spark):
    docs = corpus(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert sampling.resample(docs.limit(0), none).count() == 0
    assert sampling.resample(docs, none).count() == docs.count()


def test_longer_runs_of_words_are_features():
    assert sampling.features_of("A b-C", 2) == [b"a", b"b", b"c", b"a b", b"b c"]
    assert sampling.features_of(None, 3) == []


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "token = abcdef1234 end", "x"), (2, None, "y"), (3, "", "z"), (4, "plain words", None), (4, "plain words", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = secrets.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "[SECRET] end", "x"), *rows[1:]], key=repr
    )
    assert secrets.redact(df.limit(0)).count() == 0


def test_toxic_stage_of_odd_rows(spark):
    """The stage drops what the model rejects, keeps columns, nulls and repeats."""
    rng = random.Random(12)
    clean = lambda: " ".join(rng.choice(["house", "river", "green", "walking", "paper", "window"]) for _ in range(30))
    bad = lambda: clean() + " you stupid worthless idiot " + clean()
    rows = [(i, bad() if i % 3 == 0 else clean(), f"k{i}") for i in range(150)]
    rows += [(200, None, "n"), (201, "", "e"), (202, clean(), "c"), (202, clean(), "c"), (203, bad(), "b"), (None, clean(), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == sorted([i for i in range(150) if i % 3] + [200, 201, 202, 202, None], key=str)
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    # labels of one kind only: nothing is learnt, nothing goes
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()
