"""The corpus operators against brute force, round trips and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivetgraph.llm import (
    common,
    divergence_rules,
    language_evidence,
    mixture_packing,
    ngram_join,
    piece_viterbi,
    queries,
    repeated_passages,
    secrets,
    surrogates,
    toxicity,
    vector_graph,
)

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, cid int, rid string"
VOCAB = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "sa", "te", "vo") for b in ("n", "r", "st", "lla", "ndo", "")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def odd_texts():
    base = prose(1, 120)
    changed = base.split()
    changed[60] = "otherword"
    passage = prose(2, 60)
    return [
        None, "", "   ", "one", "one two three", base, base, " ".join(changed),
        prose(3, 80) + " " + passage + " " + prose(4, 30), prose(5, 20) + " " + passage, prose(6, 5000),
        "\n".join(["same line here"] * 4), base.replace(" ", "\t"), "ñandú   日本語 " * 20,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, 0, "k", 1, "r") for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[8], (None, prose(7, 70), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def ids_of(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=str)


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            comp[i] = min([comp[i]] + [comp[j] for j in near[i]])
    least = {}
    for i, c in enumerate(comp):
        d = rows[i][0]
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((rows[i][0], least.get(comp[i]), len(near[i])) for i in range(n)), key=str)


def test_similar_documents_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for block in (400_000, 150):
        got = ngram_join.similar_documents(docs, block_shingles=block).collect()
        assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_near_copies_of_many_edits(spark):
    rng, base, rows = random.Random(9), prose(20, 200).split(), []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ngram_join.similar_documents(df, block_shingles=1500).collect()), key=str)
    assert got == brute_links(rows)


def test_keep_one_keeps_columns_and_one_of_each(docs, empty):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids_of(kept) == sorted([None, 0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 13], key=str)
    assert ngram_join.keep_one(empty).count() == 0 == ngram_join.similar_documents(empty).count()


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.99999)
    assert bands * rows <= 160 and (1 - 0.8**rows) ** bands <= 1e-5


def covered(spans):
    return {i for s in spans.split(",") if s for i in range(*map(int, s.split(":")))}


def brute_repeats(rows, m=50):
    """Words of every window of m words that also occurs in an earlier row or place."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w = (t or "").split()
        for i in range(len(w) - m + 1):
            g = tuple(w[i : i + m])
            if first.setdefault(g, (d, i)) != (d, i):
                out.setdefault(d, set()).update(range(i, i + m))
    return out


def test_repeated_passages_equal_brute_force(spark):
    p, q = prose(30, 75), prose(31, 52)
    rows = [(1, prose(32, 60) + " " + p + " " + prose(33, 40)), (2, p), (3, prose(34, 10) + " " + p + " " + q), (4, q + " " + prose(35, 90))]
    rows += [(10 + i, prose(40 + i, 30) + " " + q + " " + prose(60 + i, 12)) for i in range(12)]
    rows += [(30, prose(36, 55) + " a " + prose(36, 55)), (31, prose(37, 400)), (32, prose(37, 400)), (33, prose(38, 49)), (34, prose(38, 49))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for salt in (20_000, 3):
        got = {r.doc_id: covered(r.spans) for r in repeated_passages.repeat_report(df, salt_rows=salt).collect() if r.spans}
        want = brute_repeats(rows)
        assert set(got) == set(want)
        for d in want:
            # a word more at an end, by chance like that of an occurrence that was no neighbour, may differ
            assert len(want[d] - got[d]) <= 2 and len(got[d] - want[d]) <= 2


@pytest.mark.parametrize("salt", [20_000, 3])
def test_every_repeated_window_of_edited_copies_and_notices(spark, salt):
    rng = random.Random(8)
    base, rows = prose(50, 300).split(), []
    for i in range(20):
        rows.append((i, " ".join(rng.choice(VOCAB) + "x" if rng.random() < 0.03 else w for w in base)))
    # two copies of a passage that ends in a notice, between many that share the notice alone
    notice = prose(51, 30)
    for i in range(30):
        rows.append((100 + i, prose(200 + i, 40) + " " + notice + " " + prose(300 + i, 40)))
    for i in (90, 140, 141):
        rows.append((i, prose(400 + i, 30) + " " + prose(52, 28) + " " + notice + " " + prose(500 + i, 30)))
    df = spark.createDataFrame(rows + rows[5:7], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: covered(r.spans) for r in repeated_passages.repeat_report(df, salt_rows=salt).collect() if r.spans}
    assert got == brute_repeats(rows)


def test_remove_repeats_odd_rows(docs, empty):
    out = repeated_passages.remove_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[5] == odd_texts()[5] and 6 not in texts and texts[9].split() == prose(5, 20).split()
    assert repeated_passages.repeat_report(docs).count() == docs.count()
    assert repeated_passages.remove_repeats(empty).count() == 0 == repeated_passages.repeat_report(empty).count()


def test_divergence_base_measures(docs, empty):
    got = {r.doc_id: r for r in divergence_rules.judge(docs).collect()}
    for i, t in enumerate(odd_texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {j for i2 in range(len(w) - 2) if tri[tuple(w[i2 : i2 + 3])] > 1 for j in range(i2, i2 + 3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[11].n_dup_lines == 3
    assert divergence_rules.judge(empty).count() == 0


def test_divergence_classes_count_characters(spark):
    text = "日本語カナ漢字文書東京 abcdefghijkl 42, ñ𝒳 #\n"
    row = spark.createDataFrame([(1, "ja", text)], "doc_id bigint, lang string, text string")
    got = divergence_rules.measured(row).first()
    wide = sum(ord(c) > 127 for c in text)
    assert got.classes == [text.count(" ") + text.count("\n"), 12, wide, 2, 1, 1] and sum(got.classes) == len(text)


def test_divergence_drops_what_is_unlike_its_language(spark):
    rows = [(i, prose(100 + i, 200), "xx") for i in range(40)] + [(99, " ".join(f"#%{i}$*" for i in range(200)), "xx")]
    got = {r.doc_id: r.kept for r in divergence_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not got.pop(99) and all(got.values())


def packed(docs, **how):
    return mixture_packing.pack(docs, *queries.byte_bpe(), **how).collect()


def test_packing_covers_every_token_once(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.byte_bpe()[0])
    rows = packed(docs, sequence=64, window=256, buckets=4)
    want = collections.Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    have = collections.Counter()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    total = sum(n for (_, ids), n in ((k, v * len(k[1])) for k, v in want.items()))
    assert sum(r.length for r in rows) == total
    for (d, ids), n in want.items():
        seen = np.zeros(len(ids), int)
        for s, x in by_doc[(d, len(ids))]:
            assert x == list(ids[s : s + len(x)])
            seen[s : s + len(x)] += 1
        assert (seen == n).all()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(-(-total // 64)))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packed(empty) == []


def test_packing_holds_the_targets(spark):
    rows = [(i, prose(200 + i, 150), "a" if i % 3 else "b") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packed(df, targets={"a": 1.0, "b": 3.0}, sequence=128, window=1024, buckets=4)
    per = collections.defaultdict(collections.Counter)
    for r in got:
        per[r.round][r.source] += r.length
    both = [per[r] for r in sorted(per) if len(per[r]) == 2][:-1]
    assert both and all(abs(c["b"] - 768) <= 1 and abs(c["a"] - 256) <= 1 for c in both)


def test_rounds_of_a_rare_source(spark):
    rows = [(1, "rare", 2, 0), (2, "rare", 3, 2), (3, "big", 400_000, 0), (4, None, 137, 0)]
    queued = spark.createDataFrame(rows, "rid bigint, source string, n_tokens bigint, at bigint")
    got = mixture_packing._rounds(queued, None, 64)
    per = {}
    for r in got.collect():
        per.setdefault(r.rid, []).append((r.start, r.length, r["round"]))
    for rid, source, n, at in rows:
        total = sum(r[2] for r in rows if r[1] == source)
        quantum = total / sum(r[2] for r in rows) * 64
        want = []
        for i in range(int((at + n) / quantum) + 2):
            low, high = max(int(i * quantum), at), min(int((i + 1) * quantum), at + n)
            if high > low:
                want.append((low - at, high - low, i))
        assert sorted(per[rid]) == want and sum(p[1] for p in want) == n
    assert len(per[1]) == 2 and len(per[2]) == 3


def test_packing_digest(docs):
    r = mixture_packing.pack_report(docs.where("doc_id = 4"), *queries.byte_bpe()).collect()
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(queries.byte_bpe()[0]).encode("one two three", add_special_tokens=False).ids + [1]
    assert [(x.start, x.length, x.ids_crc32) for x in r] == [(0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]


def test_secrets_base_forms(spark, empty):
    text = 'x password: "hunter22!" Token=ab api_key = abcdef AKIA' + "Q" * 16 + " AKIAQ " + "0a" * 12 + " PASSWD=éé"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.secret_report(df).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    spans = [s.split(":") for s in got[1].spans.split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "hex"] == ["0a" * 12]
    base = ",".join(":".join(s) for s in spans if s[0] != "random")
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2].spans == got[3].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_report(empty).count() == 0


def test_secrets_tell_noise_from_words(spark):
    rng = random.Random(5)
    alphabet = secrets.ALPHABETS[7]
    noise = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(20)]
    rows = [(i, f"{prose(300 + i, 150)} {s} {prose(400 + i, 20)}") for i, s in enumerate(noise)]
    rows += [(100 + i, f"{prose(500 + i, 150)} {prose(600 + i, 9).replace(' ', '_')} word/word/other/path/name") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_report(df).collect()}
    assert sum("random" in got[i] for i in range(20)) >= 18
    assert sum("random" in got[100 + i] for i in range(20)) == 0
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert sum(s in clean[i] for i, s in enumerate(noise)) <= 2 and clean[100] == rows[20][1]


def test_ordinary_text_is_every_word_of_every_different_text(spark):
    low, up = prose(70, 700), prose(71, 90).upper()
    texts = [low, up, low + " " + up, "short", "", None, prose(72, 3000).title()]
    want = {}
    for t in set(texts) - {None}:
        letters = "".join(re.findall(r"(?<!\S)[A-Za-z]{1,19}(?!\S)", t))
        while letters:
            for i, n in enumerate(secrets.LENGTH_EDGES):
                if len(letters) >= n:
                    want.setdefault(i, []).append(np.log(secrets.statistic(letters[:n]) + 1e-6))
                letters = letters[n:] if len(letters) >= n else ""
    # thousands of copies of one text weigh as one
    rows = [(i, t) for i, t in enumerate(texts + [up] * 2500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = secrets.fit(df)[0]
    assert set(got) == set(want)
    for i, t in want.items():
        assert got[i] == pytest.approx((np.mean(t), max(np.std(t, ddof=1), 0.05)), rel=1e-6)


def test_kernel_equals_its_definition():
    from itertools import combinations

    def phi(w):
        out = collections.Counter()
        for i, j, k in combinations(range(len(w)), 3):
            out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def k(a, b):
        x, y = phi(a), phi(b)
        return sum(v * y[t] for t, v in x.items())

    marks = toxicity.Landmarks(["idiot", "clown", "banana"])
    for w in ("idiot", "idoit", "clows", "ananas", "xy"):
        got = marks.similarity([w])[0]
        want = [(k(w, u) / max((k(w, w) * k(u, u)) ** 0.5, 1e-12)) ** toxicity.POWER for u in marks.strings]
        assert np.allclose(got, want, atol=1e-5)
    assert marks.similarity(["i*d*i.o-t"])[0][0] > 0.7


def test_toxicity_held_out(spark, empty):
    rng = random.Random(3)
    bad, rows, labels = ["numbskull", "dimwit", "scoundrel"], [], []
    for i in range(400):
        w = prose(700 + i, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, prose(1, 60) + " you are a d i m w i t ok"), (1003, prose(2, 60) + " num*bsk*ull")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(df, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held == [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[1002].predicted == got[1003].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}
    none = lab.where("false")
    assert toxicity.toxicity_report(df, none).where("predicted = 1").count() == 0
    assert toxicity.toxicity_report(empty, lab).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(300, 16))
    for i in range(60):
        x[240 + i] = x[i % 5] + rng.normal(size=16) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[7].tolist()), (301, x[7].tolist()), (301, x[7].tolist())]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_graph.near_vectors(df).collect())
    v = np.array([r[1] for r in rows])
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = v @ v.T >= 0.95
    comp = np.arange(len(v))
    for _ in range(len(v)):
        comp = np.where(near, comp[None, :], len(v)).min(axis=1)
    want = [(r[0], int(near[i].sum()) - 1, rows[comp[i]][0], r[0] == rows[comp[i]][0]) for i, r in enumerate(rows)]
    assert got == sorted(want + [(i, 0, i, True) for i, _ in odd])
    assert vector_graph.near_vectors(df.where("false")).count() == 0


def test_every_link_of_a_search_group_joins():
    angle = np.deg2rad([-15.0, 15.0, 0.0])
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    ids = [1, 2, 3]
    node = {"cid": ids, "size": 1, "shard": 4, "lo": 0, "hi": 0, "block": 0, "home": True, "x": list(x)}
    node |= {"shards": [[4, 6]] * 3, "near": [[c for c in ids if c != i] for i in ids]}
    whole = pd.DataFrame(node)
    got = vector_graph._search(0.95, 8)(whole)
    assert sorted(zip(got["cid"], got["found"], got["root"])) == [(1, 1, 1), (2, 1, 1), (3, 2, 1)]
    # nodes that are only found, never ask, are credited as well
    guests = whole.assign(home=[False, False, True], shards=[[6, 4], [6, 4], [4, 5]])
    got = vector_graph._search(0.95, 8)(guests)
    assert sorted(zip(got["cid"], got["found"], got["root"])) == [(1, 1, 1), (2, 1, 1), (3, 2, 1)]
    # what the other home can find too counts in the smaller shard alone
    for other, want in ((2, []), (6, [(1, 1, 1), (2, 1, 1), (3, 2, 1)])):
        twice = whole.assign(home=[False, False, True], shards=[[other, 4], [other, 4], [4, other]])
        got = vector_graph._search(0.95, 8)(twice)
        assert sorted(zip(got["cid"], got["found"], got["root"])) == want
    # two blocks: one row a class, links of both
    blocks = whole.assign(hi=1, block=[0, 0, 1])
    got = vector_graph._search(0.95, 8)(blocks)
    assert sorted(zip(got["cid"], got["found"], got["root"])) == [(1, 1, 1), (2, 1, 1), (3, 2, 1)]


def test_links_of_many_loose_clusters_count_at_both_ends(spark):
    rng = np.random.RandomState(5)
    centre = np.repeat(rng.normal(size=(150, 32)), 20, axis=0)
    v = centre + rng.normal(size=centre.shape) * 0.22
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = vector_graph.near_vectors(df).toPandas().sort_values("vec_id")
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = v @ v.T >= 0.95
    links = near.sum(axis=1) - 1
    # every link is counted twice, none is made up, and what has no link is alone
    assert got["n_links"].sum() % 2 == 0 and (got["n_links"].to_numpy() <= links).all()
    assert got["n_links"].sum() >= 0.99 * links.sum() and got["audited_recall"].iloc[0] >= 0.95
    size = got.groupby("component_id")["vec_id"].transform("size")
    assert ((got["n_links"] > 0) == (size > 1)).all()


def test_audit_without_links_is_null(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "vec_id bigint, embedding array<double>")
    assert {(r.n_links, r.audited_recall) for r in vector_graph.near_vectors(df).collect()} == {(0, None)}


@pytest.mark.parametrize("block", [1024, 60])
def test_chains_and_loose_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_graph, "BLOCK", block)
    rng = np.random.RandomState(11)
    centre = np.repeat(rng.normal(size=(12, 64)), 20, axis=0)
    loose = centre + rng.normal(size=centre.shape) * 0.235
    turn = np.deg2rad(15.0) * np.arange(12)
    chain = np.zeros((12, 64))
    chain[:, 0], chain[:, 1] = np.cos(turn), np.sin(turn)
    v = np.concatenate([loose, chain])[rng.permutation(252)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = v @ v.T >= 0.95
    assert 0.1 < near[np.ix_(*[np.flatnonzero(near.sum(axis=1) > 1)] * 2)].mean() * 12 < 0.9
    comp = np.arange(len(v))
    for _ in range(len(v)):
        comp = np.where(near, comp[None, :], len(v)).min(axis=1)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()) - 1, comp[i], comp[i] == i) for i in range(len(v))}


def test_viterbi_equals_brute_force(docs):
    p = piece_viterbi.Pieces(queries.tokenizer_file("piece_bpe_32k.model"))
    pieces = {w: (gain, i) for w, (_, gain, i) in p.automaton.items()}

    def score(text):
        best = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max([best[e - 1] + p.unknown] + [best[s] + pieces[text[s:e]][0] for s in range(max(0, e - 20), e) if text[s:e] in pieces])
        return best[-1]

    names = {i: (w, gain) for w, (gain, i) in pieces.items()}
    for text in ["hello world", "a  b", "ñandú nurthend", prose(8, 30), "x\n\ty"]:
        ids = np.frombuffer(p.encode(text), "<i4")
        own = sum(names[i][1] for i in ids.tolist() if i in names)
        left = "▁" + text.replace(" ", "▁")
        unknown = sum(1 for c in left if c not in "".join(names[i][0] for i in ids.tolist() if i in names))
        assert own + unknown * p.unknown == pytest.approx(score(left)) and p.decode(ids) == text
    back = piece_viterbi.decode(piece_viterbi.encode(docs, queries.tokenizer_file("piece_bpe_32k.model")), queries.tokenizer_file("piece_bpe_32k.model"))
    pick = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    assert pick(back) == pick(docs)


def test_packing_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    path, ranks = queries.byte_bpe()
    own = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["", "don't  we'll\n\n x", "日本 <|endoftext|>", " " * 600_000 + "x", "a" + "\n" * 600_000, "9" * 3000, prose(2, 300)]
    texts += ["".join(rng.choice("ab é日ª²\xa0\n\t 0'sß-") for _ in range(60)) for _ in range(300)]
    got = mixture_packing.encoder(path, ranks)(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    # the reader is made once a worker, not once a task
    assert mixture_packing.encoder(path, ranks) is mixture_packing.encoder(path, ranks)


def test_pieces_in_use_are_not_made_again():
    made = []
    table = piece_viterbi.Recent(lambda k: made.append(k) or k * 2, 10)
    for i in range(100):
        assert table["hot"] == "hothot" and table[f"w{i}"] == f"w{i}" * 2
        assert len(table) + len(table.older) <= 10
    assert made.count("hot") == 1 and len(made) == 101
    p = piece_viterbi.Pieces(queries.tokenizer_file("piece_bpe_32k.model"))
    texts = ["hello world", None, "", "  é日\n ", prose(3, 50), "▁x"]
    ids = piece_viterbi._lists([None if t is None else p.encode(t) for t in texts])
    assert p.decode_all(ids) == [*texts[:5], " x"] and p.decode_all(ids.slice(0, 0)) == []


def test_languages_are_told_by_all_evidence(spark):
    langs = {"en": ["the", "and", "with", "house"], "de": ["und", "der", "mit", "haus"]}
    rng = random.Random(1)
    say = lambda l, n: " ".join(rng.choice(langs[l]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(l, 60), l) for i, l in enumerate(["en", "de"] * 30)] + [(99, None, "fr")], "doc_id bigint, text string, lang string")
    rows = [(i, f"http://h{i % 3}.{'de' if i % 2 else 'com'}/x", f"<html lang='{'de' if i % 2 else 'en'}'><p>{say('de' if i % 2 else 'en', 40)}</p>") for i in range(60)]
    rows += [(100, "http://h1.de/q", "<html><p>1 2</p>"), (101, None, None), (102, "http://h2.com/", ""), (103, "http://h2.com/z", f"<html lang=de>{say('en', 60)}")]
    got = {r.page_id: r for r in language_evidence.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), docs).collect()}
    assert len(got) == len(rows) and all(got[i].lang == ("de" if i % 2 else "en") for i in range(60))
    assert got[100].lang == "de" and got[102].lang == "en" and got[101].lang in langs
    assert all(0 < r.p <= 1 for r in got.values())
    none = language_evidence.identify(spark.createDataFrame(rows[:2], "page_id bigint, url string, html string"), docs.where("false"))
    assert [r.lang for r in none.collect()] == [None, None]


def test_surrogates(spark, empty):
    text = (
        "Write anna.meier@firma.de or ANNA.MEIER@firma.de, call +49 (170) 555-1234, card 4539 1488 0343 6467, "
        "from 192.168.7.9. Frau Erika Muster met Mr. John Smith; Mr. John Smith left. SSN 123-45-6789."
    )
    rows = [(1, text), (2, text), (3, None), (4, "plain words only"), (5, "call +49 (170) 555-1235 then")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(df).collect()}
    assert got[1].text == got[2].text and got[3].text is None and got[4].text == rows[3][1]
    for gone in ("anna.meier", "ANNA", "170) 555-1234", "4539", "192.168", "Erika", "Smith", "123-45"):
        assert gone not in got[1].text
    found = {k: s for _, _, k, s in surrogates.detected(got[1].text)}
    assert {"email", "card", "phone", "ip", "name", "ssn"} <= set(found)
    card = re.sub(r"\D", "", found["card"])
    assert surrogates.luhn_digit(card[:-1]) == card[-1] and re.match(r"\d{4} \d{4} \d{4} \d{4}$", found["card"])
    mail = [s for _, _, k, s in surrogates.detected(got[1].text) if k == "email"]
    names = re.findall(r"(?:Frau|Mr\.) (\w+) \w+", got[1].text)
    assert mail[0] == mail[1] and names[1] == names[2] and names[0][-1] == "a" and names[1][-1] == "o"
    assert re.search(r"\+49 \(\d{3}\) \d{3}-\d{4}", got[5].text).group() not in got[1].text
    assert surrogates.replace_entities(empty).count() == 0


def test_digit_permutation_is_one_to_one():
    made = {surrogates.permuted(str(i).zfill(4), b"k", "t") for i in range(10_000)}
    assert len(made) == 10_000


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    rows = [(i, f"from 1.2.{i // 250}.{i % 250} ok") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = surrogates.surrogate
    # a small target space forces collisions
    monkeypatch.setattr(surrogates, "surrogate", lambda k, s, key=b"k", draw=0: "10.0." + ".".join(str(int(x) % 256) for x in (surrogates._hash(key, s, draw) % 200, surrogates._hash(key, draw, s) % 200)) if k == "ip" else real(k, s, key, draw))
    again = surrogates.drawn_again(df)
    assert again is None or again.count() > 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {x: find(x) for x in list(root)}


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(800 + i, 90), "en", f"s{i % 2}", 0) for i in range(40)]
    rows += [(50, rows[0][1], "en", "s0", 0), (51, rows[1][1] + " tail", "en", "s0", 0), (52, prose(900, 60) + " token = abcdef1234", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = read
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == read.columns, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == set(range(40)) | {52} and "abcdef1234" not in kept[52] and kept[3] == rows[3][1]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(kept)
