"""Scalar rules against hand-made rows."""

import gzip

import pytest
from pyspark.sql import functions as F

from rivetgraph.functions import checks, logtext, outcomes, paths, times
from tests.conftest import rows_of

BUILT = "error: builder for '/nix/store/x.drv' failed with exit code 1"
CANNOT = "error: Cannot build '/nix/store/x.drv'. Reason: builder failed due to signal {}"


@pytest.mark.parametrize(
    "stderr, code, want",
    [
        ("No space left on device", 1, "disk_full"),
        ("disk quota exceeded", None, "disk_full"),
        ("g++: out of memory", 1, "disk_full"),
        ("Input/output error", 1, "disk_full"),
        ("task killed by memory cgroup, oom_score 3", 9, "disk_full"),
        (BUILT, 1, "build_failure"),
        (BUILT, None, "build_failure"),
        (BUILT, 137, "transient"),
        (BUILT, 143, "transient"),
        (BUILT, 124, "transient"),
        (CANNOT.format("9 (Killed)"), None, "transient"),
        (CANNOT.format("9 (Killed)") + " out of memory", None, "disk_full"),
        (CANNOT.format("6 (Aborted)"), None, "build_failure"),
        (CANNOT.format("15"), 1, "transient"),
        ("hash mismatch in fixed-output derivation 'x'", 1, "build_failure"),
        ("output path 'x' is bad", 1, "transient"),
        ("output path 'x' is not allowed to refer to 'y'", 1, "build_failure"),
        ("nix-daemon failed with exit code 3", 3, "transient"),
        ("", 1, "transient"),
        (None, None, "transient"),
    ],
)
def test_classifier(make, stderr, code, want):
    df = make([(stderr, code)], "s string, c int")
    assert df.select(outcomes.classify_failure(F.col("s"), F.col("c"))).first()[0] == want


def test_paths(make):
    df = make(
        [("/nix/store/abc-hello-1.0.drv",), ("/nix/store/nohyphen.drv",), ("nodrv",), ("bare.drv",), ("x-y.drv.drv",), ("",)],
        "p string",
    )
    p = F.col("p")
    got = df.select("p", paths.drv_hash_from_path(p), paths.placeholder_name(p), paths.output_path(p)).collect()
    assert [tuple(r) for r in got] == [
        ("/nix/store/abc-hello-1.0.drv", "abc-hello-1.0.drv", "hello-1.0", "/nix/store/abc-hello-1.0"),
        ("/nix/store/nohyphen.drv", None, "nohyphen", "/nix/store/nohyphen"),
        ("nodrv", None, "nodrv", "nodrv"),
        ("bare.drv", None, "bare", "bare"),
        ("x-y.drv.drv", "x-y.drv.drv", "y", "x-y"),
        ("", None, "", ""),
    ]


def test_comma_list_and_filenames(make):
    df = make([(" a, b ,,c,",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(paths.comma_list(F.col("s"))).collect()] == [["a", "b", "c"], [], []]
    names = make([("..",), (".",), ("",), ("../../etc/passwd",), ('a:b*c?d"e<f>g|h\\i\x00',), ("gcc-13.2",)], "s string")
    got = [r[0] for r in names.select(paths.sanitize_filename(F.col("s"))).collect()]
    assert got == ["_", "_", "_", ".._.._etc_passwd", "a_b_c_d_e_f_g_h_i_", "gcc-13.2"]


def test_ingest_limits_are_bytes_and_ordered(make):
    ok = ("/nix/store/a-b.drv", "n", "x86", 1, 1, None)
    cases = {
        None: [ok, ("p-" + "a" * 4090 + ".drv", "n", "x", 0, 0, None), ("a-b.drv", "é" * 512, "x", 4096, 32, "é" * 256)],
        "empty_field": [("", "n", "x", 0, 0, None), ("a-b.drv", "", "x", 9999, 0, None), ("a-b.drv", "n", "", 0, 0, None)],
        "too_long": [("p-" + "a" * 4091 + ".drv", "n", "x", 0, 0, None), ("a-b.drv", "é" * 513, "x", 0, 0, None)],
        "too_many_inputs": [("nodrv", "n", "x", 4097, 33, None)],
        "too_many_features": [("nodrv", "n", "x", 4096, 33, "é" * 300)],
        "attr_too_long": [("nodrv", "n", "x", 0, 0, "é" * 257)],
        "bad_hash": [("/nix/store/nohyphen.drv", "n", "x", 0, 0, None), ("nodrv", "n", "x", 0, 0, None)],
    }
    for want, rows in cases.items():
        df = make(rows, "p string, n string, s string, i int, f int, a string")
        reason = checks.ingest_reject_reason(*[F.col(c) for c in "pnsifa"])
        assert {r[0] for r in df.select(reason).collect()} == {want}


def test_log_tail_cuts_forward_to_a_character(make):
    texts = ["plain" * 10, "é" * 30, "x" + "é" * 30, "日" * 20, "a日" * 12, "😀" * 9, "b😀" * 9, "short"]
    for n in (1, 2, 3, 4, 5, 7, 10, 16):
        got = make([(t,) for t in texts], "t string").select("t", logtext.log_tail(F.col("t"), max_bytes=n)).collect()
        for text, tail in got:
            data = text.encode()
            want = data[-n:]
            while want and (want[0] & 0xC0) == 0x80:
                want = want[1:]
            assert tail == want.decode(), (text, n)


def test_gunzip_replaces_bad_bytes_and_reports_corruption(make):
    blobs = [gzip.compress(b"err: \xff\xfe\xfd"), gzip.compress("café".encode()), b"not gzip", gzip.compress(b"abc" * 99)[:-9], None]
    df = make([(i, b) for i, b in enumerate(blobs)], "i int, b binary")
    got = {r["i"]: r["u"] for r in df.select("i", logtext.gunzip("b").alias("u")).collect()}
    assert got[0]["text"] == "err: ���" and got[0]["error"] is None
    assert got[1]["text"] == "café"
    assert got[2]["text"] is None and got[2]["error"].startswith("corrupt gzip")
    assert got[3]["text"] is None and got[3]["error"] is not None
    assert got[4]["text"] is None and got[4]["error"] is None


def test_durations_and_since(make):
    df = make([(450,), (7_000,), (125_000,), (3_725_000,), (0,)], "ms bigint")
    got = df.select(times.fmt_ms(F.col("ms")), times.format_elapsed(F.col("ms"))).collect()
    assert [tuple(r) for r in got] == [("450ms", "0s"), ("7s", "7s"), ("2m 5s", "2m5s"), ("1h 2m 5s", "1h2m"), ("0ms", "0s")]
    rel = make([("1h",), (" 30m ",), ("7d",), ("10s",), ("5w",), ("",), ("h",), ("-1h",)], "s string")
    as_of = F.lit("2024-01-08 12:00:00").cast("timestamp")
    got = [str(r[0]) for r in rel.select(times.since(F.col("s"), as_of).cast("string")).collect()]
    assert got == ["2024-01-08 11:00:00", "2024-01-08 11:30:00", "2024-01-01 12:00:00", "2024-01-08 11:59:50", "None", "None", "None", "2024-01-08 13:00:00"]


def test_retry_and_outcome(make):
    df = make(
        [("transient", 1), ("transient", 2), ("disk_full", 1), ("build_failure", 1), (None, 1)], "c string, a int"
    )
    got = [r[0] for r in df.select(outcomes.will_retry(F.col("c"), F.col("a"))).collect()]
    assert got == [True, False, True, False, False]
    assert df.select(outcomes.next_attempt_at_ms(F.lit(1000), F.lit(2))).first()[0] == 61_000


def test_attr_cached(make):
    df = make([("cached", None), ("local", None), ("notBuilt", True), (None, None), ("local", False)], "s string, c boolean")
    assert [r[0] for r in df.select(outcomes.attr_cached(F.col("s"), F.col("c"))).collect()] == [True, False, True, False, False]


def test_features(make):
    df = make([([], []), (["kvm"], ["kvm", "x"]), (["kvm", "y"], ["kvm"]), (["kvm"], [])], "r array<string>, s array<string>")
    assert [r[0] for r in df.select(outcomes.features_ok(F.col("r"), F.col("s"))).collect()] == [True, True, False, False]


def test_states_cover_all_latches(make):
    rows = [(f, p, r, n) for f in (True, False) for p in (True, False) for r in (True, False) for n in (0, 1)]
    got = rows_of(make(rows, "f boolean, p boolean, r boolean, n int").select("f", "p", "r", "n", outcomes.step_state(*[F.col(c) for c in "fprn"])))
    for f, p, r, n, state in got:
        want = ("failed" if p else "done") if f else "pending" if r else "building" if n else "pending"
        assert state == want


def test_archives_pack_and_unpack_in_small_slices():
    """Python objects of a few texts at a time, whatever the size of the Arrow batch."""
    import gzip
    import tracemalloc

    import pyarrow as pa

    from rivetgraph.functions import logtext

    texts = ["%06d" % i + "x" * 20_000 for i in range(1_000)] + [None, "", "é"]
    column = pa.array(texts)
    tracemalloc.start()
    packed = logtext.gzip_text.func(column)
    back = logtext.gunzip.func(packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["text"] for r in back.to_pylist()] == texts and back.field("error").null_count == len(texts)
    assert peak < 8_000_000
    odd = logtext.gunzip.func(pa.array([b"no gzip", gzip.compress(b"\xff")])).to_pylist()
    assert odd[0]["error"].startswith("corrupt gzip") and odd[1]["text"] == "�"
    assert len(logtext.gzip_text.func(pa.array([], pa.string()))) == 0
