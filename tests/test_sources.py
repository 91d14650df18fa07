"""Documents, exposition text, derivation files."""

import pytest
from pyspark.sql import functions as F

from rivetgraph.operators import graph
from rivetgraph.sources import derivations, documents, exposition, tables
from tests.conftest import rows_of


def text(make, *lines):
    return make([(i, line) for i, line in enumerate(lines)], "line_no int, value string")


def test_evaluator_lines(make):
    df = text(
        make,
        '{"drvPath":"/s/a-b.drv","attr":"x","cacheStatus":"cached","neededBuilds":["/s/a-b.drv"]}',
        '{"drvPath":"/s/a-c.drv","name":"c","cacheStatus":"local"}',
        '{"drvPath":"/s/a-d.drv","cacheStatus":"notBuilt","isCached":true,"unknownKey":{"a":1}}',
        '{"attr":"broken","error":"boom"}',
        '{"error":"who"}',
        "{not json",
        "  ",
    )
    good, bad = documents.eval_lines(df)
    assert rows_of(bad, "line_no") == [(5,)]
    assert rows_of(good, "line_no", "cached") == [(0, True), (1, False), (2, True), (3, False), (4, False)]
    assert rows_of(documents.eval_errors(good), "attr", "error") == [("<unknown>", "who"), ("broken", "boom")]


def test_batches_fill_in_defaults(make):
    df = text(make, '{"drvs":[{"drv_path":"p","drv_name":"n","system":"s"},{"drv_path":"q","drv_name":"n","system":"s","is_root":true,"input_drvs":["p"],"attr":"a"}]}', "{}")
    got = documents.batch_rows(documents.ingest_batches(df)).orderBy("pos").collect()
    assert [(r["pos"], r["drv_path"], r["required_features"], r["input_drvs"], r["is_root"], r["attr"]) for r in got] == [
        (0, "p", [], [], False, None), (1, "q", [], ["p"], True, "a"),
    ]
    assert rows_of(documents.ingest_batches(df).select(F.size("eval_errors"))) == [(0,), (0,)]


def test_events_skip_what_is_unknown_or_broken(make):
    df = text(make, '{"kind":"drv_failed","job_id":"j","will_retry":true,"used_by_attrs":["a"]}', '{"kind":"novel"}', '{"kind":"lagged","missed":3}', '{"ki')
    assert rows_of(documents.job_events(df), "kind", "will_retry", "missed") == [("drv_failed", True, None), ("lagged", None, 3)]


def test_metrics_text(make):
    df = text(
        make, "# HELP x y", "", "plain 3", 'a_total{outcome="success",q="0.5"} 7', 'a_total{outcome="failure"} 1e3', "bad value_x", "lonely", "nan_metric NaN"
    )
    m = exposition.metric_lines(df)
    assert rows_of(m.where("name != 'nan_metric'"), "name", "metric_value") == [("a_total", 1000.0), ("a_total", 7.0), ("plain", 3.0)]
    pick = lambda **kw: rows_of(exposition.select_metric(m, "a_total", kw), "metric_value")
    assert pick(outcome="success") == [(7.0,)] and pick(q="0.5", outcome="failure") == [] and len(pick()) == 2


DRV = 'Derive([{outs}],[{ins}],["/s/src"],"x86_64-linux","/bin/sh",["-e",")("],[{env}])'
OUT = '("out","/s/o","",""){more}'


def drv(outs='("out","/s/o","","")', ins="", env='("name","hello"),("system","x")'):
    return DRV.format(outs=outs, ins=ins, env=env).encode()


@pytest.mark.parametrize(
    "data, want",
    [
        (drv(), (None, "hello", 1, [])),
        (b" \n" + drv() + b"\n", (None, "hello", 1, [])),
        (drv(ins='("/s/b.drv",["out","dev"]),("/s/a.drv",["out"])'), (None, "hello", 1, ["/s/b.drv", "/s/a.drv"])),
        (drv(outs=""), (None, "hello", 0, [])),
        (drv(env='("system","x")'), (None, "unknown", 1, [])),
        (drv(env='("name","first"),("name","second")'), (None, "first", 1, [])),
        (drv(env='("name","a\\"b\\\\c\\nd\\te\\qf")'), (None, 'a"b\\c\nd\te\\qf', 1, [])),
        (drv(env='("name","café-1.0")'), (None, "café-1.0", 1, [])),
        (drv(env='("name","raw\nnewline")'), (None, "raw\nnewline", 1, [])),
        (drv(env='("x","Derive(["),("name","(n)")'), (None, "(n)", 1, [])),
        (drv().replace(b",[(", b" , [ (", 1), (None, "hello", 1, [])),
        (b"\xff\xfe" + drv(), ("NotUtf8", None, None, None)),
        (b"Drv([])", ("MissingHeader", None, None, None)),
        (b"", ("MissingHeader", None, None, None)),
        (drv()[:-1], ("MissingFooter", None, None, None)),
        (b'Derive([("out","x"],[])', ("BadSyntax", None, None, None)),
        (b"Derive()", ("BadSyntax", None, None, None)),
        (drv(ins='("/s/b.drv","out")'), ("BadSyntax", None, None, None)),
        (drv(ins='["/s/b.drv",["out"]]'), ("BadSyntax", None, None, None)),
        (drv(env='("name",3)'), ("BadSyntax", None, None, None)),
        (drv(env='("name","unterminated)'), ("BadSyntax", None, None, None)),
    ],
)
def test_derivation_text(make, data, want):
    r = derivations.parse(make([("p", bytearray(data))], "path string, content binary")).first()
    inputs = None if r["input_drvs"] is None else [i["path"] for i in r["input_drvs"]]
    outputs = None if r["outputs"] is None else len(r["outputs"])
    assert (r["error_class"], r["name"], outputs, inputs) == want


def test_derivation_files_to_graph(spark, tmp_path):
    (tmp_path / "r.drv").write_bytes(drv(ins='("/s/a.drv",["out"])'))
    (tmp_path / "a.drv").write_bytes(drv(outs='("out","/s/o","sha256","abc")'))
    (tmp_path / "note.txt").write_text("not a derivation")
    parsed = derivations.parse(derivations.read_files(spark, str(tmp_path)))
    nodes, edges, fixed = derivations.graph(parsed)
    assert nodes.count() == 2 and edges.count() == 1 and [r[0][-5:] for r in fixed.collect()] == ["a.drv"]
    assert rows_of(graph.fan_out(edges), "drv_hash") == [("/s/a.drv",)]


def test_log_listing_never_reads_the_blob(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.range(3).selectExpr("cast(id as string) claim_id", "cast('x' as binary) log_gz").write.parquet(path)
    plan = tables.build_logs(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "claim_id" in plan and "log_gz" not in plan.split("ReadSchema")[1]
