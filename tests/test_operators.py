"""Operators on tiny hand-made inputs."""

import hashlib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from evidentia.functions import names, texts
from evidentia.operators import extract, graph, history, registry, scope, search, structure, telemetry
from evidentia.plans import catalog, envelope
from evidentia.schemas import EDGES, NODES
from evidentia.sources import readers, sinks
from evidentia.streaming import usage


def graph_of(spark, nodes, edges):
    """nodes: name -> file; edges: (consumer, dependency)."""
    ids = {n: k for k, n in enumerate(nodes)}
    a = spark.createDataFrame([(ids[n], n, "class", f, "", "") for n, f in nodes.items()], NODES)
    return a, spark.createDataFrame([(ids[s], ids[d], "uses") for s, d in edges], EDGES)


CASES = {
    "reverse only": ({"service": "s", "app": "a", "dep": "d"}, [("app", "service"), ("service", "dep")], "s", {"a": 1}),
    "same file is free": ({"a": "a", "local": "a", "b": "b"}, [("local", "a"), ("b", "local"), ("a", "b")], "a", {"b": 1}),
    "shortest path": ({"origin": "o", "mid": "m", "consumer": "c"}, [("mid", "origin"), ("consumer", "mid"), ("consumer", "origin")], "o", {"c": 1, "m": 1}),
    "two hops over a file": ({"o": "o", "m1": "m", "m2": "m", "z": "z"}, [("m1", "o"), ("m2", "m1"), ("z", "m2")], "o", {"m": 1, "z": 2}),
}


@pytest.mark.parametrize("case", CASES)
def test_file_impact(spark, case):
    nodes, edges, origin, want = CASES[case]
    random.Random(5).shuffle(edges)
    one = spark.createDataFrame([(origin, origin)], "origin string, file string")
    got = {r.file: r.distance for r in graph.file_impact(*graph_of(spark, nodes, edges), one, 3).collect()}
    assert got == want


def test_distance_stops_at_the_depth(spark):
    chain = {f"n{k}": f"f{k}" for k in range(6)}
    one = spark.createDataFrame([("f0", "f0")], "origin string, file string")
    got = graph.file_impact(*graph_of(spark, chain, [(f"n{k + 1}", f"n{k}") for k in range(5)]), one, 2).collect()
    assert {r.file: r.distance for r in got} == {"f1": 1, "f2": 2}


def test_sentinel_and_normalised_edges(spark):
    n, e = graph_of(spark, {"a": "x", "b": "y"}, [("a", "b"), ("a", "b")])
    assert graph.filtered(n, e, ["__none__"])[0].count() == 0
    once, bad = graph.normalized(n.where("label = 'a'"), e)
    assert (once.count(), bad.count()) == (1, 1)


def test_inspect_codes(spark):
    good = {"runId": "r", "profile": "p", "sha": "s", "nexusTools": True, "writePaths": ["a"], "watchPaths": []}
    lines = {
        "": "blank_line", '{"runId"': "invalid_json", '{"a":1,"a":2}': "duplicate_keys", "[]": "not_object", "3": "not_object", json.dumps(good | {"x": 1}): "extra_keys",
        json.dumps({"runId": "r"}): "missing_keys", json.dumps(good | {"runId": " "}): "empty_or_non_str", json.dumps(good | {"sha": 3}): "empty_or_non_str",
        json.dumps(good | {"nexusTools": 1}): "not_bool", json.dumps(good | {"nexusTools": None}): "not_bool", json.dumps(good | {"writePaths": [" "]}): "not_list_of_nonempty_str", json.dumps(good | {"watchPaths": "a"}): "not_list_of_nonempty_str", json.dumps(good): None,
    }
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [r.code for r in telemetry.inspect(rows).orderBy("line_no").collect()] == list(lines.values())


def test_run_status_chain(spark):
    rows = [
        (1, 1, "claimed", 1, None), (1, 1, "pr_acceptance", 2, True), (1, 1, "completed", 3, None), (1, 2, "claimed", 4, None),
        (1, 2, "pr_acceptance", 5, True), (1, 2, "completed", 6, None), (2, 1, "claimed", 1, None), (2, 2, "pr_acceptance", 2, True),
        (3, 1, "pr_acceptance", 1, False)
    ]
    got = {(r.task, r.run): r.status for r in history.run_status(spark.createDataFrame(
        rows, "task long, run long, kind string, event_id long, verified boolean"
    )).collect()}
    assert got == {(1, 1): "superseded", (1, 2): "active", (2, 1): "candidate", (2, 2): "rejected", (3, 1): "rejected"}


def test_first_wins_reads_in_order(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randint(0, 20)}", f"p{rng.randint(0, 20)}", k) for k in range(80)]
    seen, want = (set(), set()), []
    for n, p, k in rows:
        if n not in seen[0] and p not in seen[1]:
            want.append(k)
            seen[0].add(n)
            seen[1].add(p)
    assert sorted(r.ord for r in registry.first_wins(spark.createDataFrame(rows, "name string, path string, ord long")).collect()) == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("New.js", "new.js", True), ("new.js.", "new.js", True), ("new.js ", "new.js", True), ("é.js", "é.js", True), ("new.js", "new.jsx", False),
        ("STRASSE", "straße", True)
    ]
)
def test_names_collide(spark, a, b, same):
    assert spark.range(1).select(names.collide(F.lit(a), F.lit(b)).alias("c")).first().c == same


def test_secret_names(spark):
    yes = ["credential.json", "Secrets.json", "ID_RSA", ".ENV.local"]
    no = ["secretsfoo.js", "secretary.md", "credentialsHelper.ts", "service_accounts.json", "id_rsa."]
    rows = spark.createDataFrame([(p,) for p in [*yes, *no, "src/a.js", "../x", "/abs", "a//b", "./a", "node_modules/x.js", "C:x"]], "path string")
    assert {r.path for r in rows.where(texts.path_allowed(F.col("path"))).collect()} == {*no, "src/a.js"}


def test_bounded_text_cuts_whole_characters(spark):
    samples = ["x" * 510 + "é" * 3, "x" * 511 + "é", "x" * 509 + "😀", "short", None, "password: hunter2\nnext", "sk-" + "a" * 20, "é" * 400]
    rows = spark.createDataFrame(list(enumerate(samples)), "n long, t string").orderBy("n").select(texts.bounded(F.col("t")).alias("t")).collect()
    cut = [s.encode()[:512].decode("utf-8", "ignore") for s in ("x" * 510 + "é" * 3, "x" * 511 + "é", "x" * 509 + "😀")]
    assert [r.t for r in rows] == [*cut, "short", "", "[REDACTED]\nnext", "[REDACTED]", "é" * 256]


def test_globs():
    import re

    for glob, yes, no in (("x/**", ["x", "x/a/b"], ["xy"]), ("src/*.ts", ["src/a.ts"], ["src/b/a.ts"]), ("**/t?.md", ["t1.md", "a/b/t2.md"], ["a/t10.md"])):
        assert all(re.match(search.glob_regex(glob), p) for p in yes) and not any(re.match(search.glob_regex(glob), p) for p in no)


def test_typescript_symbols_and_imports(spark):
    files = spark.createDataFrame(
        [
            ("src/a.ts", "import { B } from './b';\nimport x from \"../lib/c\";\nexport class A {}\nexport const y = 1;"),
            ("src/b.ts", "export interface B {}\nexport default function run() {}"), ("lib/c/index.ts", "export type C = number;"),
            ("d.py", "class D: pass")
        ],
        "path string, text string"
    )
    assert {(r.path, r.name) for r in extract.exports(files).collect()} == {
        ("src/a.ts", "A"), ("src/a.ts", "y"), ("src/b.ts", "B"), ("src/b.ts", "run"), ("lib/c/index.ts", "C")
    }
    found = {(r.path, r.specifier): r.target for r in extract.resolved(extract.imports(files), files).collect()}
    assert found == {("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "../lib/c"): "lib/c/index.ts"}


def test_symbol_categories(spark):
    rows = spark.createDataFrame(
        [
            ("UserController", "App", "class", "Web", "controller"), ("IThing", "App", "interface", "Web", "interface"),
            ("PayService", "App", "class", "Web", "service"), ("Order", "App.Domain.Orders", "class", "X", "domain"),
            ("Foo", "", "class", "My.Api", "api"), ("Foo", "", "class", "", "unknown")
        ],
        "name string, ns string, kind string, project string, want string"
    )
    got = rows.select(texts.category(F.col("name"), F.col("ns"), F.col("kind"), F.col("project")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_scope_gate_and_stems(spark):
    side = {"status": "available", "project_id": "p", "repository_identity": "r", "commit_sha": "c"}
    assert scope.gate(side, side) is None
    assert scope.gate(side, side | {"commit_sha": None}) == "revision_mismatch" and scope.gate(side, side | {"project_id": None}) == "identity_mismatch"
    assert scope.gate({"status": "not_evaluated"}, {"status": "rejected"}) == "input_not_evaluated"
    rows = spark.createDataFrame([("a/one.test.ts",), ("src/one.ts",), ("tests/test_two.py",), ("two.py",)], "path string")
    assert {(r.path, r.test) for r in scope.test_candidates(rows).collect()} == {("src/one.ts", "a/one.test.ts"), ("two.py", "tests/test_two.py")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p/src").mkdir(parents=True)
    (tmp_path / "p/src/a.ts").write_text("export class A {}")
    (tmp_path / "p/package.json").write_text("{}")
    (tmp_path / "p/secrets.json").write_text("{}")
    assert {r.path for r in readers.source_files(spark, str(tmp_path / "p")).collect()} == {"src/a.ts", "package.json"}
    assert readers.discovered(str(tmp_path)) == ([{"relativePath": "p", "signals": ["package.json"], "type": "nodejs"}], False)
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table sessions (id text, input_tokens integer)")
        db.executemany("insert into sessions values (?, ?)", [(f"s{k}", k or None) for k in range(9)])
    spark.dataSource.register(readers.SqliteSource)
    got = spark.read.format("sqlite_snapshot").schema("id string, input_tokens long").option("path", str(tmp_path / "s.db")).option("table", "sessions").load()
    assert {r.id: r.input_tokens for r in got.collect()} == {f"s{k}": k or None for k in range(9)}
    row = spark.createDataFrame(
        [("r", "p", "s", True, ["a"], [])],
        "runId string, profile string, sha string, nexusTools boolean, writePaths array<string>, watchPaths array<string>"
    )
    assert sinks.append_capture(row, str(tmp_path / "log")).first().records == 1
    assert telemetry.inspect(readers.capture_lines(spark, str(tmp_path / "log"))).first().code is None


def test_dirty_and_front_matter():
    assert readers.porcelain_dirty(b"") is False and readers.porcelain_dirty(b" M a\0") is True and readers.porcelain_dirty(b"?? x/__pycache__/\0") is False
    assert readers.porcelain_dirty(b"R  b\0a\0") is True and readers.porcelain_dirty(b"broken") is None
    assert readers.front_matter("---\nid: w\npaths:\n  - a\n  - b\n---\nbody") == {"id": "w", "paths": ["a", "b"]}
    with pytest.raises(ValueError):
        readers.front_matter("---\nid: a\nid: b\n---\n")


def test_stream_of_events_keeps_conflicts(spark, tmp_path):
    for n, rows in enumerate(([("k1", "a"), ("k2", "a")], [("k1", "a"), ("k2", "b")], [("k2", "a")])):
        spark.createDataFrame(rows, "key string, body string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("key string, body string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = usage.deduplicated_stream(stream, "key", "body").writeStream.format("memory").queryName("dedup").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/log").start()
    query.awaitTermination()
    last = {r.key: r.state for r in spark.sql("select key, max_by(state, events) as state from dedup group by key").collect()}
    assert last == {"k1": "duplicate", "k2": "conflict"}


def test_watermarks_ignore_older_and_quarantine_divergent(spark):
    heads = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "a")], "task long, watermark long, rows_hash string")
    new = spark.createDataFrame([(1, 4, "z"), (2, 5, "b"), (3, 6, "c"), (4, 1, "d")], "task long, watermark long, rows_hash string")
    kept, bad = usage.advance(heads, new)
    assert {r.task: (r.watermark, r.rows_hash) for r in kept.collect()} == {1: (5, "a"), 2: (5, "a"), 3: (6, "c"), 4: (1, "d")}
    assert [r.task for r in bad.collect()] == [2]


def test_envelopes(spark):
    assert envelope.impact_request({"projectId": "p", "targets": ["b", "a"]}) == {"projectId": "p", "targets": ["a", "b"], "depth": 2, "limit": 100}
    for bad in (
        {}, {"projectId": "p", "targets": []}, {"projectId": "p", "targets": ["a"], "x": 1}, {"projectId": "p", "targets": ["a"], "depth": 9},
        {"projectId": "p", "targets": ["../a"]}
    ):
        with pytest.raises(envelope.BadRequest):
            envelope.impact_request(bad)
    trimmed = envelope.trim({"items": [{"n": k} for k in range(50)]}, "items", 200)
    assert trimmed["truncated"] and len(json.dumps(trimmed, separators=(",", ":")).encode()) <= 200
    assert envelope.trim_longest({"a": list("xxxx"), "b": ["y"]}, 29) == {"a": ["x", "x", "x"], "b": ["y"]}
    row = envelope.with_status(spark.range(0)).first()
    assert (row.status, row.finding_state) == ("available", "no_evidence_found")
    assert envelope.with_status(spark.range(3), ["work_limit"]).first().asDict() == {"status": "partial", "finding_state": "evidence_found", "reasons": ["work_limit"]}


def test_provider_choice():
    providers = [
        {"id": "b", "priority": 1, "languages": ["go"], "capabilities": {"impact": "full"}},
        {"id": "a", "priority": 1, "languages": ["go", "java"], "capabilities": {}},
        {"id": "c", "priority": 9, "languages": ["java"], "capabilities": {"impact": "full"}}
    ]
    from evidentia.operators import evidence

    found, attempts = evidence.choose_provider(providers, {"go"}, "impact")
    assert found["id"] == "b" and [(a["id"], a["reason"]) for a in attempts] == [("c", "unsupported_language"), ("a", "unsupported_capability"), ("b", None)]
    assert evidence.choose_provider([], {"go"}, "impact") == (None, [])


@pytest.mark.parametrize("name", ["impact_files_deep", "impact_multi_origin_deep"])
def test_registered_impact_goes_beyond_one_level(spark, name):
    assert {r.distance for r in catalog.queries()[name](spark, "/root/testdata/sf0.01").collect()} == {1, 2}


def test_requests_and_limits(tmp_path):
    assert envelope.relative_path(" a\\b/ ") == "a/b"
    for bad in ("../a", "/a", "C:/a", "a//b", "", ".", 1):
        with pytest.raises(envelope.BadRequest):
            envelope.relative_path(bad)
    assert [envelope.clamped(v, 7, 1, 9) for v in (0, 3.9, 99, "x", None, float("nan"))] == [1, 3, 9, 7, 7, 7]
    assert [envelope.parsed_limit(v, 7, 2, 9) for v in (0, 1, "4", 99)] == [7, 2, 4, 9]
    want = {"projectId": "p", "task": {"title": "t", "description": "", "paths": ["a", "b"], "symbols": ["S"]}, "limits": {"files": 3}}
    assert envelope.context_request({"projectId": " p ", "task": {"title": "t", "paths": ["b", "a"], "symbols": ["S"]}, "limits": {"files": 3}}) == want
    for bad in (
        {}, {"projectId": "p"}, {"projectId": "p", "task": {"paths": ["a", "a"]}}, {"projectId": "p", "task": {}, "limits": {"files": 999}},
        {"projectId": "p", "task": {}, "x": 1}
    ):
        with pytest.raises(envelope.BadRequest):
            envelope.context_request(bad)
    for n in (1, 2):
        sinks.replace_json(f"{tmp_path}/state.json", {"n": n})
    assert json.loads((tmp_path / "state.json").read_text()) == {"n": 2} and len(list(tmp_path.iterdir())) == 1


def test_registered_analyzers_and_questions(spark):
    envelope.register_analyzer("test-only", lambda files: (files, files))
    with pytest.raises(envelope.BadRequest):
        envelope.register_analyzer("test-only", lambda files: (files, files))
    files = spark.createDataFrame([("src/a.ts",), ("tests/a.test.ts",)], "path string")
    assert [tuple(r) for r in envelope.ask("tests", files).collect()] == [("src/a.ts", "tests/a.test.ts")]
    with pytest.raises(envelope.BadRequest):
        envelope.ask("weather", files)


def test_published_tables_and_pinned_files(spark, tmp_path):
    first = sinks.publish(spark.range(3).toDF("id"), f"file://{tmp_path}/t")
    sinks.publish(spark.range(5).toDF("id"), f"file://{tmp_path}/t")
    assert spark.read.parquet(first).count() == 3
    (tmp_path / "f.bin").write_bytes(b"body")
    rows = spark.read.format("binaryFile").load(f"file://{tmp_path}/f.bin")
    sha = sinks.manifest(rows).first().sha256
    assert readers.pinned(spark, f"file://{tmp_path}/f.bin", sha).count() == 1 and readers.pinned(spark, f"file://{tmp_path}/f.bin", "0" * 64).count() == 0


def test_idle_restart_keeps_the_state(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "task long, watermark long, rows_hash string").write.parquet(source)
    stream = lambda: spark.readStream.schema("task long, watermark long, rows_hash string").parquet(source)
    for _ in range(2):
        heads, pending = usage.synchronise(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
        assert heads.count() == 2 and pending.count() == 0


def test_hash_chain_folds_in_order(spark):
    rows = [(k, n, f"v{n}") for k in ("a", "b") for n in range(40)]
    random.Random(2).shuffle(rows)
    got = {r.k: (r.steps, r.chain) for r in history.hash_chain(spark.createDataFrame(rows, "k string, n long, v string").repartition(5), "k", "n", ["v"]).collect()}
    chain = ""
    for n in range(40):
        chain = hashlib.sha256((chain + f"v{n}").encode()).hexdigest()
    assert got == {"a": (40, chain), "b": (40, chain)}


def test_registry_rows_are_canonical(spark, tmp_path):
    rows = [
        {"name": " a ", "relativePath": "x\\y/"}, {"name": "b", "relativePath": "../z"}, {"name": "", "relativePath": "x"}, {"name": "c"},
        {"name": "d", "rootId": "r", "relativePath": "d", "registrySource": "discovered"}, {"name": "e", "relativePath": "/abs"}
    ]
    (tmp_path / "registry.json").write_text(json.dumps(rows))
    got = [(r.name, r.rootId, r.relativePath, r.registrySource) for r in readers.registry(spark, f"file://{tmp_path}/registry.json").orderBy("name").collect()]
    assert got == [("a", "default", "x/y", "manual"), ("d", "r", "d", "discovered")]


def test_tests_of_targets(spark):
    rows = spark.createDataFrame([("src/one.ts",), ("a/one.test.ts",), ("b/One.spec.tsx",), ("tests/test_two.py",), ("t/three.test.ts",), ("a/one.test.ts",)], "path string")
    targets = spark.createDataFrame([("src/one.ts",), ("t/three.test.ts",), (None,), ("src/one.ts",)], "path string")
    got = sorted((r.path, r.reason) for r in scope.tests_of(rows, targets).collect())
    assert got == [("a/one.test.ts", "basename_convention")] * 2 + [("b/One.spec.tsx", "basename_convention"), ("t/three.test.ts", "task_path_or_reference")]
    assert scope.tests_of(rows, targets.limit(0)).count() == 0


def test_likely_dependencies_keep_each_text_in_its_row(spark):
    text = "class A { private readonly IB b; A(C<D> c, string s) { new E(); } } class AA { AA(F f) {} }"
    rows = spark.createDataFrame([("x.cs", text), ("y.cs", "class Z { new E(); }"), ("empty.cs", ""), ("null.cs", None)], "path string, text string")
    found = structure.likely_dependencies(rows)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.dep_name)
    assert {k: sorted(v) for k, v in got.items()} == {"x.cs#A": ["D", "E", "F", "IB"], "x.cs#AA": ["E", "F", "IB"], "y.cs#Z": ["E"]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
