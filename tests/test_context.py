"""Context packs, briefs, caches, observations and verdicts on tiny inputs."""

import json
import os
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from evidentia.__main__ import main
from evidentia.functions import codes, names
from evidentia.operators import bindings, explorer, impact, modules, structure, tasks, telemetry, verdicts
from evidentia.plans import context, service
from evidentia.plans.envelope import BadRequest
from evidentia.schemas import EDGES, NODES
from evidentia.sources import observations, readers


@pytest.fixture
def project(spark):
    files = spark.createDataFrame(
        [(p, 10, "h") for p in ("src/one.ts", "src/two.ts", "src/far.ts", "tests/one.test.ts", "PROJECT.md")],
        "path string, byte_size long, sha256 string"
    )
    nodes = spark.createDataFrame(
        [
            (1, "One", "class", "src/one.ts", "", ""), (2, "Two", "class", "src/two.ts", "", ""), (3, "Far", "class", "src/far.ts", "", ""),
            (4, "../odd", "class", "src/one.ts", "", ""), (5, "Gone", "class", "src/gone.ts", "", "")
        ],
        NODES
    )
    edges = spark.createDataFrame([(2, 1, "imports"), (3, 2, "uses"), (5, 1, "uses")], EDGES)
    docs = spark.createDataFrame(
        [("project", "PROJECT.md", "P"), ("adr", "docs/adr/1.md", "About one"), ("adr", "docs/adr/2.md", "Other")],
        "kind string, path string, title string"
    )
    spaces = spark.createDataFrame([("w", "src/AGENT.md", "src")], "id string, path string, folder string")
    return {"files": files, "nodes": nodes, "edges": edges, "documents": docs, "workspaces": spaces}


def test_context_pack(project):
    pack = context.context_pack("p", {"title": "Change one", "paths": ["src/one.ts"]}, project)
    got = {k: [tuple(i.values()) for i in s["items"]] for k, s in pack["sections"].items()}
    assert [i[1] for i in got["symbols"]] == ["One", "Two"] and got["references"] == [(2, 1, "imports")]
    assert [i[0] for i in got["files"]] == ["src/one.ts", "src/two.ts"] and got["tests"] == [("tests/one.test.ts",)]
    assert [i[1] for i in got["documents"]] == ["PROJECT.md", "docs/adr/1.md"] and got["workspaces"] == [("w", "src/AGENT.md")]
    assert not pack["incomplete"] and pack == context.context_pack("p", {"title": "Change one", "paths": ["src/one.ts"]}, project)
    open_ended = context.context_pack("p", {"title": "add far"}, project)
    assert [i["label"] for i in open_ended["sections"]["symbols"]["items"]] == ["Far", "Two"]


def test_context_pack_is_bounded(project):
    task = {"title": "Change one", "paths": ["src"]}
    pack = context.context_pack("p", task, project, {"symbols": 1})
    assert len(pack["sections"]["symbols"]["items"]) == 1 and pack["sections"]["symbols"]["truncated"] and pack["incomplete"]
    whole = context.size_of(context.context_pack("p", task, project))
    small = context.context_pack("p", task, project, most_bytes=whole - 30)
    assert small["sections"]["references"]["truncated"] and context.size_of(small) <= whole - 30
    with pytest.raises(BadRequest):
        context.context_pack("p", task, project, most_bytes=200)
    with pytest.raises(BadRequest):
        context.context_pack("p", {"paths": ["../x"]}, project)


def test_task_brief(project):
    pack = context.context_pack("p", {"title": "one", "paths": ["src/one.ts"]}, project) | {"snapshotToken": "t"}
    found = {
        "snapshotToken": "t", "paths": ["src/one.ts"], "status": "available", "finding": "evidence_found", "incomplete": False,
        "affectedFiles": [f"src/f {n}.ts" for n in range(30)], "testCandidates": None
    }
    text = context.task_brief(pack, found)
    assert "Symbols One@src/one.ts, Two@src/two.ts" in text and "Tests (not requested)" in text and '"src/f 0.ts"' in text and "briefTruncated=true" in text
    assert len(context.task_brief(pack, found, {"textBytes": 300}).encode()) <= 300
    for bad in ({"snapshotToken": "other"}, {"affectedFiles": ["a​b"]}):
        with pytest.raises(BadRequest):
            context.task_brief(pack, found | bad)


def test_bounds_and_codes():
    assert context.bounded_json({"a": [1, None, "x"]}) == {"a": [1, None, "x"]}
    deep = []
    for _ in range(40):
        deep = [deep]
    for bad in (deep, {"x": object()}, list(range(30_000)), float("nan")):
        with pytest.raises(BadRequest):
            context.bounded_json(bad)
    with pytest.raises(BadRequest):
        context.input_budget(pack="x" * 200_000, impact={})
    assert context.http_status(BadRequest("invalid_path")) == 400 and context.http_status(BadRequest("scope_budget_exceeded")) == 413 and context.http_status(ValueError("?")) == 500
    assert tasks.request_diagnostics({"a": True, "c": 1}, {"a": int, "b": str}) == [
        {"code": "wrong_type", "property": "a"}, {"code": "missing", "property": "b"}, {"code": "extra_property", "property": "c"}
    ]
    assert tasks.strict_answer('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', "[1]", '{"a": NaN}'):
        with pytest.raises(ValueError):
            tasks.strict_answer(bad)
    assert tasks.valid_parameter("project", "a-b.c") and not tasks.valid_parameter("project", "a/b") and not tasks.valid_parameter("query", "x" * 501)


def test_cache_of_analyses(spark):
    now = [0.0]
    cache, made = context.AnalysisCache(most=2, seconds=10, clock=lambda: now[0]), []
    analyze = lambda: made.append(1) or (spark.range(1), spark.range(1))
    cache.get("a", "t1", analyze)
    cache.get("a", "t1", analyze)
    assert len(made) == 1 and cache.statistics()["hits"] == 1
    cache.get("a", None, analyze)  # nothing is kept of an unclean tree
    now[0] = 11
    cache.get("a", "t1", analyze)
    assert len(made) == 3
    for p in "bc":
        now[0] += 1
        cache.get(p, "t", analyze)
    assert [e["project"] for e in cache.statistics()["entries"]] == ["b", "c"]  # the least recently used went
    assert cache.clear("b") == {"removed": 1, "remaining": 1} and cache.clear() == {"removed": 1, "remaining": 0}
    assert context.cache_identity("p", {"status": "available", "dirty": False})[1] and not context.cache_identity("p", {"status": "available", "dirty": True})[1]


def test_analyzer_facade(project):
    door = context.Analyzer(project["nodes"], project["edges"], {"search", "impact"})
    status, rows = door.ask("search", "one")
    assert status == "available" and [r.label for r in rows.collect()] == ["One", "Gone"]
    assert door.ask("context", 1) == ("unsupported", None) and context.Analyzer(None, None).ask("search", "x")[0] == "unsupported"
    assert door.ask("impact", 1)[1].first().asDict() == {"direct": 2, "transitive": 3, "affected_files": 4, "score": 9, "level": "low"}


def test_reads_that_change_are_refused(spark):
    state = [1]
    read = lambda: spark.range(state[0])
    assert tasks.unchanged(read, lambda df: df.agg(F.count("*")).first()[0], ["id"]) == 1
    with pytest.raises(tasks.Changed):
        tasks.unchanged(read, lambda df: state.append(state.pop() + 1), ["id"])


def test_observed_checkouts(spark, tmp_path):
    git = lambda *a, d=tmp_path / "r": subprocess.run(
        ["git", "-C", str(d), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True
    )
    (tmp_path / "r").mkdir()
    assert observations.revision(str(tmp_path / "r"))["status"] in ("not_git", "available")
    git("init", "-q", "-b", "main")
    assert observations.revision(str(tmp_path / "r"))["status"] == "unborn"
    (tmp_path / "r" / "f.txt").write_text("x")
    git("add", "f.txt")
    git("commit", "-q", "-m", "first")
    git("worktree", "add", "-q", str(tmp_path / "w"))
    rows = observations.revisions(spark, [str(tmp_path / "r"), str(tmp_path / "w")])
    main, linked = rows.orderBy("path").collect()
    assert (main.status, main.branch, main.dirty, main.isLinkedWorktree) == ("available", "main", False, False) and linked.isLinkedWorktree
    assert main.repositoryId == linked.repositoryId and main.worktreeId != linked.worktreeId and len(main.commitSha) == 40
    assert [tuple(r) for r in observations.linked_worktrees(rows.where("not isLinkedWorktree"), rows).collect()] == [(str(tmp_path / "r"), str(tmp_path / "w"))]
    (tmp_path / "r" / "f.txt").write_text("y")
    assert observations.revision(str(tmp_path / "r"))["dirty"] is True


def test_roots_spools_locks_and_backups(spark, tmp_path):
    for p in ("a/x", "a/b/y"):
        (tmp_path / p).mkdir(parents=True)
    roots = {"one": str(tmp_path / "a"), "two": str(tmp_path / "a" / "b")}
    assert observations.locate(roots, "one", "x") == str(tmp_path / "a" / "x")
    assert observations.locate(roots, "one", "b/y") is None and observations.locate(roots, "one", "../a/x") is None and observations.locate(roots, "no", "x") is None
    private = tmp_path / "spool"
    with observations.locked(str(private)) as folder:
        for name, body in {"k1": '{"a": 1}', "k2": "[1]", "k3": json.dumps({"x": "y" * 5000})}.items():
            (private / f"{name}.json").write_text(body)
        assert {r.key: r.problem for r in observations.spool(spark, f"file://{folder}").collect()} == {"k1": None, "k2": "no_object", "k3": "too_large"}
    os.chmod(private, 0o755)
    with pytest.raises(PermissionError), observations.locked(str(private)):
        pass
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "db").write_text("data")
    observations.back_up(str(tmp_path / "state"), ["db"], str(tmp_path / "copy"))
    (tmp_path / "state" / "db").write_text("lost")
    observations.restore(str(tmp_path / "copy"), str(tmp_path / "state"), ["db"])
    assert (tmp_path / "state" / "db").read_text() == "data" and observations.backup_problems(str(tmp_path / "copy"), []) == ["not_allowed db"]
    (tmp_path / "copy" / "db").write_text("changed")
    assert observations.backup_problems(str(tmp_path / "copy"), ["db"]) == ["digest_differs db"]


def test_probes():
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = {"/ok": b'{"up": true}', "/list": b"[1]"}.get(self.path, b"no")
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    origin = f"http://127.0.0.1:{server.server_port}"
    assert observations.get_json(origin, "/ok") == {"up": True} and observations.get_json(origin, "/list") is None and observations.get_json(origin, "/x") is None
    server.shutdown()
    with pytest.raises(ValueError):
        observations.get_json("http://example.org", "/")
    assert observations.process_sample(os.getpid())["rss"] > 0 and observations.process_sample(2**22 + 1) is None
    now = [0.0]
    samples = observations.soak(lambda: {"x": 1}, 10, 3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [s["at"] for s in samples] == [0, 3, 6, 9]


def test_module_cycles_and_ambiguity(spark):
    files = spark.createDataFrame([
        ("a.ts", "export * from './b';\nexport * from './c';\n"), (
            "b.ts", "export * from './a';\nexport class B {}\nexport class Same {}"
        ), ("c.ts", "export class Same {}\nexport class C {}"),
        (
            "u.ts", "import { B, Same, C as K } from './a';\nimport * as all from './a';"
        ), ("p.ts", "/* only */ export { B as X } from './b'\n"), ("m.ts", "export * from './b';\nconst x = 1;"),
    ], "path string, text string")
    declared = spark.createDataFrame([("b.ts", "B"), ("b.ts", "Same"), ("c.ts", "Same"), ("c.ts", "C")], "path string, name string")
    table = {(r.path, r.name, r.origin) for r in modules.export_table(files, declared).collect()}
    assert {("a.ts", "B", "b.ts"), ("a.ts", "Same", "b.ts"), ("a.ts", "Same", "c.ts"), ("b.ts", "C", "c.ts"), ("p.ts", "X", "b.ts")} <= table
    edges = {(r.src_file, r.dst_file, r.label): r.verdict for r in modules.import_edges(files, declared).collect()}
    assert edges == {("u.ts", "b.ts", "B"): "resolved", ("u.ts", "b.ts", "Same"): "ambiguous", ("u.ts", "c.ts", "Same"): "ambiguous", ("u.ts", "c.ts", "C"): "resolved"}
    assert {r.path for r in modules.pure_barrels(files).collect()} == {"a.ts", "p.ts"}


def admitted_one_by_one(edges, node_limit, edge_limit):
    inside, chosen = set(), []
    for src, dst, relation, score in edges:
        if len(chosen) < edge_limit and len(inside | {src, dst}) <= node_limit:
            inside |= {src, dst}
            chosen.append((src, dst, relation, score))
    return chosen


@pytest.mark.parametrize("node_limit, edge_limit", [(1, 9), (2, 9), (5, 4), (5, 100), (9, 3), (50, 1000)])
def test_admission_equals_one_by_one(spark, node_limit, edge_limit):
    rows = sorted({((a * 7) % 23, (a * a + 3) % 23, "uses") for a in range(60)} - {(x, x, "uses") for x in range(23)})
    nodes = spark.createDataFrame([(n, f"N{n}", "class", "f", "service") for n in range(23)], "id long, label string, kind string, file string, category string")
    ids, got = explorer.admitted(nodes, spark.createDataFrame(rows, EDGES), node_limit, edge_limit)
    assert [tuple(r) for r in got.collect()] == admitted_one_by_one([(*r, -10) for r in rows], node_limit, edge_limit)
    assert ids.count() == min(node_limit, 23)


def test_names_and_features(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(codes.simple_hash(F.lit(""))) == "0" and one(codes.simple_hash(F.lit("a😀"))) == format(
        abs(((((97 * 31 + 0xD83D) * 31 + 0xDE00) + 2**31) % 2**32) - 2**31), "x"
    )
    feature = lambda *a: one(codes.feature(*map(F.lit, a)))
    assert feature("Shop.Api", "API", "src/Shop.Api/Controllers/Orders/X.cs", "", "X") == "Orders"
    assert feature("Shop.Api", "API", "src/Shop.Api/X.cs", "Shop.Api.Billing", "X") == "Billing"
    assert feature("Shop.Api", "API", "Shop.Api/Controllers/InvoiceCreationService.cs", "Shop.Api", "InvoiceCreationService") == "Invoice"
    assert feature("Shop.Api", "API", "Shop.Api/X.cs", "", "X") is None
    assert one(structure.namespace(F.lit("namespace A.B\n{ }"))) == "A.B"
    assert one(names.protected_in(["src/café"])(F.lit("SRC/CAFÉ/x"))) and not one(names.protected_in(["src/café"])(F.lit("src/cafés")))
    assert one(names.crossing(["new.js"])(F.lit("New.js./x"))) and not one(names.crossing(["new/js"])(F.lit("new"))) and not one(names.crossing(["a"])(F.lit(None).cast("string")))
    assert codes.canonical({"b": 1.0, "a": [True, None, 0.5]}) == '{"a":[true,null,0.5],"b":1}'
    assert one(verdicts.first_of([("a", F.lit(None).cast("boolean")), ("b", F.lit(True))], "c")) == "b"


def test_answers_cite_known_facts(spark):
    facts = spark.createDataFrame([("impact", "a.ts", "distance 1"), ("impact", "b.ts", "distance 2")], "kind string, path string, detail string")
    catalogue = bindings.fact_catalogue(facts)
    assert bindings.cited_answer(catalogue, ["F2"]) == "[F2] b.ts distance 2"
    for bad in ([], ["F9"], ["F1", "F1"]):
        with pytest.raises(ValueError):
            bindings.cited_answer(catalogue, bad)


def test_impact_budgets(spark):
    nodes = spark.createDataFrame([(n, f"n{n}", "class", f"{'tests' if n % 2 else 'src'}/f{n}.ts", "", "") for n in range(8)], NODES)
    edges = spark.createDataFrame([(n, 0, "imports") for n in range(1, 8)], EDGES)
    origins = spark.createDataFrame([("src/f0.ts", "src/f0.ts"), ("src/none.ts", "src/none.ts")], "origin string, file string")
    whole = impact.project_impact(nodes, edges, origins, 2, "s")
    assert [r.file for r in whole["files"].orderBy("place").collect()] == sorted(f"{'tests' if n % 2 else 'src'}/f{n}.ts" for n in range(1, 8))
    assert [r.file for r in whole["tests"].orderBy("place").collect()] == ["tests/f1.ts", "tests/f3.ts", "tests/f5.ts", "tests/f7.ts"]
    cut = impact.project_impact(nodes, edges, origins, 2, "s", witnesses=5)
    assert cut["files"].count() == 5 and cut["tests"].count() == 0
    assert {r.origin: (r.status, r.finding, r.reasons) for r in cut["origins"].collect()} == {
        "src/f0.ts": ("partial", "evidence_found", "output_limit"), "src/none.ts": ("unavailable", "not_evaluated", "source_unavailable")
    }


def test_service_answers_and_refuses(project):
    projects = {"p": service.Project(project, "snap")}
    status, got = service.handle("project_impact", {"projectId": "p", "targets": ["src/one.ts"], "depth": 2}, projects)
    assert status == 200 and [(i["file"], i["distance"]) for i in got["affectedFiles"]["items"]] == [("src/gone.ts", 1), ("src/two.ts", 1), ("src/far.ts", 2)]
    status, got = service.handle("project_task_context", {"projectId": "p", "task": {"title": "one", "paths": ["src/one.ts"]}}, projects)
    assert status == 200 and got["contextPackId"].startswith("context_")
    status, got = service.handle("effective_task_scope", {"projectId": "p", "task": {"title": "one", "paths": ["src/one.ts"]}}, projects)
    assert status == 200 and {i["path"]: i["category"] for i in got["items"]} == {
        "src/one.ts": "write", "src/two.ts": "watch", "src/far.ts": "watch", "src/gone.ts": "watch"
    }
    assert service.handle("search", {"projectId": "p", "query": "one"}, projects)[1]["items"][0]["label"] == "One"
    assert [n["id"] for n in service.handle("expand", {"projectId": "p", "node": 2}, projects)[1]["nodes"]["items"]] == [1, 2, 3]
    for tool, body, want in (
        ("weather", {}, 400), ("search", [], 400), ("search", {"projectId": "q"}, 404), ("search", {"projectId": "p", "x": 1}, 400),
        ("project_impact", {"projectId": "p", "targets": ["../x"]}, 400)
    ):
        assert service.handle(tool, body, projects)[0] == want
    assert service.handle("search", {"projectId": "p", "query": "x"}, projects, {"search": lambda *_: 1 / 0}) == (500, {"error": "internal_error"})


def test_command_line(capsys):
    assert main(["queries"]) == 0 and "graph_hubs" in capsys.readouterr().out
    assert main(["run", "nothing", "/x"]) == 2


def test_external_evidence_is_bounded(spark, tmp_path):
    good = {
        "schemaVersion": 1, "snapshotToken": "t", "provider": {"id": "x", "version": "1"},
        "nodes": [{"id": "a", "label": "A", "kind": "class", "file": "a.py", "line": 1}], "edges": [{"src": "a", "dst": "a", "relation": "uses"}]
    }
    for name, value in {"good": good, "stale": good | {"snapshotToken": "old"}, "long": good | {"nodes": good["nodes"] * 2001}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "broken.json").write_text("{")
    nodes, edges = readers.external_evidence(spark, f"file://{tmp_path}", "t")
    assert [r.label for r in nodes.collect()] == ["A"] and edges.count() == 1


def test_text_reports_escape_controls():
    text = telemetry.text_report({"valid": 1, "input": "a\x1bb"}, [{"line": 1, "code": "x"}], [], 5)
    assert text == "input: a\\x1bb\nvalid: 1\ninvalid_records (1 of 1):\n  line=1 code=x\n"
