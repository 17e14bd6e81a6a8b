"""Scoped declarations, positions, places in a total order, and budgeted traversals, each against a plain version."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import budget, extract, impact, modules, ordered, scope, scoped

CODE = '''/* class Gone {} */
// class Also {}
const t = `class Fake ${ `x ${"`"}` } ${ {a: 1} } 
 class F2`, u1 = '};', vé = 3, w = /["'`{]/g;
export class Top<T> extends Map<string, T> {
  inner() { class In {} }
}
namespace N { export class Deep {} }
  export default async function Main(a = {}) { const inner = 1; }
let a = 4 / 2, b = "x" / 3; \U0001f600 enum E { A }
import { X } from './class'; import './y';
const s = "import q from 'z'";
function* gen() {}
type Q = { a: string };export interface I {}'''


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string").repartition(3)


def test_only_what_stands_in_no_bracket_declares(spark):
    got = {(r.name, r.word, r.exported, r.is_default) for r in scoped.declarations(files(spark, {"a.ts": CODE, "e.ts": ""})).collect()}
    variables = {(n, w, False, False) for n, w in [("t", "const"), ("u1", "const"), ("vé", "const"), ("w", "const"), ("a", "let"), ("b", "let"), ("s", "const")]}
    others = {("Top", "class", True, False), ("Main", "function", True, True), ("E", "enum", False, False), ("gen", "function", False, False), ("Q", "type", False, False), ("I", "interface", True, False)}
    assert got == variables | others


def test_long_strings_take_no_stack(spark):
    text = "x" * 100_000 + "'" + "\\'" * 50_000 + "'\n`" + "${a}" * 30_000 + "`\n/*" + "* " * 50_000 + "*/class Z {}"
    assert [(r.name, r.line) for r in scoped.positions(files(spark, {"c.ts": text})).collect()] == [("Z", 3)]


def test_masking_keeps_every_place(spark):
    shown = files(spark, {"a.ts": CODE}).select(scoped.masked(F.col("text"))).first()[0]
    assert len(shown) == len(CODE)
    assert all(a == b or b == " " for a, b in zip(CODE, shown, strict=True)) and shown.count("\n") == CODE.count("\n")
    assert "'./class'" in shown and "'./y'" in shown and "Gone" not in shown and "'z'" not in shown


def plain_position(text, at):
    line, begin, k = 1, 0, 0
    while k < at:
        if text[k : k + 2] == "\r\n":
            if k + 1 >= at:
                break
            k, line, begin = k + 2, line + 1, k + 2
        elif text[k] in "\n\r  ":
            k, line, begin = k + 1, line + 1, k + 1
        else:
            k += 1
    return line, len(text[begin:at].encode("utf-16-le")) // 2 + 1


def test_lines_and_columns_of_every_offset(spark):
    texts = {"a": CODE, "b": "one\r\ntwo\rthree\n\n x\U0001f600y", "c": "\n", "d": "no end", "e": ""}
    rows = [(p, k) for p, t in texts.items() for k in range(len(t) + 1) if t[k - 1 : k + 1] != "\r\n"]
    frame = spark.createDataFrame(rows, "path string, at long")
    got = {(r.path, r["at"]): (r.line, r.column) for r in scoped.located(frame, files(spark, texts)).collect()}
    assert got == {(p, k): plain_position(texts[p], k) for p, k in rows}


def test_comments_and_strings_import_and_declare_nothing(spark):
    text = "// import { A } from './a'\nconst s = \"import { B } from './b'\";\nimport { C } from './c';\n/*\nexport class D {}\n*/\nexport class E {}\nconst u = `\nexport class F {}\n`;\n"
    frame = files(spark, {"x.ts": text})
    assert [(r.specifier, r.name) for r in modules.import_bindings(frame).collect()] == [("./c", "C")]
    assert [r.name for r in modules.symbols(frame).collect()] == ["E"]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_places_and_running_sums(spark, keys):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]) if rng.random() < 0.7 else "hot", rng.randrange(40) if rng.random() < 0.9 else None, rng.randrange(-5, 9)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v int, w int").repartition(7)
    got = ordered.placed(frame, ["v"], keys, F.col("w")).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r.k if keys else None, []).append(r)
    assert sum(map(len, groups.values())) == len(rows)
    for own in groups.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert [(r.v is not None, r.v) for r in own] == sorted((r.v is not None, r.v) for r in own)
        total = 0
        for r in own:
            total += r.w
            assert r.running == total
    assert ordered.placed(frame.where(F.lit(False)), ["v"], keys).collect() == []


def test_no_place_passes_one_task(spark):
    frame = spark.range(1000).withColumn("v", F.col("id") % 7)
    plan = ordered.placed(frame, ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def plain_impact(nodes, edges, origins, depth, states, examinations):
    """One origin after the other, step by step over the nodes of the least distance."""
    file, incoming, out = dict(nodes), {}, {}
    for s, d, r in sorted(set(edges), key=lambda e: (e[1], e[0], e[2])):
        incoming.setdefault(d, []).append(s)
    used_s = used_e = 0
    for name in sorted(origins):
        own = sorted(i for i, f in nodes if f == name)
        if not own:
            out[name] = ("partial", "not_evaluated", "source_unavailable", 0, 0, {})
            continue
        admitted = own[: states - used_s]
        work = len(admitted) < len(own)
        used_s += len(admitted)
        best, done, observed, over, files, n = dict.fromkeys(admitted, 0), set(), set(admitted), {}, {}, 0
        level, stop = 0, False
        while level <= depth and not stop:
            todo = sorted(i for i, d in best.items() if d == level and i not in done)
            if not todo:
                level += 1
                continue
            for i in todo:
                done.add(i)
                for c in incoming.get(i, []):
                    if used_e >= examinations:
                        work = stop = True
                        break
                    used_e, n = used_e + 1, n + 1
                    d = level + (file[c] != file[i])
                    if d > depth:
                        over[c] = d
                        continue
                    observed.add(c)
                    if file[c] != name or d == 0:
                        files[file[c]] = min(files.get(file[c], d), d)
                    if c not in best:
                        if used_s >= states:
                            work = True
                            continue
                        used_s += 1
                        best[c] = d
                    elif d < best[c]:
                        best[c] = d
                if stop:
                    break
        reasons = ";".join(([budget.DEPTH_LIMIT] if set(over) - observed else []) + ([budget.WORK_LIMIT] if work else []))
        blocked = not admitted or (not n and used_e >= examinations and any(incoming.get(i) for i in own))
        finding = "evidence_found" if files else "not_evaluated" if blocked else "no_evidence_found"
        out[name] = ("partial" if reasons else "available", finding, reasons, len(best), n, files)
    return out


@pytest.mark.parametrize("depth, states, examinations", [(2, 2000, 16000), (1, 2000, 16000), (3, 12, 16000), (2, 2000, 25), (2, 14, 40), (0, 3, 5), (5, 1, 1)])
def test_budgets_are_spent_in_order(spark, depth, states, examinations):
    rng = random.Random(depth * 100 + states)
    nodes = [(i, f"f{i % 17}") for i in range(60)]
    edges = list({(rng.randrange(60), rng.randrange(60), rng.choice("ab")) for _ in range(110)})
    origins = ["f3", "f1", "f9", "gone"]
    frames = spark.createDataFrame(nodes, "id long, file string"), spark.createDataFrame(edges, "src long, dst long, relation string")
    asked = spark.createDataFrame([(o, o) for o in origins], "origin string, file string")
    answers, kept = budget.budgeted(*frames, asked, depth, states, examinations)
    files: dict = {}
    for r in kept.collect():
        files.setdefault(r.origin, {})[r.file] = r.distance
    got = {r.origin: (r.status, r.finding, r.reasons, r.states, r.edges, files.get(r.origin, {})) for r in answers.collect()}
    assert got == plain_impact(nodes, edges, origins, depth, states, examinations)


def test_a_chain_longer_than_the_depth_is_partial(spark):
    nodes = spark.createDataFrame([(i, f"f{i}") for i in range(5)], "id long, file string")
    edges = spark.createDataFrame([(i + 1, i, "imports") for i in range(4)], "src long, dst long, relation string")
    one = spark.createDataFrame([("f0", "f0")], "origin string, file string")
    status = lambda depth: tuple(budget.budgeted(nodes, edges, one, depth)[0].select("status", "reasons").first())
    assert status(2) == ("partial", "depth_limit") and status(4) == ("available", "")




def test_import_sites_and_located_edges(spark):
    texts = {
        "src/a.ts": "// import {no} from './b'\r\n/* x */ import { b } from './b';\nexport * from './c'\n\U0001f600; export { z } from \"./lost\";\n", "src/b.ts": "import c from\n  './c';", "src/c.ts": "",
        "src/d.md": "import { b } from './b'"
    }
    sites = {(r.path, r.specifier, r["at"]) for r in modules.import_sites(files(spark, texts)).collect()}
    assert sites == {("src/a.ts", s, texts["src/a.ts"].rindex(s)) for s in ("./b", "./c", "./lost")} | {("src/b.ts", "./c", texts["src/b.ts"].index("./c"))}
    edges = {(r.src, r.dst, r.location.line, r.location.column) for r in modules.located_edges(files(spark, texts)).collect()}
    assert edges == {("src/a.ts", "src/b.ts", 2, 28), ("src/a.ts", "src/c.ts", 3, 16), ("src/b.ts", "src/c.ts", 2, 4)}


EDGE = "src string, dst string, relation string, location struct<path:string,line:bigint,column:bigint>"


def test_witnesses_carry_the_least_location(spark):
    place = lambda line: {"path": "x/\u00e9\"q.ts", "line": line, "column": 2}
    rows = [("a", "b", "imports", place(9)), ("a", "b", "imports", place(3)), ("a", "b", "uses", place(1)), ("c", "b", "calls", None)]
    edges = spark.createDataFrame(rows, EDGE)
    found = spark.createDataFrame([("o", "f/a.ts", 1, "a", "b"), ("o", "f/c.ts", 1, "c", "b")], "origin string, file string, distance int, witness_src string, witness_dst string")
    got = {r.file: r for r in impact.with_witnesses(found, None, edges, "s\"n", "p", "2", "external").collect()}
    for file, (src, dst, relation, location), source, basis in (("f/a.ts", rows[1], "x/\u00e9\"q.ts", "structural"), ("f/c.ts", rows[3], "f/c.ts", "semantic")):
        edge = {"from": src, "to": dst, "relation": relation, "location": location}
        text = json.dumps(["s\"n", "p", "2", edge], ensure_ascii=False, separators=(",", ":"))
        r = got[file]
        assert r.witness == "impact_edge_" + hashlib.sha256(text.encode()).hexdigest()
        assert (r.source, r.basis, r.trust) == (source, basis, "untrusted_external_analysis")


@pytest.mark.parametrize("line, column, sound", [(1, 1, True), (1, 5, True), (1, 6, False), (2, 1, True), (2, 2, False), (3, 3, True), (3, 4, False), (4, 1, False), (0, 1, False), (1, 0, False)])
def test_locations_lie_in_the_text(spark, line, column, sound):
    edges = spark.createDataFrame([("a", "b", "imports", {"path": "f", "line": line, "column": column}), ("a", "b", "uses", None)], EDGE)
    assert impact.unsound_locations(edges, files(spark, {"f": "ab\U0001f600\r\n\nxy", "g": ""})).count() == (0 if sound else 1)


def test_unknown_files_hold_no_location(spark):
    edges = spark.createDataFrame([("a", "b", "imports", {"path": "h", "line": 1, "column": 1})], EDGE)
    assert impact.unsound_locations(edges, files(spark, {"f": "a"})).count() == 1


def test_provider_tokens(spark):
    names = ["b.ts", "\uffee.ts", "\U0001f600.ts", "a\"b.ts"]
    rows = [("p", n, f"h{i}") for i, n in enumerate(names)] + [("q", "x", "1"), ("q", "x", "2")] + [("big", f"f{i}", "h") for i in range(6)]
    projects = spark.createDataFrame([("p", "unborn"), ("q", None), ("big", None), ("none", None)], "project string, status string")
    got = {r.project: (r.files, r.token) for r in extract.provider_tokens(spark.createDataFrame(rows, "project string, path string, sha256 string"), projects, 5).collect()}

    def token(project, status, pairs):
        revision = dict.fromkeys(("status", "commitSha", "branch", "repositoryId", "worktreeId", "dirty", "isGit", "isLinkedWorktree")) | {"status": status}
        return hashlib.sha256(json.dumps([project, revision, pairs], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    in_order = sorted(([n, f"h{i}"] for i, n in enumerate(names)), key=lambda p: p[0].encode("utf-16-be"))
    assert got == {"p": (4, token("p", "unborn", in_order)), "q": (2, None), "big": (6, None), "none": (0, token("none", None, []))}


def test_declared_semantics(spark):
    kinds = ["public_signature", "interface_contract", "schema_migration", "local_implementation", "documentation", "test_only", "unknown", None]
    paths = {"documentation": ["a.md", "b.txt"], "test_only": ["tests/a.ts"], "unknown": ["a.mdx"], "": []}
    tasks = [(f"{kind}/{of}", kind) for kind in kinds for of in paths]
    rows = [(t, p) for t, _ in tasks for p in paths[t.split("/")[1]]]
    got = scope.resolved_semantics(spark.createDataFrame(tasks, "task string, declared string"), spark.createDataFrame(rows, "task string, path string"), "task").collect()
    assert len(got) == len(tasks)
    for r in got:
        inferred = r.task.split("/")[1] or "unknown"
        stands = r.declared in kinds[:3] + ["unknown"] or (r.declared, inferred) == ("local_implementation", "unknown") or r.declared == inferred
        want = (inferred, "path_inference", "") if r.declared is None else (r.declared if stands else "unknown", "task_declaration", "" if stands else "declaration_path_disagreement")
        assert r.inferred == inferred and (r.effective, r.provenance, r.reasons) == want
