"""Pattern sets, aliases, closures, excerpts and the keyed store, each against a plain version."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import aliases, excerpts, extract, graph, patterns, search
from evidentia.streaming import store, usage

#: (pattern, paths that it matches, paths that it does not)
GLOBS = [
    ("src/**", ["src", "src/a.ts", "src/b/c.ts"], ["src/.hidden/a.ts", "srcx", "src/a/.b"]), ("src/[ab]*.ts", ["src/a.ts", "src/bx.ts"], ["src/c.ts", "src/a/b.ts"]),
    ("**/7?.md", ["77.md", "q/r/7x.md"], [".77.md", "7.md", ".q/77.md"]), ("**", ["a", "a/b"], [".a", "a/.b"]), ("a/**/b", ["a/b", "a/x/y/b"], ["a/.x/b", "ab"]),
    ("a/**/**/b", ["a/b", "a/x/b"], ["a"]), ("src/[!a]*", ["src/bx"], ["src/ab", "src/.b"]), (r"x\*y", ["x*y"], ["xzy"]), ("[open", ["[open"], ["o"]), ("a**b/c", ["ab/c", "aqb/c"], ["a/b/c"]),
    (".hid*/*", [".hidden/f"], [".hidden/.f"]), ("**/.git/**", [".git/z", "q/.git/c"], ["q/.git/.c", "git/c"]), ("lit[[]x", ["lit[x"], ["litx"]), ("[a-c]?/z", ["b1/z"], ["d1/z", "b/z"]),
    ("we.ird$(x)", ["we.ird$(x)"], ["weXird$(x)"]), ("?", ["z", "é"], [".", "zz"]), ("{a,b}", ["{a,b}"], ["a"]), ("!x", ["!x"], ["y"]), ("#x", ["#x"], ["x"]),
]


def test_every_rule_of_globs(spark):
    paths = sorted({p for _, yes, no in GLOBS for p in (*yes, *no)})
    got = {(r.path, r.pattern) for r in patterns.matches(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g,) for g, _, _ in GLOBS], "pattern string")).collect()}
    for glob, yes, no in GLOBS:
        assert all((p, glob) in got for p in yes) and not any((p, glob) in got for p in no), glob
    assert got == {(p, g) for g, _, _ in GLOBS for p in paths if re.match(search.glob_regex(g), p)}


def test_ten_thousand_patterns_are_one_plan(spark):
    globs = [f"w{k % 100}/{k}/**" if k % 2 else f"w{k % 100}/*{k}.ts" for k in range(10_000)]
    paths = [(f"w{k % 100}/{k}/a/b.ts",) for k in range(0, 10_000, 7)] + [(f"w{k % 100}/x{k}.ts",) for k in range(0, 10_000, 7)]
    got = {(r.path, r.pattern) for r in patterns.matches(spark.createDataFrame(paths, "path string"), spark.createDataFrame([(g,) for g in globs], "pattern string")).collect()}
    want = {(f"w{k % 100}/{k}/a/b.ts", f"w{k % 100}/{k}/**") for k in range(0, 10_000, 7) if k % 2}
    for k in range(0, 10_000, 7):
        want |= {(f"w{k % 100}/x{k}.ts", f"w{j % 100}/*{j}.ts") for j in range(k % 100, 10_000, 100) if j % 2 == 0 and str(k).endswith(str(j))}
    assert got == want


def test_scopes_of_many_workspaces(spark):
    spaces = [("w1", "src", ["src/**", "doc/*.md"], ["src/gen/**"]), ("w2", "lib", [], ["**/*.tmp"]), ("w3", ".", None, None), ("w4", "", [], ["src/**"])]
    paths = ["src/a.ts", "src/gen/b.ts", "doc/x.md", "doc/d/y.md", "lib/z", "lib/q.tmp", "lib", "README.md", ".env"]
    frame = spark.createDataFrame(spaces, "id string, folder string, include array<string>, exclude array<string>")
    got: dict = {}
    for r in patterns.scopes(spark.createDataFrame([(p,) for p in paths], "path string"), frame).collect():
        got.setdefault(r.workspace, set()).add(r.path)
    assert got == {"w1": {"src/a.ts", "doc/x.md"}, "w2": {"lib/z", "lib"}, "w3": set(paths), "w4": set(paths) - {"src/a.ts", "src/gen/b.ts"}}


def test_aliases_and_what_configurations_extend(spark):
    base = {"compilerOptions": {"baseUrl": "./lib", "paths": {"@a/*": ["a/*", "b/*"], "@a/deep/*": ["deep/*"], "exact": ["one.ts"], "*.css": ["styles/*.css"], "two*stars*": ["x"]}}}
    configs = {
        "base.json": "// what all share\n" + json.dumps(base)[:-1] + ', /* "x": 1 */ }', "tsconfig.json": '{"extends": "./base", "compilerOptions": {"target": "a//b",}}',
        "p/tsconfig.json": '{"extends": "../base.json", "compilerOptions": {"paths": {"@own/*": ["./own/*"]}}}', "c/one.json": '{"extends": "./two"}', "c/two.json": '{"extends": "./one"}',
        "lost.json": '{"extends": "./nowhere"}', "bad.json": "not json",
    }
    found = aliases.configurations(spark.createDataFrame(list(configs.items()), "path string, text string"))
    rows = {r.path: r for r in found.collect()}
    assert {p for p, r in rows.items() if r.issue} == {"c/one.json", "c/two.json", "lost.json", "bad.json"}
    assert rows["tsconfig.json"].base == "lib" and rows["tsconfig.json"].paths_base == "lib" and set(rows["tsconfig.json"].paths) == set(base["compilerOptions"]["paths"])
    assert rows["p/tsconfig.json"].base == "lib" and rows["p/tsconfig.json"].paths_base == "p" and set(rows["p/tsconfig.json"].paths) == {"@own/*"}
    there = ["lib/a/x.ts", "lib/b/y/index.tsx", "lib/b/x.ts", "lib/deep/z.js", "lib/a/deep/q.ts", "lib/one.ts", "lib/styles/m.css", "lib/plain.ts", "p/own/o.ts", "lib/own/o.ts"]
    asked = [("tsconfig.json", s) for s in ("@a/x", "@a/y", "@a/deep/z", "@a/deep/q", "exact", "exactly", "m.css", "plain", "@a/none", "react", "./rel", "@a", ".css")] + [("p/tsconfig.json", "@own/o"), ("p/tsconfig.json", "@a/x")]
    imports = spark.createDataFrame([(c, "src/f.ts", s) for c, s in asked], "config string, path string, specifier string")
    got = {(r.config, r.specifier): r.target for r in aliases.resolved(imports, spark.createDataFrame([(p,) for p in there], "path string"), found).collect()}
    one = "tsconfig.json"
    assert got == {
        (one, "@a/x"): "lib/a/x.ts", (one, "@a/y"): "lib/b/y/index.tsx", (one, "@a/deep/z"): "lib/deep/z.js", (one, "@a/deep/q"): None, (one, "exact"): "lib/one.ts", (one, "exactly"): None,
        (one, "m.css"): "lib/styles/m.css", (one, "plain"): "lib/plain.ts", (one, "@a/none"): None, (one, "react"): None, (one, "@a"): None, ("p/tsconfig.json", "@own/o"): "p/own/o.ts",
        ("p/tsconfig.json", "@a/x"): None,
    }


def test_specifiers_that_begin_with_a_slash(spark):
    files = spark.createDataFrame([("src/a/f.ts",), ("src/a/lib/x.ts",)], "path string")
    asked = spark.createDataFrame([("src/a/f.ts", "/lib/x"), ("src/a/f.ts", "/none"), ("src/a/f.ts", "lib/x")], "path string, specifier string")
    assert {r.specifier: r.target for r in extract.resolved(asked, files).collect()} == {"/lib/x": "src/a/lib/x.ts", "/none": None, "lib/x": None}


def importers(edges, target):
    reached, grown = {target}, True
    while grown:
        more = {s for s, d in edges if d in reached} - reached
        reached, grown = reached | more, bool(more)
    return reached - {target}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_without_a_depth(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(70)} | {(100 + k + 1, 100 + k) for k in range(300)} | {(100, 7), (5, 400), (500, 501), (501, 502), (502, 500), (503, 500), (9, 9)}
    aims = [7, 0, 150, 33]
    got: dict = {a: set() for a in aims}
    frame = spark.createDataFrame(list(edges), "src long, dst long")
    for r in graph.reachable_importers(frame, spark.createDataFrame([(a, a) for a in aims], "target long, id long")).collect():
        got[r.target].add(r.id)
    assert got == {a: importers(edges, a) for a in aims}


def plain_windows(text):
    lines, out = re.split("\r?\n", text), []
    for b in range(0, len(lines), 12):
        part: list = []
        for n, line in enumerate(lines[b : b + 12], b + 1):
            if part and len("\n".join(x for _, x in [*part, (n, line)]).encode()) > 512:
                out.append(part)
                part = []
            part.append((n, line))
        out.append(part)
    return [(k, p[0][0], p[-1][0], "\n".join(x for _, x in p)) for k, p in enumerate(out, 1)]


def test_windows_are_whole_files(spark):
    rng = random.Random(4)
    texts = {f"f{k}": "".join(rng.choice(["é" * rng.randrange(90), "word " * rng.randrange(30), "", "x" * 700]) + rng.choice(["\n", "\r\n"]) for _ in range(rng.randrange(60))) for k in range(12)}
    got: dict = {}
    for r in excerpts.windows(spark.createDataFrame(list(texts.items()), "path string, text string")).collect():
        got.setdefault(r.path, []).append((r.part, r.start_line, r.end_line, r.text))
    assert {p: sorted(x) for p, x in got.items()} == {p: plain_windows(t) for p, t in texts.items()}


def test_excerpts_share_a_budget(spark):
    make = lambda name, n: spark.createDataFrame([(f"{name}{k:02}", f"line {k}\n" * 20) for k in range(n)], "path string, text string")
    rows = sorted(excerpts.sectioned({"documents": make("d", 5), "files": make("a", 30)}, 1000).collect(), key=lambda r: r.place)
    assert [r.section for r in rows[:5]] == ["documents"] * 5 and rows[-1].running <= 1000 < rows[-1].running + 95
    assert all(r.end_line == 12 and r.truncated and r.text == "\n".join([r.text.split("\n")[0]] * 12) for r in rows)


def test_constraints_are_declared_only(spark):
    rows = [("a", {"read": True, "write": None, "fly": True, "createAgents": False}, ["z", "a", "a", "Bad", "x" * 101]), ("b", None, None), ("c", {}, [f"p{k:03}" for k in range(101)])]
    got = {r.id: (r.permissions, r.preconditions, r.truncated, r.refused) for r in excerpts.constraints(spark.createDataFrame(rows, "id string, permissions map<string,boolean>, preconditions array<string>")).collect()}
    assert got == {"a": ({"read": True, "createAgents": False}, ["a", "z"], False, False), "b": ({}, [], False, False), "c": ({}, [f"p{k:03}" for k in range(8)], True, True)}


def heads(spark, rows):
    return spark.createDataFrame(rows, "task long, watermark long, rows_hash string")


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.startswith("part"))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """Twice the heads, the same batch: the bytes written stay as they are."""
    written = []
    for n in (20_000, 40_000):
        kept = store.Store(spark, f"file://{tmp_path}/{n}", buckets=n // 500)
        kept.advance(heads(spark, [(t, 1, f"h{t}") for t in range(n)]), 0)
        before = size(f"{tmp_path}/{n}/heads")
        touched = kept.advance(heads(spark, [(5, 2, "new"), (6, 2, "new")]), 1)
        assert 1 <= len(touched) <= 2 and kept.heads().count() == n
        assert {(r.watermark, r.rows_hash) for r in kept.heads().where("task in (5, 6)").collect()} == {(2, "new")}
        written.append(size(f"{tmp_path}/{n}/heads") - before)
        assert kept.advance(heads(spark, [(5, 2, "new"), (7, 1, "h7"), (8, 0, "old")]), 2) == []  # nothing new
    assert written[1] < 1.5 * written[0]


def test_quarantine_and_repair(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    kept.advance(heads(spark, [(1, 5, "a"), (2, 5, "a"), (3, 5, "a")]), 0, "print1")
    assert kept.version()[1]["publication"] == "print1"
    assert kept.advance(heads(spark, [(1, 9, "never looked at")]), 1, "print1") == []
    kept.advance(heads(spark, [(1, 5, "b"), (2, 4, "z"), (3, 7, "c")]), 2, "print2")  # 1 diverges, 2 is older, 3 moves on
    assert kept.version()[1]["publication"] == ""  # a batch with a failure is not done with
    assert {(r.task, r.watermark, r.reason) for r in kept.pending().collect()} == {(1, 5, "divergent_task_history")}
    assert {(r.task, r.watermark) for r in kept.heads().collect()} == {(2, 5), (3, 7)}
    assert kept.repair(heads(spark, [(1, 4, "too old"), (2, 9, "not in quarantine")])) == []
    assert len(kept.repair(heads(spark, [(1, 6, "right")]))) == 1
    assert {(r.task, r.watermark, r.rows_hash) for r in kept.heads().collect()} == {(1, 6, "right"), (2, 5, "a"), (3, 7, "c")} and kept.pending().count() == 0
    kept.advance(heads(spark, [(1, 5, "b")]), 2)  # a batch that is repeated starts from what came before it
    assert {r.task for r in store.Store(spark, f"file://{tmp_path}/s", 4).pending().collect()} in ({1}, set())


def test_streams_continue_where_they_ended(spark, tmp_path):
    source = f"{tmp_path}/in"
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "a")], [(1, 2, "b")], [(2, 1, "x")]]):
        heads(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(store.HEADS).parquet(source)
        got, pending = usage.synchronise(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
        assert (got.count(), pending.count()) == [(2, 0), (2, 0), (1, 1)][n]


def test_ids_of_a_stream_are_forgotten(spark):
    events = spark.readStream.format("rate").load().withColumn("key", F.col("value").cast("string"))
    plan = usage.deduplicated_stream(events, "key", "key", 5000)._jdf.queryExecution().analyzed().toString()
    assert "ProcessingTimeTimeout" in plan
