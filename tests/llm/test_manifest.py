"""The Merkle manifest against a plain one, and what tampering does to it."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from evidentia.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, leaf string, place int, n int, run int, digest string"
SMALL = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fan):
    """Root, and for each node its siblings level by level as (before, after)."""
    steps, of, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(of):
            run = level[at // fan * fan : at // fan * fan + fan]
            steps[k].append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        level, of = [h(*level[k : k + fan]) for k in range(0, len(level), fan)], [at // fan for at in of]
    return level[0], steps


def plain(rows, fan=8):
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r[:5])), r))
    langs, trees = sorted(by, key=lambda x: (x is not None, (x or "").encode())), {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([x[2] for x in by[lang]], fan)
    root, upper = tree([trees[x][0] for x in langs], fan)
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for (_, _, leaf, r), steps in zip(by[lang], trees[lang][1], strict=True):
            shown = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                shown = h(*map(field, r[:4]), field(r[4].translate(SMALL)))
            for before, after in steps + above:
                shown = h(before, shown, after)
            out.append((r[0], leaf, trees[lang][0], root, h(*[b + a for b, a in steps + above]), shown, shown == root))
    return out


def compared(spark, rows, fan=8, parts=3):
    frame = spark.createDataFrame([(*r, "t", "l", 1, 2, 3, "d") for r in rows], SCHEMA).repartition(parts)
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r) for r in merkle.manifest(frame, fan).collect()), key=key)
    assert got == sorted(plain(rows, fan), key=key)
    return got


def documents(n):
    langs = [None, "en", "en", "en", "de", "é", ""]
    return [(k * 3 % n, "s" if k % 5 else None, langs[k % 7] if k % 50 else f"l{k}", k if k % 4 else None, None if k % 11 == 0 else "" if k % 13 == 0 else f"Some Text {k} É") for k in range(n)]


@pytest.mark.parametrize("n, fan", [(1, 8), (2, 8), (9, 8), (64, 8), (65, 8), (700, 8), (200, 2), (200, 3)])
def test_manifest_is_the_plain_one(spark, n, fan):
    got = compared(spark, documents(n), fan)
    if n == 700:
        assert {r[-1] for r in got} == {True, False}


def test_repeated_rows_ids_and_missing_ids(spark):
    same = (5, "s", "en", 1, "The Same")
    rows = [same] * 40 + [(5, "s", "en", 1, f"Other {k}") for k in range(12)] + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 1, "No Id"), (6, "s", "en", 1, "x" * 300_000)]
    compared(spark, rows)
    compared(spark, [same])


def test_one_language_and_no_rows(spark):
    compared(spark, [(k, "s", "en", 1, f"T{k}") for k in range(30)])
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(docs).collect() == []
    assert merkle.manifest(docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_changed_document_changes_the_root(spark):
    rows = documents(40)
    one = compared(spark, rows)[0][3]
    rows[7] = (*rows[7][:4], "changed")
    assert compared(spark, rows)[0][3] != one


def test_nothing_passes_one_task(spark):
    frame = spark.createDataFrame([(*r, "t", "l", 1, 2, 3, "d") for r in documents(100)], SCHEMA).withColumn("lang", F.lit("en"))
    assert "SinglePartition" not in merkle.manifest(frame)._jdf.queryExecution().executedPlan().toString()
