"""Name keys: published vectors, the digest of the whole model table, and a plain version over made-up names."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidentia.functions import names

#: (name, key, what the file-system model compares)
VECTORS = [
    ("\u1fb3\u0301", "\u03b1\u0301\u03b9", "\u03b1\u03b9\u0301"), ("\u03b1\u0345\u0301", "\u03b1\u0301\u03b9", "\u03b1\u03b9\u0301"), ("\u03b1\u03af", "\u03b1\u03b9\u0301", "\u03b1\u03b9\u0301"),
    ("\u0345\u0308", "\u0308\u03b9", "\u03b9\u0308"), ("\u03ca", "\u03b9\u0308", "\u03b9\u0308"), ("\u1fb4", "\u03b1\u0301\u03b9", "\u03b1\u0301\u03b9"), ("ABba", "abba", "abba"), ("\u00df", "ss", "ss"),
    ("\u00c5", "a\u030a", "a\u030a"), ("\uab70", "\u13a0", "\u13a0"), ("\u13f8", "\u13f0", "\u13f0"), ("\U00010c83", "\U00010cc3", "\U00010cc3"), ("\U000104b5", "\U000104dd", "\U000104dd"),
    ("\ua7ae", "\u026a", "\u026a"), ("\u1c90", "\u10d0", "\u10d0"), ("\u0301\u0898\u0300", "\u0301\u0898\u0300", "\u0301\u0898\u0300"), ("\U0001fae8", "\U0001fae8", "\U0001fae8"),
    ("\ua7ce", "\ua7cf", "\ua7ce"), ("", "", ""), (" .", "", " ."), (None, None, None)
]
#: sha256 of the model's listing: every character's code point, a tab, and what it becomes, in hexadecimal.
LISTING = "35428a6864b7ee7c3b842135f952c9163b68d4e7238f26149ff26d2b2061c97a"


def test_vectors(spark):
    rows = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, name string")
    found = rows.select("i", names.name_key(F.col("name")), names.model_characters(F.col("name"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [v[1:] for v in VECTORS]


def test_model_listing(spark):
    lines = names.characters(spark).select("code_point", names.model_characters(F.col("char")).alias("m")).orderBy("code_point").toPandas()
    digest = hashlib.sha256()
    for code, m in zip(lines["code_point"], lines["m"], strict=True):
        digest.update(f"{code:04X}\t{' '.join(f'{ord(c):04X}' for c in m)}\n".encode())
    assert digest.hexdigest() == LISTING


def plain_key(name: str) -> str:
    nfd = lambda s: unicodedata.normalize("NFD", s)
    folded = nfd(nfd(name).casefold()).replace("\u0131", "i").replace("\u0307", "")
    ranges = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), names.IGNORABLE)
    return nfd(re.sub("[ .]+\\Z", "", re.sub(ranges, "", folded)))


@pytest.mark.parametrize("seed", range(3))
def test_keys_of_made_up_names(spark, seed):
    draw = random.Random(seed)
    pieces = "aBz .-_\u0130\u0131\u0307\u0301\u0323\u0345\u00c9\u00e9\u1e9e\u00ad\u200d\ufe0f\u1fb3\uac00\u03a3\u03c2\u212b\U00010400"
    made = sorted({"".join(draw.choice(pieces) for _ in range(draw.randint(0, 8))) for _ in range(300)})
    rows = spark.createDataFrame([(n,) for n in made], "name string").select("name", names.name_key(F.col("name")).alias("k")).collect()
    assert {r.name: r.k for r in rows} == {n: plain_key(n) for n in made}


def test_collisions_run_in_the_jvm(spark):
    rows = spark.createDataFrame([("New.js",), ("new.js",), ("new.js.",), ("stra\u00dfe",), ("STRASSE",), ("other",), (None,), ("",), ("new.js",)], "name string")
    found = names.collisions(rows)
    assert {tuple(r) for r in found.collect()} == {(kind, key, n) for kind in ("full", "simple") for key, n in (("new.js", 3), ("strasse", 2))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_table_of_foldings(spark):
    rows = {r.code_point: (r.folded, r.simple) for r in names.folding_table(spark).where("code_point < 400").collect()}
    assert rows[ord("A")] == ("a", "a") and rows[ord("\u00df")] == ("ss", "ss") and ord("a") not in rows
