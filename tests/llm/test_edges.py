"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import decontaminate, lm, packing, quality_classifier, quality_rules, simhash, suffixes, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, w string, h long, block long, key string, score double, host string, path string, kept boolean, count long, packed string, range long"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    long_text = "one two three four five six seven eight nine ten " * 6000
    texts = [
        None, "", " \n\t ", "word", long_text, "Some plain words that come twice.\n" * 3, "some plain words that come twice.", "é" * 60, "x" * 300,
        "idiot " * 60, "a b c\n\n a b c", "\x1c\x1d odd <|endoftext|> text   here"
    ]
    made = [(n, t, None if n == 3 else "en", None if n == 4 else "src", 1, None, "w", 5, 6, "k", 0.5, "host", None, True, 7, "p", 8) for n, t in enumerate(texts)]
    return made + [made[5], made[5], (None, None, *made[0][2:]), (None, "text without an id " * 20, *made[0][2:])]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 0), (5, 0, 0), (9, 0, 1), (None, 1, 1), (6, None, None), (5, 1, None), (9, 0, 1)], LABELS)
    bench = spark.createDataFrame(
        [
            (1, "some plain words that come twice.", "x"), (2, None, "y"), (3, "", "z"), (None, "word", "q"), (4, "word", "r"),
            (1, "some plain words that come twice.", "x")
        ],
        "item_id long, text string, doc_id string"
    )
    pages = spark.createDataFrame(
        [
            (1, "http://a.b/c", "x" * 2000), (2, None, "x" * 2000), (3, "no url \n at all", None), (4, "http://A.b/c?d#e", ""),
            (4, "http://A.b/c?d#e", ""), (5, "", "x" * 2000), (5, "", "x" * 2000), (None, "http://null/", "x" * 2000), (None, None, "lonely " * 300),
            (None, None, "lonely " * 300)
        ],
        "page_id long, url string, html string"
    ).withColumn("digest", F.lit("clash"))
    return {"docs": docs, "labels": labels, "bench": bench, "pages": pages}


OPERATORS = {
    "leaks": lambda t: decontaminate.leaks(t["docs"], t["bench"]),
    "judged": lambda t: quality_rules.judged(t["docs"], t["labels"]),
    "toxicity": lambda t: toxicity.toxicity(t["docs"], t["labels"]),
    "repeated_passages": lambda t: suffixes.repeated_passages(t["docs"]),
    "near_duplicates": lambda t: simhash.near_duplicates(t["docs"]),
    "quality": lambda t: quality_classifier.scored(t["docs"], t["labels"]),
    "pack": lambda t: packing.pack(t["docs"]),
    "lm": lambda t: lm.scored(t["docs"], rounds=1),
    "archive": lambda t: warc.archive_pages(t["pages"]),
    "tokens": lambda t: tokens.token_counts(t["docs"]),
}
PER_ROW = {"judged", "toxicity", "repeated_passages", "near_duplicates", "quality", "lm", "tokens"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(tables, name):
    got = OPERATORS[name](tables).collect()
    if name in PER_ROW:
        assert len(got) == len(rows())
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in rows() if r[0] is not None)
    elif name == "leaks":
        assert {(r.doc_id, r.item_id) for r in got} == {(3, 4), (5, 1), (6, 1)}
    elif name == "archive":
        assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes and r.page_id) == [
            (1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (5, "response", None)
        ]
        assert sorted((r.record_type, r.refers_to or 0) for r in got if r.page_id is None) == [("response", 0), ("response", 0), ("revisit", 5)]
        assert len(got) == 10


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(tables, name):
    none = {k: t.where(F.lit(False)) for k, t in tables.items()}
    assert OPERATORS[name](none).collect() == []
    if name in {"judged", "toxicity", "quality"}:  # rows, but nothing to learn from
        assert OPERATORS[name](tables | {"labels": none["labels"]}).count() == len(rows())
    if name == "leaks":
        assert OPERATORS[name](tables | {"bench": none["bench"]}).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, tables, tmp_path, number):
    for n, t in (("labels", "labels"), ("benchmark", "bench")):
        tables[t].write.parquet(f"{tmp_path}/{n}.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, tables["docs"], str(tmp_path))
    if number < 4:
        assert out.columns == tables["docs"].columns
    assert out.count() >= 5
    assert stage(spark, tables["docs"].where(F.lit(False)), str(tmp_path)).count() == 0


def test_whole_pipeline_on_odd_and_empty_tables(spark, tables, tmp_path):
    for folder, keep in (("odd", True), ("none", False)):
        for name, key in (("documents", "docs"), ("labels", "labels"), ("benchmark", "bench")):
            tables[key].where(F.lit(keep)).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} >= {4, 7, 8, 10} and all(0 < r.length <= 2048 for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
