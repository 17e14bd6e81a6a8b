"""The near-duplicate stage against all pairs of texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import near_copies, simhash


def grams(text, size=5):
    words = text.lower().encode().split()
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def groups(texts):
    """For each id the smallest one that it is connected with by pairs of a similarity of 0.8 and more."""
    sets = {d: grams(t) for d, t in texts.items()}
    label = {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((label[a], label[b]))
                label = {d: low if k == high else k for d, k in label.items()}
    return label


def varied(seed=5):
    """Texts of 8 bases and their copies at similarities around 0.8, a chain of copies of copies, copies in other letters, and texts of a few words."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(10**6))
    texts = []
    for base in ([word() for _ in range(rng.randint(40, 300))] for _ in range(8)):
        texts.append(" ".join(base))
        for _ in range(25):
            copy = list(base)
            for k in rng.sample(range(len(base)), max(1, rng.randint(1, len(base) // 25))):
                copy[k] = word()
            texts.append("\n".join(copy))
        texts.append("  ".join(base).upper())
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain[rng.randrange(200)] = word()
        chain[rng.randrange(200)] = word()
        texts.append(" ".join(chain))
    texts += ["", " \n", "a b c", "A b  c", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g x"]
    rng.shuffle(texts)
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("group_bytes, levels", [(near_copies.GROUP_BYTES, 2), (6000, 1), (6000, 0)])
def test_groups_are_those_of_all_pairs(spark, group_bytes, levels):
    texts = varied()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame, group_bytes=group_bytes, levels=levels).collect()}
    assert got == groups(texts)


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == groups({r.doc_id: r.text or "" for r in docs.collect()})


def test_stage_finds_copies_beyond_four_bits(spark):
    texts = varied()
    want = groups(texts)
    fps = {d: simhash.fingerprint(t) for d, t in texts.items()}
    assert any((fps[d] ^ fps[k]) % 2**64 and ((fps[d] ^ fps[k]) % 2**64).bit_count() > 4 for d, k in want.items())
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == set(want.values())


def test_stage_takes_candidates_from_simhash(spark):
    """Without bands, what is within four bits is found all the same, and only if the sets agree."""
    body = [f"w{k}" for k in range(400)]
    texts = {1: " ".join(body), 2: " ".join([*body[:-1], "other"]), 3: " ".join(f"v{k}" for k in range(300)), 4: "a " * 200 + "b c d e f g h", 5: "a " * 200 + "i j k l m n o"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4} and groups(texts) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    sketched = near_copies.sketches(frame).withColumn("bands", F.array().cast("array<long>"))
    links = near_copies.similar_links(frame, near_copies.written(sketched, "sketches")).collect()
    names = {near_copies.name_of(near_copies.shingle_set(texts[d])) for d in (1, 2)}
    assert [{r.a, r.b} for r in links] == [names]


def test_sets_at_the_threshold():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 6, 7])]
    assert near_copies.forest(np.arange(3), sets) == [(1, 0)]


def crowd(seed=9, texts=160):
    """Texts that share a bucket without being near copies: half of each is the same in all; a few are near copies of others."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(10**6))
    common, rows = [f"c{k}" for k in range(400)], []
    for k in range(texts):
        own = [word() for _ in range(130)]
        rows.append(common + own)
        if k % 9 == 0:
            near = list(own)
            near[rng.randrange(130)] = word()
            rows.append(common + near)
    return {n: " ".join(r) for n, r in enumerate(rows, 1)}


@pytest.mark.parametrize("group_bytes, levels", [(near_copies.GROUP_BYTES, 2), (40_000, 2), (40_000, 0)])
def test_crowded_buckets_lose_and_invent_no_link(spark, group_bytes, levels):
    texts = crowd()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame, group_bytes=group_bytes, levels=levels).collect()}
    assert got == groups(texts)


def test_a_long_chain_takes_a_bounded_number_of_jobs(spark):
    """2,000 drifting texts, each near the next one only: one group, in no more jobs than a fixed number and the logarithm of the chain."""
    rng = random.Random(1)
    text, texts = [f"w{k}" for k in range(120)], {}
    for n in range(1, 2001):  # as long as a fixed number of rounds would never reach
        texts[n] = " ".join(text)
        text = text[1:] + [f"n{n}"] if n % 2 else [*text[:60], f"m{n}", *text[61:]]
        rng.random()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    spark.sparkContext.setJobGroup("chain", "near copies of a chain")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    sets = {d: grams(t) for d, t in texts.items()}
    want, first = {}, 1
    for d in texts:  # neighbours only are near
        if d > 1 and 5 * len(sets[d] & sets[d - 1]) < 4 * len(sets[d] | sets[d - 1]):
            first = d
        want[d] = first
    assert got == want and jobs < 400


def test_ids_that_repeat_with_other_texts(spark):
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(30)) for c in "abcd")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, four), (4, four), (4, four + " "), (5, two), (6, ""), (6, " "), (None, three), (None, three)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert sorted((r.doc_id, r.text.strip()) for r in got if r.doc_id is not None) == [(1, one), (2, two), (3, three), (3, four), (6, "")]
    assert sum(r.doc_id is None for r in got) == 2
