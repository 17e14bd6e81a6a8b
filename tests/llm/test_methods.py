"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from decimal import Decimal, localcontext
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import bpe, decontaminate, exchange, lm, packing, quality_classifier, quality_rules, simhash, suffixes, tokens, toxicity, warc
from evidentia.llm.components import components

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aabbthe  \n\x1c\x85\xa0's<|>SΣςİéÉ̸२½ⅣⅧªß😀​中#1") + ["<|endoftext|>"]), max_size=60).map("".join))
def test_word_tokenizer_equals_library(text):
    got = bpe.word_tokenizer(bpe.default_vocabulary()).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids_of(text)


def test_overlapping_merges():
    words = ["a" * n for n in range(1, 60)] + ["ha" * 20, "lala" * 9]
    for word, ids in zip(words, bpe.word_tokenizer(bpe.default_vocabulary()).encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(word)


def test_token_counts(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()}
    assert got == {d: (len(t.encode()), n := len(ids_of(t)), n > 2048) for d, t in texts.items()}


def packed_ids(texts, pieces, capacity):
    """Every id lies in one piece, sequences have no gaps and the checksums hold."""
    seen, sequences = Counter(), {}
    for r in pieces:
        ids = [*ids_of(texts[r.doc_id]), 1]
        assert r.doc_tokens == len(ids)
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen.values()) == {1} and len(seen) == sum(len(ids_of(t)) + 1 for t in texts.values())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_round_trip(docs, texts):
    sequences = packed_ids(texts, packing.pack(docs).collect(), 2048)
    used = sum(length for parts in sequences.values() for _, length in parts)
    assert len(sequences) <= -(-used // 2048) + 8  # three partitions leave a few windows open


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_best_filling(counts, capacity):
    reach = {0}
    for size, n in counts.items():
        reach = {r + k * size for r in reach for k in range(n + 1)}
    got = packing.fill(counts, capacity)
    assert sum(s * k for s, k in got) == max(r for r in reach if r <= capacity)
    assert all(0 < k <= counts[s] for s, k in got)


def test_minimum_bin_slack_places_every_piece():
    lengths = np.array([random.Random(n).randint(1, 99) for n in range(500)])
    windows = list(packing.minimum_bin_slack(lengths, 100))
    assert sorted(k for w in windows for k in w) == list(range(500))
    assert all(lengths[w].sum() <= 100 for w in windows) and len(windows) <= lengths.sum() / 100 + 3


def removed(texts, depth=50):
    first, out = {}, {}
    for doc in sorted(texts):
        raw = texts[doc].encode()
        mask, own = np.zeros(len(raw), bool), set()
        for k in range(len(raw) - depth + 1):
            window = raw[k : k + depth]
            if window in first:
                mask[k : k + depth] = True
            else:
                own.add(window)
        first.update(dict.fromkeys(own, doc))
        spans = int(np.diff(np.r_[0, mask.astype(int)]).clip(0).sum())
        out[doc] = (len(raw), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes, range_bytes", [(1 << 22, 1 << 22), (20_000, 60_000)])
def test_repeated_passages(docs, texts, block_bytes, range_bytes):
    got = {r[0]: tuple(r[1:]) for r in suffixes.repeated_passages(docs, block_bytes, range_bytes).collect()}
    assert got == removed(texts)


def test_repeats_in_runs_and_periods(spark):
    data = {n: "ab" * (n + 20) + "x" * n + "tail %d " % n * 3 for n in range(60)} | {100: "x" * 49, 101: "x" * 50, 102: "x" * 400}
    frame = spark.createDataFrame(list(data.items()), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in suffixes.repeated_passages(frame, 500, 900).collect()}
    assert got == removed(data)


def test_relays_between_blocks_and_ranges(docs, texts):
    got = {r[0]: tuple(r[1:]) for r in suffixes.repeated_passages(docs, 20_000, 10_000, fan=4, relay_bytes=60_000).collect()}
    assert got == removed(texts)


def blocks_of(texts, size):
    ids = sorted(texts)
    for k in range(0, len(ids), size):
        raw = [texts[d].encode() for d in ids[k : k + size]]
        yield suffixes.Block(np.array(ids[k : k + size]), np.array([len(r) for r in raw]), zstandard.compress(b"".join(raw)))


def test_crowded_anchors_are_dealt_by_suffix(texts, monkeypatch):
    """The two exchanges without Spark, where every shared anchor with two stretches counts as crowded."""
    monkeypatch.setattr(suffixes, "HOT", 2)
    blocks = list(blocks_of(texts, 40))
    tables = [suffixes.Presence.of(*b.stretches()[3:])[0] for b in blocks]
    whole, table, place = suffixes.Presence.joined(tables)
    said = np.split(whole.told(table, place, table.settled()), np.cumsum([len(t.mark) for t in tables])[:-1])
    assert set(np.concatenate(said).tolist()) == {0, 2}
    tables = [suffixes.contexts_of(b, s)[0] for b, s in zip(blocks, said, strict=True)]
    whole, table, place = suffixes.Contexts.joined(tables)
    bits = np.split(whole.told(table, place, table.settled()), np.cumsum([len(t.mark) for t in tables])[:-1])
    got = {}
    for b, s, r in zip(blocks, said, bits, strict=True):
        got |= {doc: int(mask.sum()) for doc, _, mask in suffixes._each(b, suffixes._removed(b, s, r))}
    assert got == {d: r[1] for d, r in removed(texts).items()}


def test_anchors_are_dealt_evenly(texts):
    """An anchor's hash is the smallest of many; the leading bits that deal it must not show that."""
    mark = np.concatenate([np.unique(b.stretches()[3]) for b in blocks_of(texts, 1000)])
    sizes = np.bincount((mark >> np.uint64(60)).astype(int), minlength=16)
    assert len(mark) > 10_000 and sizes.max() < 1.2 * sizes.mean()


def shared_rows(sources=6, n_bytes=400_000):
    """The packed rows of blocks of random text, of which every third has a copy of the first block."""
    for k in range(sources):
        raw = np.random.default_rng(k if k % 3 else 0).integers(97, 123, n_bytes, dtype=np.uint8).tobytes()
        block = suffixes.Block(np.array([k]), np.array([n_bytes]), zstandard.compress(raw))
        said = np.full(len(np.unique(block.stretches()[3])), suffixes.SHARED, np.uint8)
        yield from exchange.dealt(suffixes.contexts_of(block, said)[0], k, 0, 0, 0)


def test_a_range_holds_its_rows_once(monkeypatch):
    """Beside its rows and the different ones of them, a range or relay holds no third copy, and each gives its memory back."""
    given = []
    monkeypatch.setattr(exchange, "give_back", lambda: given.append(1))
    rows = exchange.arrow_table(list(shared_rows()), exchange.PACKED)
    n = sum(rows.column("n").to_pylist())
    one = n * (suffixes.ROW + 18)
    for work in (exchange._range(suffixes.Contexts, ()), exchange._up(suffixes.Contexts, 8, 2)):
        table = rows.append_column("relay", pa.array([0] * rows.num_rows, pa.int64()))
        tracemalloc.start()
        out = work(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.num_rows and n > 100_000 and peak < 2.7 * one
    assert len(given) == 2


def test_packed_rows_grow_in_proportion():
    """A block sends at most FAN rows, a relay too, and there are as many relays of a level as the text needs."""
    for total in (1 << 30, 1 << 36, 1 << 46):
        levels = exchange.levels_of(total, suffixes.RANGE_BYTES, exchange.FAN)
        assert max(levels) <= 8 and total >> sum(levels) <= suffixes.RANGE_BYTES
    mark = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 100_000, dtype=np.uint64))
    table = suffixes.Presence(mark, np.ones(len(mark), np.uint16))
    assert len(exchange.dealt(table, 0, 0, 0, 8)) == 256


def test_digits_beyond_the_first_decide(texts):
    """Suffixes that differ in their last byte only, and anchors that differ in what comes before them."""
    body = "".join(random.Random(5).choices("abcdefgh ", k=60))
    data = {1: body, 2: body[:49] + "Z" + body[50:], 3: "Y" + body[1:], 4: body[:25] + "Q" + body[26:], 5: body}
    (block,) = blocks_of(data, 9)
    table = suffixes.Presence.of(*block.stretches()[3:])[0]
    said = table.settled()
    found = suffixes.contexts_of(block, said)[0]
    mask = suffixes._removed(block, said, found.told(*found.different(), found.different()[0].settled()))
    assert {d: int(m.sum()) for d, _, m in suffixes._each(block, mask)} == {d: r[1] for d, r in removed(data).items()}


def clusters(fps, distance=4):
    values = sorted(set(fps.values()))
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for d, f in fps.items():
        root = find(values.index(f))
        least[root] = min(least.get(root, d), d)
    return {d: least[find(values.index(f))] for d, f in fps.items()}


def slow_fingerprint(text, size=4):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(docs, texts):
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == clusters(fps)


def test_native_hash_is_the_same(spark, texts):
    text = next(t for t in texts.values() if t)
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_links_of_dense_keys_and_hot_keys(spark, monkeypatch):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)}
    fps = {n: f for n, f in enumerate(sorted(values))}
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps.values()], "fp long").repartition(4)
    want = clusters(fps)
    for hot in (20_000, 50):
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        got = {r.node % 2**64: r.root % 2**64 for r in components(simhash.near_links(frame, 4)).collect()}
        group = {f: got.get(f, f) for f in fps.values()}
        assert len(set(group.values())) == len(set(want.values()))
        assert all(group[fps[a]] == group[fps[want[a]]] for a in fps)


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(100, 160)] + [(500, n) for n in range(501, 540)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 100 for n in range(100, 161)}, **{n: 500 for n in range(500, 540)}}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_damaged_archive_is_refused():
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = squeeze.compress(warc.record(1, "http://a/", "1970-01-01T00:00:01Z", b"body", None)) + squeeze.flush()
    assert [r[3] for r in warc.records(data * 2)] == [b"body", b"body"]
    with pytest.raises(ValueError):
        list(warc.records(data + data[:-3]))


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10_000))
    got = warc.archive_pages(pages).collect()
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    last = {}
    for p, raw in rows.items():
        last[raw] = max(last.get(raw, p), p)
    want = {p: (
        len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if len(raw) >= 1000 and last[raw] != p else "response",
        last[raw] if len(raw) >= 1000 and last[raw] != p else None
    ) for p, raw in rows.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert [(r.url_key, r.warc_date, r.page_id) for r in got] == sorted((r.url_key, r.warc_date, r.page_id) for r in got)


def test_external_merge_of_many_runs(spark, sf_dir, tmp_path):
    """Merges in several levels and ranges give the order that sorting gives; URLs with many captures span ranges."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    hot = spark.range(3000).select((F.col("id") + 50_000).alias("page_id"), F.lit("http://hot.example/x y?Q").alias("url"), F.lit("").alias("html"))
    pages = pages.unionByName(hot).repartition(9)
    rows = pages.withColumns({"warc_date": F.lit("2020-01-01T00:00:00Z"), "refers_to": F.lit(None).cast("long")})
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(rows, folder)
    blocks = warc.index_archives(spark, folder).cache()
    assert blocks.select("run").distinct().count() == 9
    got = warc.capture_histories(blocks, folder, ranges=7, fan_in=2).collect()
    want = sorted((warc.url_key(warc.header_text(r.url)).encode(), "2020-01-01T00:00:00Z", r.page_id) for r in pages.collect())
    assert [(r.url_key.encode(), r.warc_date, r.page_id) for r in got] == want
    assert len({warc.sort_key(tuple(r)) for r in got}) == len(want)


def same_rows(spark, sf_dir, frame, sql):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want, got = db.execute(sql).df(), frame.toPandas()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].round(9).astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_short_items_are_found_inside_long_documents(spark, sf_dir, tmp_path):
    """Items of one to four words, wherever they stand; brute force over all runs of words, and the operator's own SQL."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40)}"
    docs = [(n, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 17, 60])))) for n in range(60)] + [(60, "well the Secret answer is\tforty said nobody at all in these many words here"), (61, None), (62, "secret answer is")]
    items = [(1, "secret answer IS forty"), (2, "w1 w2"), (3, "w7"), (4, "w3 w4 w5"), (5, ""), (6, None), (7, " ".join(docs[55][1].split()[:6])), (8, "w9 w9 w9 w9")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.leaks(frame, bench).collect()}
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = set()
    for d, text in docs:
        for i, item in items:
            w, b = (text or "").lower().split(), (item or "").lower().split()
            own = grams(b, min(len(b), 5)) if b else set()
            shared = len(own & grams(w, min(len(b), 5))) if own else 0
            if shared and shared >= math.ceil(0.8 * len(own) - 1e-9):
                want.add((d, i, shared, len(own)))
    assert got == want and {d for d, i, *_ in got if i == 1} == {60}
    for name, df in (("documents", frame), ("benchmark", bench)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
    assert {tuple(r[:4]) for r in con.execute(decontaminate.oracle()).fetchall()} == want


def test_leaks_and_rules_equal_sql(spark, sf_dir, docs):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    same_rows(spark, sf_dir, decontaminate.leaks(docs, read("benchmark")), decontaminate.oracle())
    same_rows(spark, sf_dir, quality_rules.judged(docs, read("labels")), quality_rules.oracle())


def test_partial_passages_are_found_at_the_threshold(spark):
    words = [f"w{k}" for k in range(24)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")  # 20 shingles
    cut = lambda n: "before " + " ".join(words[:n]) + " after " + "filler " * 500
    frame = spark.createDataFrame([(n, cut(n)) for n in range(15, 25)], "doc_id long, text string")
    assert {r.doc_id: r.n_shared for r in decontaminate.leaks(frame, bench).collect()} == {n: n - 4 for n in range(20, 25)}


@pytest.mark.parametrize("k, n", [(0, 300), (1, 300), (3, 400), (12, 1000), (0, 1), (19, 1000), (20, 1000), (5000, 300_000), (19_991_000, 10**9), (19_900_000, 10**9)])
def test_binomial_tail(spark, k, n):
    got = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02)).first()[0]
    if k >= 0.02 * n:
        assert got == 1.0
    elif n <= 1000:
        p = Fraction(2, 100)
        exact = float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        assert exact * (1 - 1e-9) <= got <= exact * (1 + 1e-9)
    else:  # lgamma alone in 40 digits, then ratios down to nothing
        with localcontext() as at:
            at.prec = 40
            log_factorial = lambda m: (m + Decimal("0.5")) * m.ln() - m + Decimal("0.9189385332046727417803297364056176398614") + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
            big, few, p = Decimal(n), Decimal(k), Decimal("0.02")
            term = (log_factorial(big) - log_factorial(few) - log_factorial(big - few) + few * p.ln() + (big - few) * (1 - p).ln()).exp()
            exact, i = term, k
            while i and term > exact * Decimal("1e-20"):
                term *= Decimal(i) / (n - i + 1) * 49
                exact += term
                i -= 1
        assert got == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_together_reject_at_most_alpha(spark):
    """Rules that each reject 1.5 % of good texts, all different: together they reject more than may be."""
    rows = [(n, "x", 1, 100, 500, 60 if n % 200 < 3 else 0, 8 if 3 <= n % 200 < 6 else 0, 10, 0) for n in range(20_000)]
    frame = spark.createDataFrame(
        rows,
        "doc_id long, lang string, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
    )
    cuts = {r.rule: r.cutoff for r in quality_rules.thresholds(frame, "lang").collect()}
    over = sum(100 * r[5] / r[4] > cuts.get("symbols", 1e9) or 100 * r[6] / r[7] > cuts.get("dup_lines", 1e9) for r in rows)
    assert over <= 0.02 * len(rows) and "symbols" in cuts


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"fool": 3.0})
    assert g.matches("Such a fool. Nothing here") == {"plain": 3.0}
    assert g.matches("you are a fool") == g.matches("a fool, is what you are".replace(",", "")) == {"targeted": 3.0}
    assert g.matches("they are not a fool") == {"negated": 3.0}
    assert g.matches("she said he is a fool") == {"reported": 3.0}
    assert g.matches("she said he is not a fool") == {"reported": 3.0}
    assert g.matches("we kill you") == {"targeted": 3.0} and g.matches("we kill time") == {}
    assert g.score("you fool") > g.score("you are not a fool") > g.score("hello")


def test_composition_equals_the_cascade():
    """The heaviest path of the composed transducer weighs as much as the best of all ways through the five, one after the other."""
    factor = {"plain": 1.0, "targeted": 1.3, "negated": 0.35, "reported": 0.45}
    whole, parts = toxicity.clause_grammar(factor), toxicity.cascade(factor)

    def ways(t, symbols):
        """(what is written, weight for each symbol) of all accepting paths."""
        paths = [(t.start, (), ())]
        for symbol in symbols:
            paths = [(to, out + (o,), w + (v,)) for s, out, w in paths for o, v, to in t.read(s, symbol)]
        return {(out, w) for s, out, w in paths if s in t.finals}

    rng = random.Random(1)
    for _ in range(150):
        symbols = [(rng.choice(toxicity.CLASSES), rng.choice([0.5, 1.0, 3.0])) for _ in range(rng.randint(0, 6))]
        read = {(tuple(c for c, _ in symbols), (0.0,) * len(symbols))}
        for t in parts:
            read = {(o, tuple(map(sum, zip(w, v, strict=True)))) for out, w in read for o, v in ways(t, out)}
        best = max(sum(w * s for w, (_, s) in zip(ws, symbols, strict=True)) for _, ws in read)
        path = toxicity.best_path(whole, symbols)
        assert sum(factor.get(out, 0.0) * scale for out, scale in path) == pytest.approx(best)
        assert tuple(out for out, _ in path) in {out for out, _ in read}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got.collect())
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.01 * len(rows)


def test_quality_classifier_on_rows_not_fitted_on(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = quality_classifier.scored(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    assert len(rows) > 50 and sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def beta_strength(groups, prior):
    """The method of moments in numpy; groups: (good, n), prior: a mean for each."""
    good, n = np.array(groups, float).T
    keep = n > 0
    good, n, prior = good[keep], n[keep], np.broadcast_to(prior, keep.shape)[keep]
    if len(n) < 2 or n.sum() <= len(n):
        return quality_classifier.STRENGTHS[0]
    p = good / n
    between, within = (n * (p - prior) ** 2).sum() / (len(n) - 1), (n * p * (1 - p)).sum() / (n.sum() - len(n))
    size = (n.sum() - (n**2).sum() / n.sum()) / (len(n) - 1)
    total = between + (size - 1) * within
    rho = (between - within) / total if total > 0 else 0
    return float(np.clip((1 - rho) / rho, *quality_classifier.STRENGTHS)) if rho > 0 else quality_classifier.STRENGTHS[1]


def test_quality_posteriors_against_numpy(spark):
    """Hosts and paths from URLs: posteriors of every row, sparse and unlabelled sites among them."""
    rng = random.Random(4)
    good_text, bad_text = "The plain words of this sentence tell a story that goes on for a while. " * 9, "##$$ !! x x x x x\n" * 20
    rows, quality = [], {}
    for n in range(600):
        host, path = rng.choice(["a.org", "b.org", "WWW.c.org", "d.org"]) if n % 50 else f"tiny{n}.org", rng.choice(["x", "y"])
        good = rng.random() < {"a.org": 0.9, "b.org": 0.5, "WWW.c.org": 0.15}.get(host, 0.6) + (0.08 if path == "x" else -0.08)
        rows.append((n, good_text if good else bad_text, f"http://{host}/{path}/{n}.html"))
        if host != "d.org" and rng.random() < 0.8:
            quality[n] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string").repartition(3)
    labels = spark.createDataFrame([(d, q) for d, q in quality.items()], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.scored(docs, labels, *quality_classifier.site(F.col("url"))).collect()}
    key = {n: (u.lower().split("/")[2].removeprefix("www."), u.split("/")[3]) for n, _, u in rows}
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", quality_classifier.fold_of().alias("fold")).collect()}
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))

    def groups(of, known):
        found: dict = {of(k): [0, 0] for k in key.values()}
        for n in known:
            found[of(key[n])][0] += quality[n]
            found[of(key[n])][1] += 1
        return found

    every = {name: groups(of, quality) for name, of in (("paths", lambda k: k), ("hosts", lambda k: k[0]))}
    for f in range(quality_classifier.FOLDS):  # what is learnt for a part of the documents comes from the others
        others = [n for n in quality if fold[n] != f]
        hosts, paths = groups(lambda k: k[0], others), groups(lambda k: k, others)
        mean = sum(quality[n] for n in others) / len(others)
        up = beta_strength(list(hosts.values()), mean)
        post = {h: (g + up * mean) / (c + up) for h, (g, c) in hosts.items()}
        down = beta_strength(list(paths.values()), np.array([post[h] for h, _ in paths]))
        for n, k in key.items():
            if fold[n] != f:
                continue
            own, one = quality.get(n, 0), n in quality
            (g, c), (hg, hc) = every["paths"][k], every["hosts"][k[0]]
            at_host = (hg - own + up * mean) / (hc - one + up)
            want = (g - own + down * at_host) / (c - one + down)
            assert (got[n].host, got[n].path) == k
            assert got[n].host_quality == pytest.approx(at_host, rel=1e-9) and got[n].path_quality == pytest.approx(want, rel=1e-9)
            assert got[n].score == pytest.approx(1 / (1 + math.exp(-(logit(got[n].evidence) + logit(want) - logit(mean)))), rel=1e-6)
        assert post["a.org"] > post["c.org"] and post["d.org"] == pytest.approx(mean)


def test_no_label_has_a_part_in_its_own_score(spark):
    """Whatever the label of a document, and however often its row is repeated, its own score stays; those of others move."""
    rng = random.Random(8)
    rows = [(n, ("good words in a row " * rng.randrange(5, 40)) if rng.random() < 0.6 else "## ! $$\n" * 9, f"h{n % 7}", f"p{n % 3}") for n in range(200)]
    rows += [rows[11]] * 9 + [(11, "another text of it", "h9", "p1"), (12, rows[12][1], None, None), (12, rows[12][1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    marks = {n: int(rng.random() < 0.6) for n in range(150)}

    def scores(changed):
        labels = spark.createDataFrame(list((marks | changed).items()), "doc_id long, quality int")
        return sorted((r.doc_id, r.host or "", r.path or "", r.evidence, r.host_quality, r.path_quality, r.score) for r in quality_classifier.scored(docs, labels).collect())

    for d in (11, 12, 40):
        before, after = scores({d: 0}), scores({d: 1})
        assert [r for r in before if r[0] == d] == [r for r in after if r[0] == d]
        assert before != after


def test_language_model(docs, texts):
    got = {r.doc_id: r for r in lm.scored(docs, rounds=2, block_bytes=30_000, range_bytes=40_000).collect()}
    words = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_scores_against_a_plain_model(spark, docs, texts):
    """The whole operator, blocks, ranges and partitions included, against one pass over all texts in memory."""
    got = {r.doc_id: r.score for r in lm.scored(docs, rounds=2, block_bytes=30_000, range_bytes=40_000).collect()}
    relayed = {r.doc_id: r.score for r in lm.scored(docs, rounds=2, block_bytes=20_000, range_bytes=10_000, fan=4, relay_bytes=60_000).collect()}
    assert relayed == pytest.approx(got, rel=1e-6)
    words = {d: [*t.encode().lower().split(), b""] for d, t in sorted(texts.items())}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n = sum(c.values())
    own = sorted((w for w in c if c[w] * lm.FREQUENT >= n), key=lambda w: lm.names_of([w])[0][0])
    number = {w: lm.UNKNOWN + 1 + k for k, w in enumerate(own)}
    kind = lambda w: number.get(w, c[w].bit_length() * 64 + lm.form(w) if c[w] else lm.UNKNOWN)
    weight = np.zeros(lm.SHAPES + 1 + len(own))
    for w in c:
        weight[kind(w)] += c[w] + 0.5
    weight[lm.UNKNOWN] = 0.5
    model = lm.initial(weight, n, len(c), lm.STATES)
    cls = {d: np.array([kind(w) for w in ws]) for d, ws in words.items()}
    train = [cls[d] for d in words if not held[d]]
    for _ in range(2):
        starts, moves, emits, _ = lm.expected(model, np.concatenate(train), np.array([len(x) for x in train]), 1 << 30)
        starts, moves, emits = starts + 0.1, moves + 0.1, emits + weight / weight.sum()
        emits = lm.with_unknown(emits / emits.sum(axis=1, keepdims=True))
        model = lm.Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits, weight, n, len(c))
    for d, ws in words.items():
        alpha, total = model.start, 0.0
        for t, (w, k) in enumerate(zip(ws, cls[d], strict=True)):
            alpha = (alpha if t == 0 else alpha @ model.move) * model.emit[:, k]
            total += math.log10(alpha.sum()) + math.log10(c[w] + 0.5) - math.log10(weight[k])
            alpha = alpha / alpha.sum()
        assert got[d] == pytest.approx(total, rel=1e-6)


def test_forward_and_backward_agree_with_enumeration():
    rng = np.random.default_rng(1)
    make = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = lm.Model(make(2), make(2, 2), make(2, 3), np.ones(3), 1, 1)
    sizes, cls = np.array([3, 1, 4]), rng.integers(0, 3, 8)
    want, starts, moves, emits = [], np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for b, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        seq, paths = cls[b : b + n], []
        for code in range(2**n):
            s = [code >> k & 1 for k in range(n)]
            p = model.start[s[0]] * model.emit[s[0], seq[0]]
            for k in range(1, n):
                p *= model.move[s[k - 1], s[k]] * model.emit[s[k], seq[k]]
            paths.append((p, s))
        total = sum(p for p, _ in paths)
        want.append(math.log10(total))
        for p, s in paths:
            starts[s[0]] += p / total
            for k in range(n):
                emits[s[k], seq[k]] += p / total
                if k:
                    moves[s[k - 1], s[k]] += p / total
    a, b, e, log = lm.expected(model, cls, sizes)
    assert np.allclose(a, starts) and np.allclose(b, moves) and np.allclose(e, emits) and np.isclose(log, sum(want) * math.log(10))
    assert np.allclose(lm.log_likelihood(model, cls, sizes), want)
    for piece in (1, 2, 3):
        cut = lm.expected(model, cls, sizes, piece)
        assert np.allclose(cut[0], starts) and np.allclose(cut[1], moves) and np.allclose(cut[2], emits) and np.isclose(cut[3], log)


def test_cutting_texts_changes_no_count():
    rng = np.random.default_rng(2)
    make = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = lm.Model(make(4), make(4, 4), make(4, 9), np.ones(9), 1, 1)
    sizes = np.array([700, 1, 37, 256, 257, 512, 90])
    cls = rng.integers(0, 9, sizes.sum())
    whole = lm.expected(model, cls, sizes, 10_000)
    for piece in (7, 64, 256):
        for a, b in zip(whole, lm.expected(model, cls, sizes, piece), strict=True):
            assert np.allclose(a, b, rtol=1e-9)


def first_of_similar(texts, size=5):
    """The smallest doc_id reachable over pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 and more."""
    words = {d: t.lower().encode().split() for d, t in texts.items()}
    sets = {d: {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for d, w in words.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in texts}


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    grammar = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = {d: t for d, t in docs.items() if grammar.score(t) < 0.5}
    first_of = first_of_similar(docs)
    docs = {d: t for d, t in docs.items() if first_of[d] == d}
    first, left = {}, {}
    for d in sorted(docs):
        raw = docs[d].encode()
        mask, own = np.zeros(len(raw), bool), set()
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in first:
                mask[k : k + 50] = True
            else:
                own.add(raw[k : k + 50])
        first.update(dict.fromkeys(own))
        left[d] = np.frombuffer(raw, np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
    grams = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()
    items = [g for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (g := grams(r.text))]
    left = {d: t for d, t in left.items() if not any(len(g & grams(t)) >= 0.8 * len(g) - 1e-9 for g in items)}
    packed_ids(left, corpus_pipeline.run(spark, sf_dir).collect(), 2048)
