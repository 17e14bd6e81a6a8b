"""The toxicity grammar: its lexicon, what it learns, and scores held against all paths of the cascade."""

import itertools
import math
from fractions import Fraction

import pytest

pytest.importorskip("evidentia.llm.toxicity")

from evidentia.llm import toxicity

THREATENING = (
    "I will kill you", "I am killing you tomorrow", "he murdered them, you are next", "I will shoot you", "we will burn your house down", "they are stabbing people",
    "te voy a matar", "voy a matarte", "je vais te tuer", "je vais t'égorger", "je vais t’étrangler", "ich bringe dich um", "ich werde dich umbringen", "wir erschießen euch",
)
HARMLESS = ("hello friend", "we kill time", "the virus kills cells", "er bringt mir das Buch um neun", "matar el tiempo", "la viande est brûlée", "um dich", "you are next", "")


@pytest.fixture(scope="module")
def learnt(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_threats_in_four_languages(learnt):
    assert all(learnt.score(t) > 0.5 for t in THREATENING)
    assert all(learnt.score(t) < 0.5 for t in HARMLESS)
    for text in ("I will not kill you", "she said he will kill him"):
        assert learnt.score(text) < learnt.score("I will kill you")


def test_inflected_forms():
    assert toxicity.english_forms("kill") == {"kill", "kills", "killed", "killing"}
    assert toxicity.english_forms("strangle") == {"strangle", "strangles", "strangled", "strangling"}
    assert toxicity.english_forms("stab") == {"stab", "stabs", "stabbed", "stabbing"}
    assert toxicity.english_forms("beat") == {"beat", "beats", "beated", "beating"}
    assert {"tötet", "schlägst", "tué", "frappons", "matamos", "quemado"} <= toxicity.THREATS
    assert not toxicity.THREATS & {*toxicity.TARGETS, *toxicity.NEGATIONS, *toxicity.REPORTS}


def every_way(factor, symbols):
    """The weight of the best way through the five transducers, one after the other, by enumeration; and what it matches."""
    read = {(tuple(c for c, _ in symbols), (0.0,) * len(symbols))}
    for t in toxicity.cascade(factor):
        after = set()
        for word, weights in read:
            paths = [(t.start, (), ())]
            for symbol in word:
                paths = [(to, out + (o,), w + (v,)) for s, out, w in paths for o, v, to in t.read(s, symbol)]
            after |= {(out, tuple(map(sum, zip(weights, w, strict=True)))) for s, out, w in paths if s in t.finals}
        read = after
    scales = [s for _, s in symbols]
    best = max(sum(w * s for w, s in zip(ws, scales, strict=True)) for _, ws in read)
    return best, {out for out, ws in read if sum(w * s for w, s in zip(ws, scales, strict=True)) == best}


def test_score_equals_brute_force(learnt):
    """Every text of four words out of a small vocabulary: classes by a plain lookup, the best of all ways, then the logistic scale."""
    insult = sorted(learnt.weight)[0]
    vocabulary = [insult, "kill", "you", "not", "said", "matarte", "table"]
    kinds = {insult: [("insult", learnt.weight[insult])], "kill": [("threat", learnt.threat)], "you": [("target", 0.0)], "not": [("negation", 0.0)], "said": [("report", 0.0)],
             "matarte": [("threat", learnt.threat), ("target", 0.0)], "table": []}
    for words in itertools.product(vocabulary, repeat=4):
        symbols = [s for w in words for s in kinds[w]]
        best, outs = every_way(learnt.factor, symbols)
        found = [[(c, s) for c, (_, s) in zip(out, symbols, strict=True) if c in learnt.factor] for out in outs]
        sums = []
        for matches in found:
            assert sum(learnt.factor[c] * s for c, s in matches) == pytest.approx(best)
            matches.sort(key=lambda x: -x[1])
            sums.append(sum(learnt.factor[c] * (s if n == 0 else s / 2) for n, (c, s) in enumerate(matches)))
        z = [learnt.bias + learnt.slope * math.log1p(e) for e in sums]
        assert any(learnt.score(" ".join(words)) == pytest.approx(1 / (1 + math.exp(-v))) for v in z), words


def test_binomial_tail_is_exact():
    for n, bad, share in ((1, 1, Fraction(1, 3)), (9, 4, Fraction(1, 7)), (40, 0, Fraction(1, 2)), (200, 60, Fraction(1, 5))):
        exact = sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(bad, n + 1))
        assert toxicity.binomial_tail(bad, n, float(share)) == pytest.approx(float(exact), rel=1e-9)


def test_discoveries_step_up():
    tails = {"a": 0.001, "b": 0.019, "c": 0.0149, "d": 0.5}
    assert toxicity.discoveries(tails, 10, 0.05) == {"a"}
    assert toxicity.discoveries(tails, 4, 0.05) == {"a", "b", "c"}  # b passes at 3/4 of the level, and takes c with it
    assert toxicity.discoveries({}, 0) == set() and toxicity.discoveries({"a": 0.9}, 5) == set()


def test_noise_is_not_learnt(spark):
    """Words that have nothing to do with the label are not taken, however many there are; the one that has is."""
    rows = [(d, " ".join([f"w{(d * 7 + k * 13) % 97}x" for k in range(20)] + ["grobian"] * (d % 6 == 0)), int(d % 6 == 0)) for d in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert set(toxicity.learn(docs, labels).weight) == {"grobian"}


def test_repeated_rows_and_nulls(spark):
    """A hundred equal rows of one labelled document bring one row to the driver and one fate; nulls stay; an empty table stays empty."""
    rows = [(d, "you grobian" if d % 3 == 0 else "a fine day", int(d % 3 == 0)) for d in range(90)]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, "you grobian")] * 100 + [(None, None), (91, None), (92, "")], "doc_id long, text string")
    kept = toxicity.without_toxic(docs, labels).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [d for d in range(90) if d % 3] + [91, 92]
    assert sum(r.doc_id is None for r in kept) == 1
    assert toxicity.without_toxic(docs.limit(0), labels).count() == toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_words_take_elisions_apart():
    assert toxicity._WORDS("je t'égorge, isn't it d'or") == ["je", "t'", "égorge", "isn't", "it", "d'", "or"]
    assert toxicity.THREATENS not in toxicity._WORDS(toxicity.THREATENS)  # the name for counts is never a word of a text
