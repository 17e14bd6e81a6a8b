"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five weighted transducers read the word classes of a clause one after the other: reported speech, negation, target, insult, threat. Their composition is
one transducer; what counts is the heaviest path through it for each clause. Insults, the scale of threats, the weights of contexts and the final scale
are learned; the verbs of threats are fixed, with forms made by rules of four languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, given_back, in_batches, slices, text_or_empty

#: Labelled training texts that are read at most; of more, a part chosen by a hash of doc_id.
SAMPLE = 20_000
#: A word is taken for an insult if it is in so large a part of the toxic training texts, in so many of them, and so many times as frequent there,
#: and if exact binomial tests say so: of the words taken, a part of LEVEL at most is there by chance (Benjamini and Hochberg's step-up over all words tested).
SHARE, SUPPORT, RATIO, LEVEL = 0.004, 4, 8.0, 0.01

# Fixed word lists of the grammar: function words of four languages, and the verbs of threats.
TARGETS = (
    "you your yours he she they him her them this these who people du ihr sie dich dir euch ihn er tu te t' vous il elle ils elles toi tú usted ustedes os él ella ellos ellas"
).split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't didn't won't nicht kein keine nie niemals ne n' pas jamais aucun sans nunca jamás sin tampoco".split()
REPORTS = "said says say claimed claims wrote called calls quoted quote reported alleged sagte sagt behauptete nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()
ENGLISH = "kill hurt beat destroy murder attack shoot burn stab strangle smash slaughter".split()
GERMAN = "töt schlag schläg ermord erschieß erwürg zerstör verprügel verbrenn erstech".split()
SEPARABLE = {"bring": "um", "leg": "um", "stech": "ab", "knall": "ab", "mach": "fertig", "schlag": "zusammen"}
FRENCH = "tu frapp massacr étrangl poignard brûl égorg assassin".split()
SPANISH = "mat golpe asesin quem apuñal estrangul dispar".split()
IRREGULAR = "shot beaten umbringen umgebracht erschossen détruire détruis détruit détruirai destruir destruyo destruiré".split()
ENDINGS = {
    "german": "e st est t et en te test ten tet".split(),
    "separable": "e st t en".split(),
    "french": "er e es ons ez ent é ée és ées ai as a erai eras era erons erez eront ais ait aient ant".split(),
    "spanish": "ar o as a amos an é aste ó aron aré arás ará aremos arán aba ado ada ando".split(),
}
CLITICS = "te os lo la los las le les".split()


def english_forms(verb: str) -> set[str]:
    """A verb, its -s, -ed and -ing: a last e falls out, and one short syllable doubles its last consonant."""
    stem = verb.removesuffix("e")
    if re.fullmatch(r"[^aeiou]+[aeiou][bdgmnpt]", verb):
        stem = verb + verb[-1]
    return {verb, f"{verb}s", f"{stem}ed", f"{stem}ing"}


def threat_forms() -> set[str]:
    """All inflected forms of the verbs of threats that are one word; forms that no language has do no harm."""
    forms = {f for verb in ENGLISH for f in english_forms(verb)} | set(IRREGULAR)
    for stems, kind in ((GERMAN, "german"), (FRENCH, "french"), (SPANISH, "spanish")):
        forms |= {stem + ending for stem in stems for ending in ENDINGS[kind]}
    return forms - set(TARGETS)


#: Infinitives that carry their target, as matarte.
AIMED = {f"{stem}ar{clitic}" for stem in SPANISH for clitic in CLITICS}
#: The form of a verb whose particle, later in the clause, makes it a threat.
HEADS = {stem + ending: particle for stem, particle in SEPARABLE.items() for ending in ENDINGS["separable"]}
THREATS = threat_forms()

CONTEXTS = ("plain", "targeted", "negated", "reported")
#: Factors before any evidence, and the matches that they count for.
PRIOR, STRENGTH = (1.0, 1.2, 0.4, 0.4), 20.0
_WORDS = re.compile(r"(?:[cdjlmnst]|qu)'(?=\w)|\w+(?:'\w+)?").findall
#: A word that no text has, under which texts with an aimed threat are counted.
THREATENS = " threatens"
_CLAUSES = re.compile(r"[.!?;:\n\r()\"“”«»]+|,\s").split


Arc = tuple[str, float, str]  # what is written, the weight, the next state


@dataclass
class Transducer:
    """A weighted finite-state transducer: state and symbol read give arcs. Weights add along a path; final states may add one more.

    A symbol is a word class with what is known about it, as "insult" or "insult+aimed"; what a transducer doesn't name passes as it is.
    """

    start: str
    arcs: dict[tuple[str, str], list[Arc]] = field(default_factory=dict)
    finals: dict[str, float] = field(default_factory=dict)

    def add(self, state: str, symbol: str, out: str, to: str, weight: float = 0.0) -> None:
        self.arcs.setdefault((state, symbol), []).append((out, weight, to))

    def read(self, state: str, symbol: str) -> list[Arc]:
        return self.arcs.get((state, symbol)) or [(symbol, 0.0, state)]


def compose(a: Transducer, b: Transducer, alphabet: Iterable[str]) -> Transducer:
    """What a writes is read by b: a transducer over pairs of states, from its start on, for the symbols of an alphabet."""
    out = Transducer(f"{a.start}|{b.start}")
    todo, seen = [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        x, y = todo.pop()
        if x in a.finals and y in b.finals:
            out.finals[f"{x}|{y}"] = a.finals[x] + b.finals[y]
        for symbol in alphabet:
            for middle, w, x2 in a.read(x, symbol):
                for written, v, y2 in b.read(y, middle):
                    out.add(f"{x}|{y}", symbol, written, f"{x2}|{y2}", w + v)
                    if (x2, y2) not in seen:
                        seen.add((x2, y2))
                        todo.append((x2, y2))
    return out


def best_path(t: Transducer, symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """What the heaviest accepting path writes, with the scales of the symbols read; an arc's weight counts times the symbol's scale. Ties go to the smaller state."""
    paths: dict[str, tuple[float, tuple | None]] = {t.start: (0.0, None)}
    for symbol, scale in symbols:
        now: dict[str, tuple[float, tuple | None]] = {}
        for state in sorted(paths):
            total, trail = paths[state]
            for out, weight, to in t.read(state, symbol):
                value = total + weight * scale
                if to not in now or value > now[to][0]:
                    now[to] = (value, (out, scale, trail))
        paths = now
    ends = [(total + t.finals[s], s) for s, (total, _) in paths.items() if s in t.finals]
    if not ends:
        return []
    top = max(v for v, _ in ends)
    trail, out = paths[min(s for v, s in ends if v == top)][1], []
    while trail:
        out.append(trail[:2])
        trail = trail[2]
    return out[::-1]


CLASSES = ("insult", "threat", "target", "negation", "report")


def reported_speech() -> Transducer:
    """After a verb of reporting, insults and threats of the clause are someone else's words."""
    t = Transducer("own", finals={"own": 0.0, "quoted": 0.0})
    t.add("own", "report", "report", "quoted")
    for c in ("insult", "threat"):
        t.add("quoted", c, f"{c}+reported", "quoted")
    return t


def negation() -> Transducer:
    """A negation holds until the insult or threat that it governs; it does not reach into reported speech."""
    t = Transducer("open", finals={"open": 0.0, "negating": 0.0})
    t.add("open", "negation", "negation", "negating")
    for c in ("insult", "threat"):
        t.add("negating", c, f"{c}+negated", "open")
        t.add("negating", f"{c}+reported", f"{c}+reported", "negating")
    return t


def target() -> Transducer:
    """Insults and threats are aimed if a target came before them, or comes after: the path guesses that and must meet one to be accepted."""
    t = Transducer("none", finals={"none": 0.0, "aimed": 0.0})
    for state in ("none", "aimed", "owing"):
        t.add(state, "target", "target", "aimed")
    for c in ("insult", "threat"):
        t.add("none", c, c, "none")
        t.add("none", c, f"{c}+aimed", "owing")
        t.add("owing", c, f"{c}+aimed", "owing")
        t.add("aimed", c, f"{c}+aimed", "aimed")
    return t


def insult(factor: dict[str, float]) -> Transducer:
    """Insults match in every context, with the context's factor as weight."""
    t = Transducer("", finals={"": 0.0})
    for mark, context in (("", "plain"), ("+aimed", "targeted"), ("+negated", "negated"), ("+reported", "reported")):
        t.add("", f"insult{mark}", context, "", factor[context])
    return t


def threat(factor: dict[str, float]) -> Transducer:
    """Threats match if aimed, negated or reported; a verb alone threatens nobody."""
    t = Transducer("", finals={"": 0.0})
    for mark, context in (("+aimed", "targeted"), ("+negated", "negated"), ("+reported", "reported")):
        t.add("", f"threat{mark}", context, "", factor[context])
    return t


def cascade(factor: dict[str, float]) -> list[Transducer]:
    """The five transducers in the order in which they read: reported speech, negation, target, insult, threat."""
    return [reported_speech(), negation(), target(), insult(factor), threat(factor)]


def clause_grammar(factor: dict[str, float]) -> Transducer:
    """Their composition."""
    whole, *rest = cascade(factor)
    for t in rest:
        whole = compose(whole, t, CLASSES)
    return whole


@dataclass
class Grammar:
    """The lexicon (word to class and scale) in front of the composed clause grammar."""

    weight: dict[str, float]
    factor: dict[str, float] = field(default_factory=lambda: dict(zip(CONTEXTS, PRIOR, strict=True)))
    bias: float = 0.0
    slope: float = 1.0
    threat: float | None = None

    def __post_init__(self) -> None:
        self.kind = {w: k for k, ws in (
            ("target", TARGETS), ("report", REPORTS), ("negation", NEGATIONS), ("threat", THREATS)
        ) for w in ws} | dict.fromkeys(self.weight, "insult")
        if self.threat is None:
            self.threat = max(self.weight.values(), default=3.0)
        self.open = frozenset(self.weight) | THREATS | AIMED | HEADS.keys()
        self.learn(self.factor)

    def learn(self, factor: dict[str, float]) -> None:
        self.factor, self.rules = factor, clause_grammar(factor)

    def clause(self, tokens: list[str]) -> list[tuple[str, float]]:
        """(context, weight) of the matches on the clause's best path."""
        symbols: list[tuple[str, float]] = []
        particles: set[str] = set()
        for n, w in enumerate(tokens, 1):
            if w in particles and n == len(tokens):  # the second half of a separable verb ends its clause
                symbols.append(("threat", self.threat))
            elif w in AIMED:
                symbols += [("threat", self.threat), ("target", 0.0)]
            elif k := self.kind.get(w):
                symbols.append((k, self.weight.get(w, self.threat if k == "threat" else 0.0)))
            if w in HEADS:
                particles.add(HEADS[w])
        return [(out, scale) for out, scale in best_path(self.rules, symbols) if out in self.factor]

    def matches(self, text: str) -> dict[str, float]:
        """Weight by context over all clauses of a text; the best match of a clause and half of its others."""
        low = text.lower().replace("\u2019", "'")
        if self.open.isdisjoint(_WORDS(low)):
            return {}
        total: dict[str, float] = {}
        for part in _CLAUSES(low):
            tokens = _WORDS(part)
            if self.open.isdisjoint(tokens):
                continue
            found = self.clause(tokens)
            found.sort(key=lambda x: -x[1])
            for n, (context, weight) in enumerate(found):
                total[context] = total.get(context, 0.0) + (weight if n == 0 else weight / 2)
        return total

    def score(self, text: str) -> float:
        evidence = sum(w * self.factor[c] for c, w in self.matches(text).items())
        z = self.bias + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of the rows of at most about `sample` labelled documents that are not held out."""
    marks = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(crc_fold() != 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < (1 << 62) * sample // n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.join(F.broadcast(marks), "doc_id")  # bounded by sample


def binomial_tail(bad: int, n: int, share: float) -> float:
    """The exact probability of `bad` or more toxic ones in n texts of which each is toxic with probability share, strictly between 0 and 1."""
    k = np.arange(bad, n + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k])
    return float(min(np.exp(choose + k * math.log(share) + (n - k) * math.log1p(-share)).sum(), 1.0))


def discoveries(tails: dict[str, float], tests: int, level: float = LEVEL) -> set[str]:
    """Of the tails among so many tests, those that the step-up procedure takes: the k smallest, for the largest k whose k-th is at most level * k / tests."""
    ranked = sorted(tails, key=lambda w: (tails[w], w))
    last = max((k for k, w in enumerate(ranked, 1) if tails[w] <= level * k / tests), default=0)
    return set(ranked[:last])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learn insults, context factors and the final scale from labelled texts outside the held-out fold."""
    train = _training(docs, labels, sample)
    bare = Grammar({})

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen.update((w, toxic) for w in set(_WORDS(text.lower())))
                seen["", toxic] += 1
                seen[THREATENS, toxic] += "targeted" in bare.matches(text)
        if seen:
            keys, n = zip(*seen.items(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(n, pa.int64())], ["word", "toxic", "n"]
            )

    counted = in_batches(train).mapInArrow(vocabulary, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    counted = counted.persist()
    total = counted.where("word = ''").first()
    if total is None or not total.bad:
        counted.unpersist()
        return Grammar({}, bias=-4.0)
    bad, good = total.bad, total.good
    tried = counted.where((F.col("bad") >= max(SUPPORT, SHARE * bad)) & ~F.col("word").isin("", THREATENS))
    often = F.col("bad") / bad >= RATIO * F.greatest(F.col("good"), F.lit(0.5)) / max(good, 1)
    rows, tests = tried.where(often).collect(), tried.count()  # at most 1 / SHARE words for each word of an average text
    aimed = counted.where(F.col("word") == THREATENS).first()
    counted.unpersist()
    own = THREATS.union(TARGETS, NEGATIONS, REPORTS, AIMED)
    odds = lambda b, g: math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
    tails = {r.word: binomial_tail(r.bad, r.bad + r.good, bad / (bad + good)) for r in rows if good and r.word not in own}
    found = discoveries(tails, tests)
    words = {r.word: odds(r.bad, r.good) for r in rows if r.word in found}
    # What aimed threats tell, shrunk to the strongest insult as far as few texts hold any.
    n, prior = (aimed.bad + aimed.good, max(words.values(), default=3.0)) if aimed else (0, 3.0)
    grammar = Grammar(words, threat=max((n * odds(aimed.bad, aimed.good) + STRENGTH * prior) / (n + STRENGTH), 0.0) if n else None)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.matches(t) for t in batch.column("text").to_pylist()]
            kept = [batch.column("doc_id"), batch.column("toxic")]
            yield pa.RecordBatch.from_arrays([*[pa.array([m.get(c, 0.0) for m in found], pa.float64()) for c in CONTEXTS], *kept], [*CONTEXTS, "doc_id", "toxic"])

    schema = ", ".join(f"{c} double" for c in CONTEXTS) + ", doc_id long, toxic int"
    # One row a document: repeated rows of a labelled document add nothing to what comes to the driver.
    each = in_batches(train).mapInArrow(contexts, schema).groupBy("doc_id").agg(F.max(F.struct(*CONTEXTS)).alias("m"), F.max("toxic").alias("toxic"))
    seen = each.orderBy("doc_id").select("m.*", "toxic").toPandas()  # bounded by sample
    is_bad = seen["toxic"].to_numpy() == 1
    weight = seen[list(CONTEXTS)].to_numpy()
    grammar.learn(_factors(weight, is_bad))
    evidence = np.log1p(weight @ np.array([grammar.factor[c] for c in CONTEXTS]))
    grammar.bias, grammar.slope = _logistic(evidence, is_bad.astype(float))
    return grammar


def _factors(weight: np.ndarray, is_bad: np.ndarray) -> dict[str, float]:
    """A context's factor: how far its matches speak for toxicity, as log-odds relative to those of all matches, shrunk to the prior."""
    hit = weight > 0
    bad, good = hit[is_bad].sum(axis=0), hit[~is_bad].sum(axis=0)
    odds = lambda b, g: math.log((b + 1) / (is_bad.sum() + 2)) - math.log((g + 1) / ((~is_bad).sum() + 2))
    whole, out = max(odds(bad.sum(), good.sum()), 0.1), {}
    for c, name in enumerate(CONTEXTS):
        n = bad[c] + good[c]
        own = min(max(odds(bad[c], good[c]) / whole, 0.1), 1.5)
        out[name] = float((n * own + STRENGTH * PRIOR[c]) / (n + STRENGTH))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for a bias and a slope, with a little ridge; the slope is never negative."""
    beta, design = np.zeros(2), np.c_[np.ones_like(x), x]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2, design.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score in 0 to 1, predicted (1 if score >= 0.5), n_matches by context in `evidence`.

    docs: doc_id, text; labels: doc_id, toxic; nothing else is read. The scoring pass is narrow. Null texts count as empty and get the score of a text
    without matches; repeated rows get equal scores; a null doc_id is not held out. Without a toxic training text every score is low.
    """
    grammar = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            scores = pa.array([grammar.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    held = F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_or_empty().alias("text"))
    return in_batches(rows).mapInArrow(given_back(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those predicted toxic, in one narrow pass; all columns stay.

    Null texts count as empty, so they stay; repeated rows share one fate, and a null doc_id changes nothing. Empty tables give empty tables.
    """
    grammar = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            keep = [grammar.score(t or "") < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(docs).mapInArrow(given_back(run), docs.schema)
