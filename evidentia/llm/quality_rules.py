"""Quality rules with risk-controlled thresholds; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, small, text_or_empty, written
from .shingles import words

#: A rule rejects where its signal is over the cutoff. Cutoffs are fixed beforehand, seven a rule, from the most lenient to the strictest.
RULES = {
    "symbols": ("100.0 * n_symbols / greatest(word_chars, 1)", [50.0, 30.0, 20.0, 10.0, 5.0, 2.0, 1.0]),
    "dup_lines": ("100.0 * n_dup_lines / greatest(n_lines, 1)", [90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0]),
    "repeats": ("100.0 * n_repeat_words / greatest(n_words, 1)", [90.0, 70.0, 50.0, 40.0, 30.0, 25.0, 20.0]),
    "short_words": ("100.0 - 10.0 * word_chars / greatest(n_words, 1)", [75.0, 70.0, 65.0, 62.0, 60.0, 58.0, 56.0]),
}
#: Cutoffs in the order in which they are tried: every rule's most lenient one first, then every rule's next.
PATH = [(name, j, RULES[name][1][j]) for j in range(7) for name in RULES]
#: False rejection that all selected cutoffs together may have in a stratum, and the chance that any stratum has more.
ALPHA, DELTA = 0.02, 0.05

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _equal(x: Column, y: Column) -> Column:
    """Whether two keys differ in the place only; false where there is no neighbour."""
    return F.coalesce(F.call_function("shiftright", x.bitwiseXOR(y), F.col("bits")) == 0, F.lit(False))


def counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns `more`, and the base counts of every whole text, computed within rows, without a shuffle.

    Repeated windows: the hashes of the three-word windows are sorted with their places in their low bits, so equal ones are neighbours; those are then told
    apart by their words, so a collision can't count. A null text has no words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, text_or_empty().alias("t"))
    rows = rows.withColumns({"w": words(F.col("t")), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))})
    bare = F.col("t")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    rows = rows.select(
        "doc_id", *more, "w", F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", SPACE, ""))).alias("blanks"), F.char_length("t").alias("chars"),
        (F.octet_length("t") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("wh"), F.ceil(F.log2(F.size("w").cast("double") + 2)).cast("int").alias("bits"),
    )
    place = F.transform(
        F.sequence(F.lit(0), F.size("wh") - 3),
        lambda i: _left(F.xxhash64(F.get("wh", i), F.get("wh", i + 1), F.get("wh", i + 2)), F.col("bits")).bitwiseOR(i.cast("long"))
    )
    rows = rows.withColumn("p", F.when(F.size("wh") >= 4, F.sort_array(place)).otherwise(F.array().cast("array<bigint>"))).drop("wh")
    low = _left(F.lit(1).cast("long"), F.col("bits")) - 1
    same = lambda x, i: _equal(F.get("p", i - 1), x) | _equal(F.get("p", i + 1), x)
    rows = rows.withColumn("q", F.transform(F.filter("p", same), lambda x: x.bitwiseAND(low).cast("int"))).drop("p")
    window = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    rows = rows.withColumn("q", F.array_sort(F.transform("q", lambda i: F.struct(window(i).alias("s"), i.alias("i"))))).drop("w", "bits")
    again = lambda x, i: F.coalesce(F.get("q", i - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get("q", i + 1)["s"] == x["s"], F.lit(False))
    rows = rows.withColumn("q", F.array_sort(F.transform(F.filter("q", again), lambda x: x["i"])))
    covered = F.aggregate(
        "q", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )
    return rows.select(
        "doc_id", *more, "n_words", (F.col("chars") - F.col("blanks")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"), "n_lines"
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _log_gamma(x: Column) -> Column:
    """Stirling's series above 8, reached by the recurrence; x >= 1."""
    y, shift = x + 8, F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - shift


def _stirling_error(x: Column) -> Column:
    """log(x!) less Stirling's formula; by its series from 16 on."""
    small = _log_gamma(x + 1) - (x + 0.5) * F.log(x) + x - F.lit(0.9189385332046727)
    return F.when(x < 16, small).otherwise(1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0))))


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, without cancellation near the mean."""
    off = (x - mean) / mean
    return mean * ((1 + off) * F.log1p(off) - off)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p): the p-value of "the rate is over p" after k failures of n; 1 where k >= p * n.

    The term at k comes from the saddle point form, those below from their ratios. Below the mean the i-th ratio is under 1 - i / k, so the first
    50 + 9 sqrt(k) terms hold all but 1e-17 of the sum, for every k.
    """
    kd, nd = k.cast("double"), n.cast("double")
    odds = (1 - p) / p
    rest = nd - kd
    saddle = _stirling_error(nd) - _stirling_error(kd) - _stirling_error(rest) - _deviance(kd, nd * p) - _deviance(rest, nd * (1 - p)) + 0.5 * F.log(nd / (F.lit(6.283185307179586) * kd * rest))
    first = F.when(k == 0, nd * F.log1p(F.lit(-p))).otherwise(saddle)
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    steps = F.sequence(F.lit(0), F.least(k, 50 + F.ceil(9 * F.sqrt(kd))).cast("int"))
    summed = F.aggregate(steps, none, lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (kd - j) / (rest + j + 1) * odds).alias("term")))
    return F.when((n <= 0) | (kd >= p * nd), 1.0).otherwise(F.least(F.lit(1.0), F.exp(first) * summed["sum"]))


def thresholds(labelled: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest cutoffs that are safe together in each stratum.

    labelled: base counts, stratum and quality of a holdout. PATH makes a rule stricter at each step, so its steps reject ever more. Within a stratum they are tested in order on good texts
    that pass the base, by what all cutoffs so far reject together; the first that can't be shown to reject at most alpha of them ends the path (fixed-sequence testing), at
    the level delta over the strata (Bonferroni). So with probability 1 - delta the selected cutoffs together reject at most alpha of the good texts of every stratum. n_rejected counts
    what the last safe step rejects. A rule without a safe cutoff has no row and rejects nothing. Texts without a quality don't count; a null stratum is one of its own.
    """
    good = labelled.where("quality = 1").where(~base_failed())
    first = F.least(*[F.when(F.expr(RULES[name][0]) > cut, t).otherwise(len(PATH)) for t, (name, _, cut) in enumerate(PATH)])
    wide = good.groupBy(stratum).agg(F.count("*").alias("n_good"), *[F.sum((first <= t).cast("long")).alias(f"t{t}") for t in range(len(PATH))])
    cells = F.array(*[F.struct(
        F.lit(t).alias("step"), F.lit(name).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"t{t}").alias("n_rejected")
    ) for t, (name, _, cut) in enumerate(PATH)])
    tests = max(1, labelled.select(stratum).distinct().count())
    tall = wide.select(stratum, "n_good", F.inline(cells))
    safe = binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha) <= F.lit(delta / tests)
    # the first step that fails; those before it are safe
    held = tall.groupBy(stratum).agg(
        F.min(F.when(~safe, F.col("step"))).alias("end"), F.max("n_good").alias("n_good"),
        F.array_sort(F.collect_list(F.struct("step", "rule", "cutoff", "n_rejected"))).alias("steps")
    )
    last = F.coalesce("end", F.size("steps")).cast("int")
    kept = held.where(last > 0).select(
        stratum, "n_good", F.get("steps", last - 1)["n_rejected"].alias("n_rejected"), F.explode(F.slice("steps", F.lit(1), last)).alias("s")
    )
    return kept.groupBy(stratum, F.col("s.rule").alias("rule")).agg(
        F.max_by("s.cutoff", "s.step").alias("cutoff"), F.max("n_good").alias("n_good"), F.max("n_rejected").alias("n_rejected")
    )


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of docs its base counts, base_failed, the rules that reject it, and kept.

    docs: doc_id, text and the stratum column; labels: doc_id, quality (0 or 1). Texts are counted once, into a narrow table in the shared folder, which
    serves calibration (joined with the labels) and the verdict (joined with the few cutoffs of each stratum, broadcast while small). Null texts have no
    words and fail the base. Repeated rows stay; a doc_id that labels give twice with different quality counts as bad.
    """
    known = written(counts(docs, stratum), "counts")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = thresholds(known.join(marks, "doc_id"), stratum, alpha, delta)
    wide = cuts.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in RULES])
    wide = small(written(wide.withColumnRenamed(stratum, "of_stratum"), "cutoffs"))
    rejects = F.array_compact(F.array(*[F.when(F.expr(signal) > F.col(f"cut_{name}"), F.lit(name)) for name, (signal, _) in RULES.items()]))
    return (
        known.join(wide, F.col(stratum).eqNullSafe(F.col("of_stratum")), "left")
        .withColumns({"base_failed": base_failed(), "rejected_by": rejects})
        .select(
            "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
            F.array_join("rejected_by", ",").alias("rejected_by")
        )
    )


def oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The query's rows in DuckDB's SQL."""
    symbols = " + ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in SYMBOLS)
    grid = ", ".join(f"('{name}', {t}, {cut!r}::double)" for t, (name, _, cut) in enumerate(PATH))
    signal = "case rule " + " ".join(
        f"when '{name}' then {s.replace('100.0', '100.0::double').replace('10.0 ', '10.0::double ')}" for name, (s, _) in RULES.items()
    ) + " end"
    return f"""
    with t as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
    w as (select r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from t),
    win as (select r, unnest(range(1, len(w) - 1)) as i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as s from w where len(w) >= 3),
    rep as (select r, i from (select r, i, count(*) over (partition by r, s) as k from win) where k > 1),
    cov as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from rep) group by r),
    f as (select w.r, doc_id, lang, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
        ({symbols})::bigint as n_symbols, l as lines, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
      from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from w) w left join cov on cov.r = w.r),
    b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from f),
    m as (select doc_id, min(quality) as quality from labels group by 1),
    lab as (select b.*, quality from b join m using (doc_id)),
    tests as (select count(*) as tests from (select distinct lang from lab)),
    g(rule, step, cutoff) as (values {grid}),
    hit as (select l.r, min(step) as first from lab l, g where quality = 1 and not base_failed and {signal} > cutoff group by all),
    ok as (select lang, first from lab left join hit using (r) where quality = 1 and not base_failed),
    cell as (select lang, rule, step, cutoff, count(*) as n, count(*) filter (where first <= step) as k from ok, g group by all),
    p as (select *, case when k >= {alpha} * n then 1 else list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln({1 - alpha})) for i in range(0, k + 1)]) end as pv from cell),
    e as (select lang, min(step) filter (where pv > {delta} / tests) as stop from p, tests group by all),
    c as (select p.lang, p.rule, max_by(cutoff, step) as cutoff from p join e on p.lang is not distinct from e.lang where step < coalesce(stop, 99) group by all),
    rej as (select r, string_agg(rule, ',' order by array_position({list(RULES)!r}, rule)) as rejected_by from b join c on b.lang is not distinct from c.lang where {signal} > cutoff group by r)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and rejected_by is null) as kept, coalesce(rejected_by, '') as rejected_by
    from b left join rej using (r)"""


