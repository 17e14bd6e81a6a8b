"""Hierarchical empirical-Bayes quality: a document classifier, shrunk host and path posteriors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .quality_rules import counts

#: Labelled rows from which the document classifier is fitted at most; of more, a part chosen by a hash of doc_id.
SAMPLE = 50_000
FEATURES = {
    "log_words": "ln(1.0 + n_words)",
    "word_length": "least(12.0, word_chars / greatest(n_words, 1))",
    "word_length_off": "pow(least(12.0, word_chars / greatest(n_words, 1)) - 5.0, 2)",
    "symbols": "least(1.0, n_symbols / greatest(word_chars, 1))",
    "any_symbol": "if(n_symbols > 0.01 * word_chars, 1.0, 0.0)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
#: Parts of the documents, by a hash of doc_id. What is said of a part's documents is learnt from the labels of the others.
FOLDS = 3
#: Bounds of a probability before its log-odds are taken.
LEAST = 1e-4
#: Bounds of the prior strengths that the method of moments may give, in documents.
STRENGTHS = (2.0, 10_000.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; columns as they are, the bias first and without penalty."""
    design = np.c_[np.ones(len(x)), x]
    beta, penalty = np.zeros(design.shape[1]), np.eye(design.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return beta


def marks_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): one row for each labelled document; contradicting labels count as bad."""
    known = labels.where(F.col("quality").isin(0, 1)).where("doc_id is not null")
    return known.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    ).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fold_of() -> Column:
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)), F.lit(0)).cast("int")


def _classifier(labelled: DataFrame, sample: int) -> Column:
    """Log-odds that a document is good, as an expression of its counts. labelled: one row for each document."""
    rows, n = labelled, labelled.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 62)) < (1 << 62) * sample // n)
    got = rows.select(*FEATURES, "quality").toPandas().to_numpy(dtype=float)  # bounded by sample
    if not len(got) or len(set(got[:, -1])) < 2:
        return F.lit(2.0)
    x, y = got[:, :-1], got[:, -1]
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    beta = fit((x - mean) / sd, y)
    bias = beta[0] - float((beta[1:] * mean / sd).sum())
    z = F.lit(float(bias))
    for (_, e), b in zip(FEATURES.items(), beta[1:] / sd, strict=True):
        z = z + F.lit(float(b)) * F.expr(e).cast("double")
    return z


def site(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port and a leading www.) and the first part of the path of a URL; null where there is none."""
    host = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1), F.lit(""))
    return host, F.when(host.isNotNull(), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*/([^/?#]*)", 1))


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), p))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, prior: Column) -> float:
    """How many labelled documents a prior counts for: the beta-binomial's, by moments over groups (good, n).

    The spread of the groups' rates around their prior, beyond what chance gives within groups, is the correlation rho inside a group; the prior counts for
    (1 - rho) / rho documents, within STRENGTHS.
    """
    n, rate = F.col("n"), F.col("good") / F.col("n")
    row = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"), F.sum(n * F.pow(rate - prior, F.lit(2.0))).alias("between"), F.sum(n * rate * (1 - rate)).alias("within")
    ).first()
    if row.k is None or row.k < 2 or row.n <= row.k:
        return STRENGTHS[0]
    between, within = row.between / (row.k - 1), row.within / (row.n - row.k)
    size = (row.n - row.squares / row.n) / (row.k - 1)
    total = between + (size - 1) * within
    rho = (between - within) / total if total > 0 else 0.0
    return min(STRENGTHS[1], max(STRENGTHS[0], (1 - rho) / rho)) if rho > 0 else STRENGTHS[1]


def _of_fold(values: list[float | Column]) -> Column:
    """The value for the document's own part."""
    found = F.lit(values[0]) if not isinstance(values[0], Column) else values[0]
    for f, v in enumerate(values[1:], 1):
        found = F.when(F.col("fold") == f, v).otherwise(found)
    return found


def scored(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, host, path, evidence (the classifier's probability), host_quality, path_quality, score and kept (score >= 0.5).

    docs: doc_id, text and what host and path are made of (columns or expressions; site() makes both from a URL); labels: doc_id, quality. The labelled documents of a
    host are a binomial outcome under a beta prior around the global rate, those of a path one under a beta prior around its host's posterior mean; both strengths come by moments, so
    sparse sites shrink. Groups are counted with partial sums, so a host with very many documents costs one row for each task. The score adds the path's log-odds, relative to the global ones, to
    the document's evidence.

    No document's own label has a part in its score: the classifier, the global rate and the strengths that speak about a document come from the labels of the other parts (FOLDS), and
    its label, once for each row that carries it, is taken out of the counts of its path and of its host. Nulls in host or path are a host or
    path of their own; a group without labels has its prior's mean; null texts have no words; repeated rows stay and count. Without labels of both kinds
    every document is equally likely good and is kept.
    """
    keys = ["host", "path"]
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    known = written(counts(docs.withColumns({"host": host.cast("string"), "path": path.cast("string")}), *keys).withColumn("fold", fold_of()), "counts")
    labelled = written(known.join(marks_of(labels), "doc_id"), "labelled")
    # rows of one document may differ in text: the classifier is fitted on one of them
    features = F.struct(*[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()])
    single = written(labelled.groupBy("doc_id", "fold").agg(F.min(features).alias("x"), F.min("quality").alias("quality")).select("doc_id", "fold", "x.*", "quality"), "single")
    z = [_classifier(single.where(F.col("fold") != f), sample) for f in range(FOLDS)]

    inside = {f"{c}{f}": F.when(F.col("fold") == f, F.col(c)).otherwise(0) for f in range(FOLDS) for c in ("good", "n")}
    outcomes = labelled.select(*keys, "fold", F.col("quality").alias("good"), F.lit(1).alias("n")).withColumns(inside).drop("fold")
    everywhere = known.select(*keys).distinct().select(*keys, *[F.lit(0).alias(c) for c in ("good", "n", *inside)])  # a group without labels, too
    sums = [F.sum(c).alias(c) for c in ("good", "n", *inside)]
    paths = written(outcomes.unionByName(everywhere).groupBy(*keys).agg(*sums), "paths")
    hosts = written(paths.groupBy("host").agg(*sums), "hosts")
    total = hosts.agg(*sums).first()
    means, up, down = [], [], []
    for f in range(FOLDS):  # what the other parts say
        rest = {c: (F.col(c) - F.col(f"{c}{f}")).alias(c) for c in ("good", "n")}
        n, good = (total.n or 0) - (total[f"n{f}"] or 0), (total.good or 0) - (total[f"good{f}"] or 0)
        means.append(good / n if n and 0 < good < n else 0.5)
        of_hosts = hosts.select(F.col("host").alias("h"), *rest.values())
        up.append(strength(of_hosts, F.lit(means[f])))
        prior = of_hosts.select("h", ((F.col("good") + up[f] * means[f]) / (F.col("n") + up[f])).alias("host_quality"))
        of_paths = paths.select("host", *rest.values()).join(prior, F.col("host").eqNullSafe(F.col("h")))
        down.append(strength(of_paths, F.col("host_quality")))
    both = bool(total.n) and 0 < total.good < total.n

    whole = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "good", "n").join(
        hosts.select(F.col("host").alias("h2"), F.col("good").alias("host_good"), F.col("n").alias("host_n")), F.col("h").eqNullSafe(F.col("h2"))
    ).drop("h2")
    whole = small(written(whole, "sites"))
    own = labelled.groupBy("doc_id", *keys).agg(F.count("*").alias("own_n"), F.sum("quality").alias("own_good"))
    at_host = own.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("oh")).agg(F.sum("own_n").alias("own_host_n"), F.sum("own_good").alias("own_host_good"))
    own = own.join(at_host, (F.col("doc_id") == F.col("d")) & F.col("host").eqNullSafe(F.col("oh"))).drop("oh", "doc_id")
    own = small(written(own.withColumnsRenamed({"host": "oh", "path": "op"}), "own"))
    rows = known.select("doc_id", "fold", *keys, (1 / (1 + F.exp(-_of_fold(z)))).alias("evidence"))
    rows = rows.join(own, (F.col("doc_id") == F.col("d")) & F.col("host").eqNullSafe(F.col("oh")) & F.col("path").eqNullSafe(F.col("op")), "left")
    rows = rows.join(whole, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    less = lambda c, own: F.col(c) - F.coalesce(own, F.lit(0))
    mean, a, b = _of_fold(means), _of_fold(up), _of_fold(down)
    rows = rows.withColumn("host_quality", (less("host_good", "own_host_good") + a * mean) / (less("host_n", "own_host_n") + a))
    path_quality = (less("good", "own_good") + b * F.col("host_quality")) / (less("n", "own_n") + b)
    rows = rows.withColumn("path_quality", path_quality if both else F.col("host_quality"))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_quality")) - logit(mean)))))
    return rows.select("doc_id", "host", "path", "evidence", "host_quality", "path_quality", "score", (F.col("score") >= 0.5).alias("kept"))
