"""Quality scores from a sparse rule ensemble over text statistics.

Small boosted trees over statistics of labelled texts are taken apart into their paths; every path is a rule, a
conjunction of comparisons. A logistic regression under the lasso weighs the rules and drops most of them. What is
left is compiled into a Spark column, so that scoring runs inside the JVM in one pass over the texts.

The trees and weights are fitted on the driver on at most `max_rows` labelled documents, those with the least hashes
of doc_id; the statistics of every whole text are then computed by all executors. Labels of the held-out fifth
(crc32 of the doc_id as text, modulo 5, is 0) are never read.

Cases: a null text is empty, and an empty text has all statistics 0 and so a score too; a null doc_id isn't held out
and isn't learned from; several labels of one doc_id are averaged and rounded, nulls skipped; without labels, or with
one class only, the score is the share of good labels (1 where there are none); equal rows are scored each; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

#: Labelled documents that a fit uses at most.
MAX_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: str = "text") -> dict[str, Column]:
    """The statistics' names and columns; each is bounded or a ratio, and 0 for an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)).cast("double")

    def share(pattern: str, of: Column) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double") / of

    return {
        "n_words": F.log1p(F.regexp_count(t, F.lit(r"\S+")).cast("double")),
        "word_chars": F.length(t) / words,
        "upper": share(r"\p{Lu}", n),
        "digits": share(r"[0-9]", n),
        "bars": share(r"\|", words),
        "symbols": share(r"[#$%&*@^~<>{}\[\]=+_/\\]", words),
        "shouts": share(r"[!?]", words),
        "stops": share(r"[.,;:]", words),
        "lines": share(r"\n", words),
        "echoes": share(r"(?i)(?<!\S)(\S+)(?=\s+\1(?!\S))", words),
        "distinct": F.size(F.array_distinct(F.split(t, r"\s+"))) / words,
    }


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def column(self) -> Column:
        """The score, over columns named as the statistics."""
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            cond = F.lit(True)
            for name, op, at in rule:
                cond = cond & (F.col(name) <= at if op == "<=" else F.col(name) > at)
            total = total + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, names: list[str], x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + _fires(self.rules, names, x) @ np.asarray(self.weights)) if self.rules else np.full(len(x), _sigmoid(self.intercept))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fires(rules: list[Rule], names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for name, op, at in rule:
            v = x[:, names.index(name)]
            out[:, k] *= v <= at if op == "<=" else v > at
    return out


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, names: list[str], depth: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on gradients: its paths (inner nodes' too) and its step for every row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        best, at = 1e-3, None
        if len(path) < depth and len(rows) >= 20:
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                gs, hs = (np.cumsum(np.bincount(bins[rows, f], v[rows], k))[:-1] for v in (grad, hess))
                ns = np.cumsum(np.bincount(bins[rows, f], minlength=k))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 5) | (len(rows) - ns < 5)] = 0
                if len(gain) and gain.max() > best:
                    best, at = gain.max(), (f, int(gain.argmax()))
        if at is None:
            step[rows] = -g / (h + 1)
            return
        f, c = at
        low = bins[rows, f] <= c
        cut = (names[f], float(cuts[f][c]))
        grow(rows[low], (*path, (cut[0], "<=", cut[1])))
        grow(rows[~low], (*path, (cut[0], ">", cut[1])))

    grow(np.arange(len(x)), ())
    return rules, step


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights of a logistic regression under an l1 penalty, by accelerated proximal steps; the intercept is free."""
    n, k = a.shape
    a1 = np.c_[np.ones(n), a]
    rate = 4 * n / np.linalg.eigvalsh(a1.T @ a1)[-1]  # the largest singular value, squared
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        z = v - rate * (a1.T @ (_sigmoid(a1 @ v) - y)) / n
        z[1:] = np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = z + (old - 1) / t * (z - w), z
    return w[0], w[1:]


def fit(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 1) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(30.0, [], [])
    if y.min() == y.max():
        return RuleEnsemble(30.0 if y[0] else -30.0, [], [])
    rnd = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64))) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = _sigmoid(margin)
        use = rnd.random(len(y)) < 0.7
        rules, step = _tree(x, bins, cuts, (p - y) * use, p * (1 - p) * use, names, depth)
        found |= dict.fromkeys(rules)
        margin += 0.3 * step
    a = _fires(list(found), names, x) > 0  # one byte a cell until most rules are gone
    _, first = np.unique(a, axis=1, return_index=True)  # rules that fire alike count once
    share = a.mean(axis=0)
    own = sorted(i for i in first if 0.002 <= share[i] <= 0.998)
    rules, a = [list(found)[i] for i in own], a[:, own].astype(float)
    check = rnd.random(len(y)) < 0.25
    best = (np.inf, 0.0)
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3, 3e-4):
        b, w = _lasso(a[~check], y[~check], penalty)
        p = np.clip(_sigmoid(b + a[check] @ w), 1e-6, 1 - 1e-6)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = _lasso(a, y, best[1], 1500)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(float(b), [rules[i] for i in keep], [float(w[i]) for i in keep])


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """A model from the labelled documents that aren't held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~is_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the documented bound, so it may be broadcast
    stats = statistics()
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "_y", *(c.alias(k) for k, c in stats.items()))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "n_words", "word_chars").limit(max_rows).toPandas()
    common.sweep(docs.sparkSession)  # the fit takes memory beside the driver's JVM
    model = fit(list(stats), got[list(stats)].to_numpy(float), got["_y"].to_numpy(float))
    common.trim()
    return model


def scored(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns with score and predicted, which replace columns of these names."""
    stats = statistics()
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(F.struct(*kept).alias("_doc"), *(c.alias(k) for k, c in stats.items()))
    rows = rows.select("_doc", model.column().alias("_score"))
    return rows.select("_doc.*", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject, as they were."""
    stats = statistics()
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), *(c.alias(k) for k, c in stats.items()))
    return rows.where(model.column() >= threshold).select("_doc.*")


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit_on(docs, common.table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text")
    return scored(rows, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
