"""Quality classifier: a sparse rule ensemble.

Statistics of a text are Spark column expressions. Shallow boosted trees are grown over
them for a bounded sample of labelled documents; every path from a root to a node is a
conjunctive rule; a logistic model with an L1 penalty gives most rules weight zero; the
rest are compiled back to Spark column expressions, so scoring is one pass of built-in
functions over all documents and ships no model.

Only the sample's statistics reach the driver: at most ``SAMPLE`` rows, chosen by a hash
of doc_id among labelled documents that are not held out.

Defined results: a null or empty text has all statistics zero and a score; a text of any
length is split and scored whole; of a labelled id that repeats, the smallest text is learned; a document is
held out if crc32 of its id as text modulo 3 is 1, and a null id is never held out nor
learned from; where labels repeat, the largest counts, and null labels count as none;
without labels of both classes every score is the share of label 1 (0.5 if there is
none); repeated rows are scored alike; other columns pass through ``scored``, but ones
named score, held_out or predicted are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh

#: Labelled documents, at most, that trees and weights are fitted on.
SAMPLE = 20_000
TREES, DEPTH, SHRINK, BINS = 40, 3, 0.3, 32
PENALTY, STEPS = 0.002, 400
FOLDS, HELD = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def statistics(text: Column, t_: str = "_t", w_: str = "_w") -> tuple[dict[str, Column], dict[str, Column]]:
    """Two steps of columns: the text and its words, then the statistics over them."""
    whole = F.coalesce(text, F.lit(""))
    bare = F.btrim(whole, F.lit(" \t\n\x0b\x0c\r"))
    first = {t_: whole, w_: F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))}
    t, w = F.col(t_), F.col(w_)
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    of = lambda pattern: (F.size(F.split(t, pattern, -1)) - 1) / n
    adjacent = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b)
    second = {
        "words": F.size(w).cast("double"),
        "word_length": F.length(t) / n,
        "distinct": F.size(F.array_distinct(w)) / n,
        "repeats": F.size(F.filter(adjacent, lambda x: x)) / n,
        "short": F.size(F.filter(w, lambda x: F.length(x) <= 3)) / n,
        "pipes": of("\\|"),
        "bangs": of("!"),
        "symbols": of("[#$%&*@~^=<>_{}\\[\\]\\\\+]+"),
        "capitals": of("[A-Z]"),
        "digits": of("[0-9]+"),
        "stops": of("[.?]"),
        "commas": of(","),
        "lines": of("\n"),
    }
    return first, second


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` with a struct of the statistics, their names, and what the struct is called.

    The struct comes out of a generator of one row: a filter on a score over it can't be
    pushed below and there work out every statistic anew for each rule that names it.
    """
    t_, w_, s_ = fresh(docs, "_t", "_w", "_s")
    first, second = statistics(F.col("text"), t_, w_)
    packed = F.struct(*[c.alias(k) for k, c in second.items()])
    return docs.withColumns(first).withColumn(s_, F.explode(F.array(packed))).drop(t_, w_), list(second), s_


# A rule is a tuple of conditions (feature, above, threshold): x > threshold if above, else x <= threshold.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray, least: int) -> None:
    """A Newton tree on gradients; ``out`` gets the leaf values, ``rules`` every path but the root's."""
    if path:
        rules.append(path)
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, cuts in enumerate(edges):
            if not len(cuts):
                continue
            c = codes[rows, j]
            sum_g = np.bincount(c, g[rows], len(cuts) + 1).cumsum()[:-1]
            sum_h = np.bincount(c, h[rows], len(cuts) + 1).cumsum()[:-1]
            count = np.bincount(c, minlength=len(cuts) + 1).cumsum()[:-1]
            gain = sum_g**2 / (sum_h + 1) + (total_g - sum_g) ** 2 / (total_h - sum_h + 1) - total_g**2 / (total_h + 1)
            gain[(count < least) | (len(rows) - count < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] < 0:
        out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    _, j, k = best
    below, cut = codes[rows, j] <= k, float(edges[j][k])
    for above, part in ((False, rows[below]), (True, rows[~below])):
        _grow(codes, edges, g, h, part, depth - 1, (*path, (j, above, cut)), rules, out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct rules of boosted trees, each grown on a random half of the rows."""
    edges = [np.unique(np.round(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]), 6)) for c in x.T]
    edges = [e[(e >= c.min()) & (e < c.max())] for e, c in zip(edges, x.T, strict=True)]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    rng, score, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows, out, own = np.flatnonzero(rng.random(len(y)) < 0.5), np.zeros(len(y)), []
        _grow(codes, edges, p - y, p * (1 - p), rows, DEPTH, (), own, out, max(3, len(y) // 500))
        rules += own
        # the rows left out learn from the tree's leaves too
        leaves = [r for r in own if not any(r == q[: len(r)] and len(q) > len(r) for q in own)]
        for r in leaves:
            hit = covered(x, r)
            seen = rows[hit[rows]]
            if len(seen):
                score[hit] += SHRINK * out[seen[0]]
    return list(dict.fromkeys(rules))


def covered(x: np.ndarray, rule: Rule) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for j, above, cut in rule:
        hit &= x[:, j] > cut if above else x[:, j] <= cut
    return hit


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    n, k = z.shape
    step = 4.0 / max(1e-9, np.linalg.norm(np.hstack([np.ones((n, 1)), z]), 2) ** 2 / n)
    w = np.zeros(k + 1)
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(ahead[0] + z @ ahead[1:]))) - y
        new = ahead - step * np.append(miss.mean(), z.T @ miss / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    """Intercept and the rules with a weight other than zero."""

    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    @staticmethod
    def fitted(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or share in (0.0, 1.0):
            return RuleEnsemble(names, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        kept: dict[bytes, Rule] = {}
        for r in sorted(tree_rules(x, y), key=len):  # of rules that cover the same rows the shortest
            hit = covered(x, r)
            if 0 < hit.sum() < len(hit):
                kept.setdefault(np.packbits(hit).tobytes(), r)
        rules = list(kept.values())
        if not rules:
            return RuleEnsemble(names, float(np.log(share / (1 - share))))
        z = np.stack([covered(x, r) for r in rules], axis=1).astype(np.float64)
        intercept, weights = lasso_logistic(z, y)
        return RuleEnsemble(names, intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * covered(x, r) for r, w in self.rules), np.zeros(len(x)))

    def score(self, of: str = "_s") -> Column:
        """The compiled score over a struct of statistics."""
        terms = [F.lit(self.intercept)]
        for rule, weight in self.rules:
            parts = [F.col(f"{of}.{self.names[j]}") > F.lit(cut) if above else F.col(f"{of}.{self.names[j]}") <= F.lit(cut) for j, above, cut in rule]
            terms.append(F.when(reduce(lambda a, b: a & b, parts), F.lit(weight)).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fitted on the documents that are labelled and not held out, ``sample`` at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a top-k on each task, then one of those
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    texts = texts.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # of repeated ids one text, so that no more rows reach the driver
    told, names, s_ = with_statistics(texts)
    rows = told.select("doc_id", "_y", *[F.col(f"{s_}.{n}").alias(n) for n in names]).toPandas().sort_values("doc_id")
    return RuleEnsemble.fitted(names, rows[names].to_numpy(dtype=np.float64).reshape(-1, len(names)), rows["_y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` with score, held_out and predicted."""
    told, _, s_ = with_statistics(docs)
    out = told.withColumn("score", model.score(s_)).drop(s_).withColumn("held_out", held_out(F.col("doc_id")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """Every document's score by the rules learned from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", "held_out", "score", "predicted")
