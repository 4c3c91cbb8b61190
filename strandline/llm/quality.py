"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small trees are boosted on a bounded sample of labelled rows, every path in them becomes
a rule (a conjunction of thresholds), a lasso logistic regression keeps a few of the rules,
and these are compiled into one Spark column expression.  Statistics and scores are Spark
expressions over whole texts; only the statistics of the sample reach the driver.

Rows: a null text counts as empty, and an empty text has statistics of zero, so it gets a
score like any other.  A null doc_id is scored but never learnt from.  Repeated rows get
equal scores.  A label that is null is skipped; without labels of both classes the score
is the smoothed share of label 1.  Columns other than doc_id and text take no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_row, kept, row_column, unpacked

#: Labelled rows that the trees and the weights are fitted on, at most.
SAMPLE = 20_000
FOLDS = 5


def _count(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text holds, by plain replacement."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars[1:]), F.length(text) - F.length(F.replace(text, F.lit(chars[0]), F.lit(""))))


def statistics(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """``rows`` with ``stats``, an array of doubles in the order of NAMES, of ``text``, by default their column of that name."""
    names = rows.columns
    base = rows.withColumn("t_", F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")))
    base = base.withColumn("w_", F.filter(F.split("t_", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    raw = {
        "chars": F.length("t_"),
        "words": F.size("w_"),
        "distinct": F.size(F.array_distinct("w_")),
        "lines": _count(F.col("t_"), "\n") + 1,
        "bars": _count(F.col("t_"), "|"),
        "bangs": _count(F.col("t_"), "!"),
        "symbols": _count(F.col("t_"), "*#%$&"),
        "stops": _count(F.col("t_"), "."),
        "commas": _count(F.col("t_"), ","),
        "upper": F.regexp_count("t_", F.lit("[A-Z]")),
        "digits": F.regexp_count("t_", F.lit("[0-9]")),
    }
    base = base.select(*names, F.struct(*(v.cast("double").alias(k) for k, v in raw.items())).alias("r_"))
    r = lambda k: F.col(f"r_.{k}")
    share = lambda a, b: F.when(r(b) > 0, r(a) / r(b)).otherwise(F.lit(0.0))
    cols = [
        r("words"), share("chars", "words"), share("distinct", "words"), share("words", "lines"), share("bars", "words"), share("bangs", "words"),
        share("symbols", "words"), share("stops", "words"), share("commas", "words"), share("upper", "chars"), share("digits", "chars"),
        r("bars"), r("bangs"), r("symbols"), r("upper"), r("words") - r("distinct"),
    ]
    return base.withColumn("stats", F.array(*cols)).drop("r_")


NAMES = ["words", "word_length", "distinct_share", "words_a_line", "bars_share", "bangs_share", "symbols_share", "stops_share", "commas_share", "upper_share", "digit_share", "bars", "bangs", "symbols", "upper", "repeats"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.terms:
            out &= (x[:, k] > at) == above
        return out

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for k, above, at in self.terms:
            v = F.col(stats)[k]
            out = out & ((v > F.lit(at)) if above else (v <= F.lit(at)))
        return out


@dataclass
class Model:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self, stats: str = "stats") -> Column:
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule.column(stats), F.lit(float(w))).otherwise(F.lit(0.0))
        z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, least: int):
    """The best (gain, statistic, threshold) for gradients g and curvatures h."""
    best, total = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + 1)
    for k, e in enumerate(edges):
        if not len(e):
            continue
        gl = np.cumsum(np.bincount(binned[:, k], g, len(e) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, k], h, len(e) + 1))[:-1]
        nl = np.cumsum(np.bincount(binned[:, k], minlength=len(e) + 1))[:-1]
        ok = (nl >= least) & (len(x) - nl >= least)
        gain = np.where(ok, gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total, 0)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), k, float(e[i]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, seed: int = 7) -> list[Rule]:
    """The paths to every node of boosted trees, as distinct rules."""
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        todo = [(rows, np.arange(len(y)), ())]
        while todo:
            inside, every, path = todo.pop()
            found = _split(x[inside], g[inside], h[inside], edges, binned[inside], least) if len(path) < depth and len(inside) >= 2 * least else (0, -1, 0)
            if found[1] < 0:
                z[every] += 0.3 * np.clip(g[inside].sum() / (h[inside].sum() + 1), -4, 4)
                continue
            _, k, at = found
            for above in (False, True):
                longer = (*path, (k, above, at))
                rules.setdefault(tuple(sorted(longer)), Rule(longer))
                todo.append((inside[(x[inside, k] > at) == above], every[(x[every, k] > at) == above], longer))
    return list(rules.values())


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty on mean loss, by accelerated proximal gradient."""
    w, b = np.zeros(r.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    step = 4 / (np.linalg.norm(r, 2) ** 2 / len(y) + 1)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(r @ vw + vb, -30, 30))) - y) / len(y)
        nw, nb = vw - step * (r.T @ d), vb - step * d.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4) -> Model:
    """Rules and weights for statistics ``x`` and labels ``y`` (0 or 1)."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = tree_rules(x, y)
    if not rules:
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    r = np.stack([q.holds(x) for q in rules], axis=1).astype(float)
    bias, w = lasso(r, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Model(bias, [rules[i] for i in keep], [float(w[i]) for i in keep])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out, chosen by hash."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y_")).where("doc_id is not null and y_ in (0, 1)")
    lab = lab.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y_").alias("y_"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = statistics(text.join(F.broadcast(chosen), "doc_id").select("doc_id", "y_", "text"), F.col("text")).select("doc_id", "y_", "stats")
    # A doc_id with several texts gives several rows; the sample stays bounded all the same.
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("stats")).limit(sample).collect()
    x = np.array([r["stats"] for r in got], float).reshape(len(got), len(NAMES))
    return fit(x, np.array([r["y_"] for r in got], float))


def _scores(docs: DataFrame, model: Model) -> DataFrame:
    """(row_, stats, score), the columns of ``docs`` put away in ``row_``."""
    return statistics(as_row(docs), row_column("text")).withColumn("score", model.column())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``stats`` and ``score``; columns of these names that it has already are left out."""
    names = [c for c in docs.columns if c.lower() not in ("stats", "score")]
    return _scores(docs, model).select(*(row_column(c).alias(c) for c in names), "stats", "score")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with the columns they had."""
    return unpacked(kept(_scores(docs, model), F.col("score") >= least), docs.columns)
