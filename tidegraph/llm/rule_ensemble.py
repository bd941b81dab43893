"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of a text (ratios of the quality rules' counts) are built-in column
expressions.  On a bounded sample of labelled rows the driver grows small trees by
gradient boosting, takes every path from a root to a node as a conjunctive rule, adds
the winsorized statistics themselves as linear terms, and fits logistic weights under a
lasso penalty, which leaves a short list of rules.  The list is compiled into one column
expression, so scoring is a projection: no user function, no shuffle.

The sample is at most ``max_rows`` labelled rows, chosen by a hash of the id, which is a
parameter of the fit; scoring covers every row.  Null and empty texts have all
statistics at zero and get a score like any other.  Without labels, or with labels of one
class, the score is the smoothed share of good labels.  Labels that repeat or contradict
each other all count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import materialise

MAX_ROWS = 20_000
TREES, DEPTH, SHRINK = 40, 3, 0.3
THRESHOLDS = 16
MIN_LEAF = 0.01
PENALTIES = (0.03, 0.01, 0.003, 0.001)
STEPS = 400


@dataclass(frozen=True)
class Condition:
    """``feature <= at``, or ``feature > at``."""

    feature: str
    at: float
    below: bool


@dataclass
class Model:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)  # feature, low, high, weight per unit

    def column(self, features: dict[str, Column]) -> Column:
        """The probability as a column expression."""
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for c in conditions:
                holds &= (features[c.feature] <= c.at) if c.below else (features[c.feature] > c.at)
            total += F.when(holds, float(weight)).otherwise(0.0)
        for name, low, high, weight in self.linear:
            total += F.greatest(F.lit(low), F.least(F.lit(high), features[name])) * float(weight)
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def statistics(text: Column) -> Column:
    """The statistics of a text as one struct of doubles."""
    from .common import let

    def ratios(m: Column) -> Column:
        count = {n: m[n] for n in quality.COUNTS}
        found = dict(quality.metrics(count))
        per_word = lambda n: F.coalesce(F.try_divide(count[n].cast("double"), count["n_words"].cast("double")), F.lit(0.0))
        found["log_words"] = F.log1p(count["n_words"].cast("double"))
        found["repeat_word_ratio"] = per_word("n_repeat_words")
        found["lines_per_word"] = per_word("n_lines")
        return F.struct(*(c.cast("double").alias(n) for n, c in found.items()))

    return let(quality.measure(text), ratios)


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> tuple | None:
    """The (gain, feature, cut) that lowers the loss most."""
    least = max(5, int(MIN_LEAF * len(x)))
    g, h = grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    best = None
    for f, at in enumerate(cuts):
        if not len(at) or len(rows) < 2 * least:
            continue
        where = np.searchsorted(at, x[rows, f], side="left")
        gs = np.cumsum(np.bincount(where, g, len(at) + 1))[:-1]
        hs = np.cumsum(np.bincount(where, h, len(at) + 1))[:-1]
        ns = np.cumsum(np.bincount(where, minlength=len(at) + 1))[:-1]
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        gain[(ns < least) | (len(rows) - ns < least)] = -1.0
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float(at[k]))
    return best


def _grow(x, grad, hess, rows, cuts, names, path, depth, out, update) -> None:  # noqa: ANN001
    """Adds the paths below ``path`` to ``out`` and the leaf steps to ``update``."""
    found = _split(x, grad, hess, rows, cuts) if depth else None
    if found is None:
        update[rows] = -SHRINK * grad[rows].sum() / (hess[rows].sum() + 1.0)
        return
    _, f, at = found
    low = x[rows, f] <= at
    for below, part in ((True, rows[low]), (False, rows[~low])):
        longer = (*path, Condition(names[f], at, below))
        out.append(longer)
        _grow(x, grad, hess, part, cuts, names, longer, depth - 1, out, update)


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, THRESHOLDS), method="lower")) for f in range(x.shape[1])]
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), math.log(base / (1 - base)))
    rules: list[tuple[Condition, ...]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        update = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), np.arange(len(y)), cuts, names, (), DEPTH, rules, update)
        score += update
    return list(dict.fromkeys(rules))


def _holds(rule: tuple[Condition, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        column = x[:, names.index(c.feature)]
        out &= (column <= c.at) if c.below else (column > c.at)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the logistic loss with an l1 penalty on all weights but the bias."""
    bias, w = start
    step = 4.0 / (np.linalg.norm(np.c_[np.ones(len(z)), z], 2) ** 2 / len(z) + 1e-12)
    vb, vw, t = bias, w.copy(), 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-np.clip(vb + z @ vw, -30, 30))) - y
        nb = vb - step * r.mean()
        nw = vw - step * (z.T @ r) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - bias), nw + (t - 1) / nt * (nw - w)
        bias, w, t = nb, nw, nt
    return bias, w


def _loss(z: np.ndarray, y: np.ndarray, bias: float, w: np.ndarray) -> float:
    s = np.clip(bias + z @ w, -30, 30)
    return float(np.mean(np.log1p(np.exp(-s)) * y + np.log1p(np.exp(s)) * (1 - y)))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Rules and weights from a matrix of statistics and labels of 0 and 1; the penalty is chosen on a fifth of the rows."""
    good = int(y.sum()) if len(y) else 0
    if good in (0, len(y)):
        share = (good + 1) / (len(y) + 2)
        return Model(math.log(share / (1 - share)))
    rules = extract_rules(x, y, names)
    held = np.arange(len(y)) % 5 == 4
    hits = np.stack([_holds(r, x, names) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(hits, axis=1, return_index=True)  # rules that hold on the same rows are one
    rules, hits = [rules[i] for i in sorted(first)], hits[:, sorted(first)]
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.where((high - low) > 0, high - low, np.inf)
    linear = np.clip(x, low, high) / spread
    z = np.c_[hits, linear]
    middle, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale == 0] = np.inf
    standard = (z - middle) / scale
    best, state = None, (math.log(good / (len(y) - good)), np.zeros(z.shape[1]))
    fits = []
    for penalty in PENALTIES:
        state = _lasso(standard[~held], y[~held], penalty, state)
        fits.append((penalty, _loss(standard[held], y[held], *state)))
    best = min(fits, key=lambda p: p[1])[0]
    state = (math.log(good / (len(y) - good)), np.zeros(z.shape[1]))
    for penalty in PENALTIES[: PENALTIES.index(best) + 1]:
        state = _lasso(standard, y, penalty, state)
    bias, w = state
    weight = w / scale
    model = Model(float(bias - (weight * middle).sum()))
    model.rules = [(r, float(weight[i])) for i, r in enumerate(rules) if abs(w[i]) > 1e-6]
    k = len(rules)
    model.linear = [
        (name, float(low[i]), float(high[i]), float(weight[k + i] / spread[i]))
        for i, name in enumerate(names) if abs(w[k + i]) > 1e-6
    ]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> tuple[DataFrame, Model]:
    """((doc_id, held_out, score, predicted) per input row, and the model)."""
    measured = df.select(F.col(id_col).cast("long").alias("doc_id"), statistics(F.col(text_col)).alias("s"))
    measured = materialise(measured, "statistics")
    names = measured.schema["s"].dataType.fieldNames()
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = (
        measured.join(known.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows).toArrow()
    )
    y = rows.column("label").to_numpy().astype(float)
    s = rows.column("s").combine_chunks()
    x = np.stack([s.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if len(y) else np.zeros((0, len(names)))
    model = fit(x, y, names)
    score = model.column({n: F.col(f"s.{n}") for n in names})
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model
