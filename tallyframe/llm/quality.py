"""Quality by a sparse ensemble of rules over text statistics.

1. Statistics of whole texts, as Spark columns: `statistics`.
2. On the driver, from a bounded sample of labelled rows (FIT_ROWS, a few numbers each): shallow trees are grown on
   bootstrap samples, each over some of the statistics; every path to a node is a conjunctive rule.
3. A lasso logistic regression over the rules gives weights, most of them zero.
4. The remaining rules are compiled into Spark column expressions; a score is a logistic function of their weighted sum. All
   texts are thus scored inside the JVM.

Cases: null and empty texts have zeros for statistics and are scored like any other; texts of any length are read whole. Without
labelled rows of both classes the score is the share of class 1, or 0.5 without any. Repeated rows are scored each, equal texts
alike. Of cuts with equal gains the first is taken, in the order of the statistics drawn for the tree, then of rising bounds; the
draws are those of a fixed seed. An empty table gives no rows. Other columns are ignored, whatever their names, but for those that
are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: The most labelled rows that are learned from, and that a tree draws of them (with repeats).
FIT_ROWS, TREE_ROWS = 20_000, 4000


def _share(pattern: str) -> Column:
    return F.regexp_count("t", F.lit(pattern)) / (F.col("n") + 1)


#: The statistics, in the order of statistics().
NAMES = ("length", "words", "distinct", "word_length", "upper", "digits", "stops", "marks", "symbols", "lines", "repeats")


def statistics() -> dict[str, Column]:
    """Name and column of each statistic; t is the text, n its length, w its words, k the number of words."""
    columns = (
        F.log1p("n"),
        F.log1p("k"),
        F.size(F.array_distinct("w")) / (F.col("k") + 1),
        F.col("n") / (F.col("k") + 1),
        _share("[A-Z]"),
        _share("[0-9]"),
        _share("[.,;:]"),
        _share("[!?]"),
        _share(r"[#$%&*@^~_=+<>|\\/{}\[\]]"),
        _share("\n"),
        _share(r"(?<![^ \n])([^ \n]+) \1(?![^ \n])"),
    )
    return dict(zip(NAMES, columns, strict=True))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and one column for each statistic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("t"), F.length(text).alias("n"), F.filter(F.split(text, "[ \n\t]+"), lambda x: x != "").alias("w"))
    rows = rows.select(*keep, "t", "n", "w", F.size("w").alias("k"))
    return rows.select(*keep, *[c.cast("double").alias(name) for name, c in statistics().items()])


@dataclass(frozen=True)
class Term:
    """One condition of a rule: a statistic above, or not above, a bound."""

    name: str
    above: bool
    bound: float


@dataclass
class Rules:
    intercept: float
    rules: list[tuple[tuple[Term, ...], float]]

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        z = F.lit(float(self.intercept))
        for terms, weight in self.rules:
            every = None
            for t in terms:
                one = F.col(t.name) > t.bound if t.above else F.col(t.name) <= t.bound
                every = one if every is None else every & one
            z = z + F.when(every, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], use: np.ndarray, depth: int, least: int, terms: tuple[Term, ...] = ()) -> list[tuple[Term, ...]]:
    """The paths of one tree, by the largest fall in Gini impurity; bounds lie between quantiles."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return []
    best = (1e-9, None, 0.0)
    base = y.mean() * (1 - y.mean())
    for j in use:
        for b in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))):
            high = x[:, j] > b
            n = int(high.sum())
            if n < least or len(y) - n < least:
                continue
            p, q = y[high].mean(), y[~high].mean()
            gain = base - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            if gain > best[0]:
                best = (gain, j, float(b))
    _, j, b = best
    if j is None:
        return []
    high = x[:, j] > b
    out = []
    for above, at in ((True, high), (False, ~high)):
        own = (*terms, Term(names[j], above, b))
        out += [own, *_paths(x[at], y[at], names, use, depth - 1, least, own)]
    return out


def _holds(rule: tuple[Term, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        v = x[:, names.index(t.name)]
        out &= v > t.bound if t.above else v <= t.bound
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 1500, least: float = 1e-5) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps, until one changes less than `least`. All in the precision of r."""
    kind = r.dtype.type
    y, w, v, b, c = y.astype(kind), np.zeros(r.shape[1], kind), np.zeros(r.shape[1], kind), 0.0, 0.0
    rate = 4 / (1 + np.linalg.norm((r.T @ r).astype(float), 2) / len(y))
    for t in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(r @ v + kind(c), -30, 30))) - y
        nw = v - kind(rate / len(y)) * (gap @ r)
        nw = np.sign(nw) * np.maximum(kind(0), np.abs(nw) - kind(rate * penalty))
        nb = c - rate * float(gap.mean())
        moved = max(float(np.abs(nw - w).max()), abs(nb - b))
        v, c = nw + kind(t / (t + 3)) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
        if t > 50 and moved < least:
            break
    return b, w


def fit(labelled: DataFrame, rows: int = FIT_ROWS, trees: int = 24, depth: int = 3, penalty: float = 1e-3, seed: int = 1) -> Rules:
    """Learns from labelled: doc_id, text, quality (0 or 1; other rows are left out)."""
    known = labelled.filter("quality in (0, 1)").select("doc_id", "text", F.col("quality").cast("double").alias("y"))
    names = list(NAMES)
    got = with_statistics(bounded_sample(known, F.col("doc_id"), rows), "doc_id", "y").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Rules(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [])
    x = got[names].to_numpy(float)
    rng = np.random.default_rng(seed)
    found: set[tuple[Term, ...]] = set()
    for _ in range(trees):
        at = rng.choice(len(y), min(len(y), TREE_ROWS))
        use = rng.choice(len(names), max(2, len(names) * 2 // 3), replace=False)
        found.update(_paths(x[at], y[at], names, use, depth, max(3, len(at) // 200)))
    rules = sorted(found, key=lambda r: (len(r), [(t.name, t.above, t.bound) for t in r]))
    held = np.array([_holds(r, x, names) for r in rules], np.float32).T
    if not rules:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))), [])
    b, w = lasso_logistic(held, y, penalty)
    return Rules(float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6])


def score(docs: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """The kept columns and score."""
    return with_statistics(docs, *keep).select(*keep, rules.column().alias("score"))
