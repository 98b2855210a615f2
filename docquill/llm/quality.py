"""A quality classifier as a sparse rule ensemble.

Statistics of a text are Spark column expressions. From a bounded sample of labelled rows a small boosted
forest is grown; every path from a root to a node is a rule, a conjunction of comparisons. A lasso logistic
regression over all rules keeps a few. The rules kept compile back into one Spark column expression, so
scoring whole tables needs no Python on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, CUTS, RATE, LASSO, STEPS = 40, 3, 24, 0.2, 5e-4, 400
SAMPLE_ROWS = 20_000  # most labelled rows that a fit looks at

Rule = tuple[tuple[int, float, bool], ...]  # (statistic, cut, above?)

STATISTICS = (
    "log_words", "word_length", "upper", "symbols", "bars", "exclaims", "digits", "breaks", "distinct_words", "repeats", "sentence_ends", "symbol_words",
)


def with_statistics(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep and one double for each of STATISTICS; a null text counts as empty, shares of nothing are 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(*keep, text.alias("_text"), F.array_remove(F.split(text, r"\s+"), "").alias("_words"))
    text, words = F.col("_text"), F.col("_words")
    chars, many = F.greatest(F.length(text), F.lit(1)).cast("double"), F.greatest(F.size(words), F.lit(1)).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    share = lambda pattern: (F.length(text) - without(pattern)) / chars
    single = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / chars
    values = (
        F.log1p(F.size(words).cast("double")), F.length(text) / many, share(r"\p{Lu}+"), share(r"[^\p{L}\p{N}\s]+"), single("|"), single("!"),
        share("[0-9]+"), single("\n"), F.size(F.array_distinct(words)) / many,
        F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / many,
        single("."), (F.length(text) - without(r"[#$%&*]{2,}")) / many,
    )
    return df.select(*keep, *(v.cast("double").alias(n) for n, v in zip(STATISTICS, values, strict=True)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Splits rows by the largest gain, notes the path of each node, and writes the leaves' values to out."""
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    best, where = 1e-6, None
    if len(path) < DEPTH and len(rows) >= 20:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            n = len(cuts[f])
            if not n:
                continue
            gs = np.cumsum(np.bincount(bins[rows, f], g[rows], n + 1))[:n]
            hs = np.cumsum(np.bincount(bins[rows, f], h[rows], n + 1))[:n]
            ns = np.cumsum(np.bincount(bins[rows, f], minlength=n + 1))[:n]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < 10) | (len(rows) - ns < 10)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (f, k)
    if where is None:
        out[rows] = value
        return
    f, k = where
    low = bins[rows, f] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        longer = (*path, (f, float(cuts[f][k]), above))
        rules.append(longer)
        _grow(x, g, h, bins, cuts, side, longer, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct paths of a boosted forest for the labels y (0 or 1)."""
    rng, margin, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        rows, step = np.flatnonzero(rng.random(len(y)) < 0.5), np.zeros(len(y))
        before = len(rules)
        _grow(x, g, h, bins, cuts, rows, (), rules, step)
        if len(rules) == before:
            break
        # rows left out of this tree get its values by its deepest matching path
        rest = np.setdiff1d(np.arange(len(y)), rows)
        for path in rules[before:]:
            hit = rows[fires(x[rows], path)]
            inside = rest[fires(x[rest], path)]
            if len(hit) and len(inside):
                step[inside] = step[hit].mean()
        margin += RATE * step * 5
    return list(dict.fromkeys(rules))


def fires(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, cut, above in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient; the intercept is not penalised."""
    z = np.hstack([np.ones((len(z), 1), np.float32), z.astype(np.float32)])
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / max(float(v @ (z.T @ (z @ v))), 1e-9)
    w = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead.astype(np.float32), -30, 30)))
        new = ahead - rate * (z.T @ (p - y).astype(np.float32)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 over the columns STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for f, cut, above in rule:
                c = F.col(STATISTICS[f])
                hit = hit & ((c > cut) if above else (c <= cut))
            total = total + F.when(hit, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model of labels y (0 or 1) from statistics x; with one class alone, or no rows, only a smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y)
    z = np.stack([fires(x, r) for r in rules], 1) if rules else np.zeros((len(y), 0), bool)
    intercept, weights = lasso_logistic(z, y)
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on at most sample_rows labelled rows, those of smallest hash; null labels, ids and unmatched rows are left out.

    A null text counts as empty, a long one by all its words. An id that several rows have gives one labelled
    row for each, within the bound; equal rows and ties count as often as they occur. Other columns are
    ignored. An empty table on either side gives a model without rules, whose score is 0.5.
    """
    own = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null")
    own = own.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)  # 16 bytes a row, so broadcast is bounded
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_raw")).join(F.broadcast(own), "_id")
    table = with_statistics(rows, "_raw", ["_id", "_label"]).orderBy(F.xxhash64("_id"), "_id", "_label", *STATISTICS).limit(sample_rows)
    table = table.toPandas().sort_values(["_id", "_label", *STATISTICS])
    return fit(table[list(STATISTICS)].to_numpy(np.float64), (table["_label"].to_numpy() == 1).astype(np.float64))


def scored(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of docs, repeated ones too; the score is the probability of label 1, never null.

    A null text is scored as an empty one, a row without an id like any other; other columns are ignored,
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"))
    return with_statistics(rows, "_raw", ["_id"]).select(F.col("_id").alias(id_col), model.score().alias("score"))
