"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics are Spark expressions.  Small boosted trees are grown on at most TRAIN_ROWS labelled
rows (the bound of what reaches the driver: one short row of numbers each); every path from a
root becomes a rule, a conjunction of at most DEPTH comparisons; a lasso logistic regression keeps
few of them; the kept rules are compiled into one Spark expression, so scoring never leaves the
JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.labels import fold, training_rows
from veilgrain.llm.text import WORD

TRAIN_ROWS = 8000
TREES, DEPTH, CUTS, SHRINKAGE, LEAST_IN_LEAF = 40, 3, 32, 0.2, 10
LASSO, LASSO_STEPS = 2e-4, 400
PREDICT_FROM = 0.3

STATISTICS = (
    "log_words",
    "word_length",
    "symbol_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "distinct_share",
    "echo_share",
    "repeated_line_share",
    "words_per_line",
    "stop_share",
    "lone_symbol_share",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with the columns STATISTICS, all finite; a null text counts as empty.  The text must be
    called text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x != ""))
    df = df.withColumn("_n", F.greatest(F.size("_w"), F.lit(1)).cast("double")).withColumn("_c", F.greatest(F.length("_t"), F.lit(1)).cast("double"))

    def gone(pattern: str) -> Column:
        return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))) / F.col("_c")

    lines = F.greatest(F.size("_l"), F.lit(1))
    found = {
        "log_words": F.log1p(F.size("_w")),
        "word_length": F.length(F.array_join("_w", "")) / F.col("_n"),
        "symbol_share": (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))) / F.col("_c"),
        "upper_share": gone(r"\p{Lu}+"),
        "digit_share": gone("[0-9]+"),
        "mark_share": (F.length("_t") - F.length(F.translate("_t", "!?", ""))) / F.col("_c"),
        "distinct_share": F.size(F.array_distinct("_w")) / F.col("_n"),
        "echo_share": F.size(F.expr("filter(_w, (x, i) -> i > 0 and x = _w[i - 1])")) / F.col("_n"),
        "repeated_line_share": (F.size("_l") - F.size(F.array_distinct("_l"))) / lines,
        "words_per_line": F.log1p(F.col("_n") / lines),
        "stop_share": F.size(F.filter("_w", lambda x: x.endswith("."))) / F.col("_n"),
        "lone_symbol_share": F.size(F.filter("_w", lambda x: (F.length(x) == 1) & ~F.rlike(x, F.lit(r"[\p{L}\p{N}]")))) / F.col("_n"),
    }
    return df.withColumns({k: found[k].cast("double") for k in STATISTICS}).drop("_t", "_w", "_l", "_n", "_c")


Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether above, cut


@dataclass
class Ensemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def margin(self) -> Column:
        """The compiled rules."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for statistic, above, cut in rule:
                c = F.col(STATISTICS[statistic])
                hit = hit & ((c > F.lit(cut)) if above else (c <= F.lit(cut)))
            z = z + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        return z

    def describe(self) -> list[tuple[str, float]]:
        """The rules as text with their weights, heaviest first."""
        said = [(" and ".join(f"{STATISTICS[s]} {'>' if up else '<='} {cut:.6g}" for s, up, cut in r), w) for r, w in zip(self.rules, self.weights, strict=True)]
        return sorted(said, key=lambda x: -abs(x[1]))


def _paths(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, own: np.ndarray, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """Grows one tree below `path`, noting every path and each row's leaf value in `step`."""
    g, h = slope[own].sum(), curve[own].sum()
    step[own] = -g / (h + 1.0)
    if path:
        out.append(path)
    if len(path) == DEPTH or len(own) < 2 * LEAST_IN_LEAF:
        return
    best, where = 1e-6, None
    for s in range(x.shape[1]):
        if not len(cuts[s]):
            continue
        b, size = bins[own, s], len(cuts[s]) + 1
        gl = np.cumsum(np.bincount(b, weights=slope[own], minlength=size))[:-1]
        hl = np.cumsum(np.bincount(b, weights=curve[own], minlength=size))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < LEAST_IN_LEAF) | (len(own) - nl < LEAST_IN_LEAF)] = 0
        if gain.max() > best:
            best, where = gain.max(), (s, int(gain.argmax()))
    if where:
        s, k = where
        low = bins[own, s] <= k
        for above, part in ((False, own[low]), (True, own[~low])):
            _paths(x, bins, cuts, slope, curve, part, (*path, (s, above, float(cuts[s][k]))), out, step)


def learn(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and lasso weights for statistics `x` (rows by STATISTICS) and labels `y` of 0 and 1."""
    if len(set(y)) < 2:
        return Ensemble(bias=float(4 * y.mean() - 2) if len(y) else 0.0)
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, CUTS + 2)[1:-1])) for s in range(x.shape[1])]
    for s, c in enumerate(cuts):
        cuts[s] = c[c < x[:, s].max()]
    bins = np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)], axis=1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    z, rules, draw = np.full(len(y), prior), [], np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        part = np.sort(draw.permutation(len(y))[: max(2 * LEAST_IN_LEAF, len(y) * 2 // 3)])
        step = np.zeros(len(y))
        _paths(x, bins, cuts, p - y, p * (1 - p), part, (), rules, step)
        z = z + SHRINKAGE * step
    rules = list(dict.fromkeys(rules))
    hits = np.ones((len(y), len(rules)), dtype=np.float32)
    for k, rule in enumerate(rules):
        for s, above, cut in rule:
            hits[:, k] *= (x[:, s] > cut) if above else (x[:, s] <= cut)
    weights, bias = _lasso(hits, y, prior)
    chosen = np.flatnonzero(weights)
    return Ensemble([rules[k] for k in chosen], [float(weights[k]) for k in chosen], bias)


def _lasso(hits: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    v = np.ones(hits.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest eigenvalue gives the step
        v = hits.T @ (hits @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / (float(np.linalg.norm(hits @ v)) ** 2 + n)
    w, held, t, b = np.zeros(hits.shape[1]), np.zeros(hits.shape[1]), 1.0, bias
    for _ in range(LASSO_STEPS):
        error = 1 / (1 + np.exp(-(hits @ held + b))) - y
        b -= rate * error.mean()
        moved = held - rate * (hits.T @ error) / n
        after = np.sign(moved) * np.maximum(np.abs(moved) - rate * LASSO, 0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        held = after + (t - 1) / t_after * (after - w)
        w, t = after, t_after
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    rows = with_statistics(training_rows(docs, labels, label, TRAIN_ROWS)).select("doc_id", "label", *STATISTICS).toArrow().sort_by([("doc_id", "ascending")])
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return learn(x, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text; other columns are
    ignored).  Null and empty texts have statistics of zero and are scored by the same rules; repeated
    rows each get a row; an ensemble without rules gives every text the same score."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_statistics(own).select("doc_id", (1 / (1 + F.exp(-ensemble.margin()))).alias("score"))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
