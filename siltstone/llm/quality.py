"""Quality classifier: a sparse ensemble of rules.

1. Statistics of a text are Spark column expressions (lengths, shares of kinds of characters,
   shares of distinct words and lines).
2. On a bounded sample of labelled rows (``sample_rows``, the smallest by a hash of the id), shallow
   trees are grown over the statistics; every path from a root to a node is a conjunctive rule.
3. A logistic model with an L1 penalty gives each rule a weight, most of them 0.
4. The rules left over are compiled into one Spark column expression, which scores all texts without Python.

Defined results: a null text counts as empty and is scored like any other; without labels of both
classes the score is their smoothed mean for every row; an id on several rows is learned from once, with its
smallest label and the smallest statistics of its texts; rows with a null id or label are not learned from; result
columns replace input columns of the same name; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, read_table


#: Statistics, in the order in which the trees see them.
NAMES = (
    "log_chars", "word_length", "line_length", "distinct_words", "log_distinct_words", "distinct_lines",
    "upper", "digits", "symbols", "bars", "exclamations", "stops",
)


def with_statistics(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """``df`` with a column for each statistic of its text.  Words and lines are split in a step of their own, and
    columns are not packed into structs, so that the optimizer leaves them as they are: computed once."""
    kept = df.columns
    text, chars, words, lines, own_words, own_lines = (F.col(f"{prefix}{k}") for k in range(6))
    step = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(*kept, step.alias(f"{prefix}0"), F.split(F.trim(step), r"\s+").alias(f"{prefix}2"), F.split(step, "\n").alias(f"{prefix}3"))
    df = df.select(
        *kept,
        text,
        F.char_length(text).alias(f"{prefix}1"),
        F.size(words).alias(f"{prefix}2"),
        F.size(lines).alias(f"{prefix}3"),
        F.size(F.array_distinct(words)).alias(f"{prefix}4"),
        F.size(F.array_distinct(lines)).alias(f"{prefix}5"),
    )

    def share(of: str) -> Column:
        return F.regexp_count(text, F.lit(of)) / F.greatest(chars, F.lit(1))

    values = (
        F.log1p(chars),
        chars / words,
        F.log1p(chars / lines),
        own_words / words,
        F.log1p(own_words),
        own_lines / lines,
        *(share(of) for of in ("[A-Z]", "[0-9]", r"[#$%&*@^~<>{}\[\]\\/=_+]", r"[|]", "[!?]", "[.,;:]")),
    )
    return df.select(*kept, *(v.cast("double").alias(prefix + n) for n, v in zip(NAMES, values)))


@dataclass(frozen=True)
class Rule:
    """All of the conditions (statistic, is upper bound, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, prefix: str) -> Column:
        out = None
        for name, upper, at in self.conditions:
            c = F.col(prefix + name)
            c = c <= F.lit(at) if upper else c > F.lit(at)
            out = c if out is None else out & c
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))

    def __str__(self) -> str:
        return f"{self.weight:+.3f} if " + " and ".join(f"{n} {'<=' if u else '>'} {t:.4g}" for n, u, t in self.conditions)


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, prefix: str) -> Column:
        logit = F.lit(self.intercept)
        for rule in self.rules:
            logit = logit + rule.column(prefix)
        return 1 / (1 + F.exp(-logit))


def _grow(binned, y, rows, features, depth, rng, path, out, bins, least):
    """Adds the path of each node below ``rows`` to ``out`` (feature, is upper bound, bin)."""
    if path:
        out.add(tuple(sorted(path)))
    pos = y[rows].sum()
    if depth == 0 or len(rows) < 2 * least or pos in (0, len(rows)):
        return
    best = (1e-12, None, None)
    for f in rng.choice(features, max(1, 2 * features // 3), replace=False):
        n = np.bincount(binned[rows, f], minlength=bins).cumsum()[:-1]
        p = np.bincount(binned[rows, f], weights=y[rows], minlength=bins).cumsum()[:-1]
        m, q = len(rows) - n, pos - p
        ok = (n >= least) & (m >= least)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, p * p / n + q * q / m, 0) - pos * pos / len(rows)
        if gain.max() > best[0]:
            best = (gain.max(), int(f), int(gain.argmax()))
    if best[1] is None:
        return
    _, f, b = best
    low = binned[rows, f] <= b
    for upper, part in ((True, rows[low]), (False, rows[~low])):
        _grow(binned, y, part, features, depth - 1, rng, [*path, (f, upper, b)], out, bins, least)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept (accelerated proximal gradient)."""
    n, k = x.shape
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    y = y.astype(x.dtype)
    z = np.random.default_rng(0).normal(size=k).astype(x.dtype)
    for _ in range(20):  # the largest eigenvalue, for the step
        z = x.T @ (x @ z)
        norm = np.linalg.norm(z) or 1.0
        z /= norm
    step = 4.0 / (norm / n + 1.0)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(x @ v[1:].astype(x.dtype) + v[0]))) - y
        new = v - step * np.concatenate([[g.mean()], x.T @ g.astype(x.dtype) / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def fit(values: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, bins: int = 64, penalty: float = 4e-4, seed: int = 1) -> Model:
    if len(y) == 0 or y.min() == y.max():
        mean = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(mean / (1 - mean))), ())
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(len(names))]
    binned = np.stack([np.searchsorted(e, values[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(seed)
    least = max(5, len(y) // 500)
    paths: set = set()
    for _ in range(trees):
        _grow(binned, y, rng.integers(0, len(y), len(y)), len(names), depth, rng, [], paths, bins, least)
    rules = {}
    for path in sorted(paths):
        hit = np.ones(len(y), bool)
        for f, upper, b in path:
            hit &= (binned[:, f] <= b) == upper
        if least <= hit.sum() <= len(y) - least:
            rules.setdefault(hit.tobytes(), (path, hit))
    if not rules:
        return fit(values[:0], y[:0], names)
    x = np.stack([h for _, h in rules.values()], axis=1).astype(np.float32)
    intercept, w = _lasso(x, y, penalty)
    kept = [
        Rule(tuple((names[f], upper, float(edges[f][b])) for f, upper, b in path), float(wt))
        for (path, _), wt in zip(rules.values(), w)
        if abs(wt) > 1e-6
    ]
    return Model(intercept, tuple(kept))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 10000, **options) -> Model:
    """Fits a model on at most ``sample_rows`` labelled documents."""
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull())
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # bounded by sample_rows
    each = with_statistics(texts, "text", "").groupBy("id").agg(F.min(F.struct("label", *NAMES)).alias("row"))
    got = each.select("id", "row.*").toPandas().sort_values("id", kind="stable")  # at most sample_rows rows
    return fit(got[list(NAMES)].to_numpy(np.float64), got["label"].to_numpy(np.float64), list(NAMES), **options)


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return with_statistics(docs, text_col, prefix).select(*kept, model.score(prefix).alias(name))


def accepted(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with at least the score.  The score is made non-deterministic by adding 0, for
    otherwise the optimizer would push the filter down to the scan with all statistics written out in it
    for every rule, and compute them again for each."""
    name = fresh(docs, "score")
    once = F.col(name) + F.monotonically_increasing_id() * F.lit(0.0)
    scored = with_quality(docs, model, text_col, name).select(*docs.columns, once.alias(name))
    return scored.where(F.col(name) >= threshold).select(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learned(spark, docs: DataFrame, sf_dir: str) -> Model:
    labels = read_table(spark, sf_dir, "labels")
    return learn(docs, labels.where(~held_out()))


THRESHOLD = 0.7


def op1_rule_ensemble(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, learned(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
