"""Quality classifier: a sparse ensemble of rules.

Shallow trees are boosted over text statistics; every path from a root becomes a
conjunction of threshold tests. A lasso logistic regression weighs those conjunctions and
leaves most at zero. What remains is compiled into one Spark column expression over the
statistics, so scoring runs in the JVM; only the statistics of a text are taken in Python,
by counting its bytes and words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import hash_sample, id_text, written

#: Rows of training at most; the ones with the smallest hash of their id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

STATISTICS = ("chars", "words", "word_length", "lines", "upper", "digit", "blank", "marks", "shouts",
              "symbols", "bars", "wide", "distinct_words", "repeats", "marked_words", "upper_words",
              "long_words", "line_words")


def text_statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS``; shares are of bytes or words, 0 for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    size = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    upper, digit = bytes_[65:91].sum(), bytes_[48:58].sum()
    lines = int(bytes_[10]) + 1
    marks = bytes_[33:48].sum() + bytes_[58:65].sum() + bytes_[91:97].sum() + bytes_[123:127].sum()
    common = bytes_[[44, 46, 39, 45]].sum()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(len(text)), float(len(words)), len(text) / n, float(lines), upper / size, digit / size,
        (bytes_[32] + bytes_[9:14].sum()) / size, marks / size, bytes_[33] / size, (marks - common) / size,
        bytes_[124] / size, bytes_[128:].sum() / size, len(set(words)) / n, repeats / n,
        sum(not w[-1].isalnum() for w in words) / n, sum(w.isupper() for w in words) / n,
        sum(len(w) > 20 for w in words) / n, len(words) / lines,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double column per statistic."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_statistics(t) for t in batch.column(1).to_pylist()], dtype=np.float64)
            rows = rows.reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))],
                names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


Test = tuple[int, float, bool]  # statistic, threshold, whether above it


@dataclass
class RuleEnsemble:
    """Weighted conjunctions; ``score`` is the compiled column, ``predict`` the same in numpy."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for statistic, threshold, above in rule:
                value = F.col(STATISTICS[statistic])
                holds = holds & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + matches(self.rules, x) @ np.array(self.weights))))


def matches(rules: list[tuple[Test, ...]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for statistic, threshold, above in rule:
            out[:, j] *= (x[:, statistic] > threshold) == above
    return out


def _grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], depth: int, leaf: int,
          path: tuple[Test, ...]) -> tuple[list[tuple[Test, ...]], np.ndarray]:
    """A regression tree's paths (inner ones too) and its fitted values on ``x``."""
    best = None
    if depth and len(x) >= 2 * leaf:
        whole = residual.sum() ** 2 / len(x)
        for s, points in enumerate(cuts):
            place = np.searchsorted(points, x[:, s], side="left")  # how many cuts a value is above
            n = np.bincount(place, minlength=len(points) + 1).cumsum()[:-1]
            total = np.bincount(place, residual, minlength=len(points) + 1).cumsum()[:-1]
            ok = (n >= leaf) & (len(x) - n >= leaf)
            if not ok.any():
                continue
            gain = np.full(len(points), -np.inf)
            gain[ok] = total[ok] ** 2 / n[ok] + (residual.sum() - total[ok]) ** 2 / (len(x) - n[ok]) - whole
            k = int(gain.argmax())
            if best is None or gain[k] > best[0] + 1e-12:
                best = (gain[k], s, float(points[k]))
    if best is None or best[0] <= 1e-9:
        return [], np.full(len(x), residual.mean() if len(x) else 0.0)
    _, s, threshold = best
    paths, fitted = [], np.empty(len(x))
    for above in (False, True):
        part = (x[:, s] > threshold) == above
        here = (*path, (s, threshold, above))
        below, fitted[part] = _grow(x[part], residual[part], cuts, depth - 1, leaf, here)
        paths += [here, *below]
    return paths, fitted


def _lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal steps."""
    n, k = z.shape
    rate = 4.0 / (np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2 / n)
    w = np.zeros(k + 1)
    w[k] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, momentum, z1 = w.copy(), 1.0, np.c_[z, np.ones(n)]
    for _ in range(steps):
        slope = z1.T @ (1 / (1 + np.exp(-(z1 @ v))) - y) / n
        new = v - rate * slope
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * strength, 0)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v = new + (momentum - 1) / next_momentum * (new - w)
        w, momentum = new, next_momentum
    return w[:k], float(w[k])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, leaf: int = 10, rate: float = 0.3,
              strength: float = 3e-4, steps: int = 400, seed: int = 7) -> RuleEnsemble:
    """Trees on random halves of the rows, their paths, lasso weights. With one label only,
    or no rows, the ensemble has no rules and returns the label's smoothed share."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 2 * leaf or y.min() == y.max():
        return RuleEnsemble(intercept=float(np.log(prior / (1 - prior))))
    cuts = [(v[1:] + v[:-1]) / 2 for v in (np.unique(np.quantile(c, np.linspace(0, 1, 65))) for c in x.T)]
    draw, margin, rules = np.random.default_rng(seed), np.full(len(y), np.log(prior / (1 - prior))), []
    for _ in range(trees):
        half = np.sort(draw.choice(len(y), max(len(y) // 2, 2 * leaf), replace=False))
        residual = y - 1 / (1 + np.exp(-margin))
        paths, _ = _grow(x[half], residual[half], cuts, depth, leaf, ())
        if not paths:
            continue
        rules += paths
        leaves = matches(paths, x)
        # Each row's value: the mean residual of the deepest path that holds for it.
        means = np.array([residual[leaves[:, j] > 0].mean() if leaves[:, j].any() else 0.0 for j in range(len(paths))])
        deepest = (leaves * np.array([len(p) for p in paths])).argmax(axis=1)
        margin = margin + rate * 4 * means[deepest]
    rules = list(dict.fromkeys(rules))
    weights, intercept = _lasso(matches(rules, x), y, strength, steps)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble([rules[i] for i in kept], [float(weights[i]) for i in kept], intercept)


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on at most ``sample_rows`` labelled rows, the same ones on every run."""
    named = stats.join(labels.select("doc_id", F.col("quality").cast("double").alias("label"))
                       .filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
    sample = (hash_sample(named, sample_rows, "doc_id", *STATISTICS)
              .select("label", *STATISTICS).toPandas().to_numpy(dtype=np.float64))
    sample = sample.reshape(-1, len(STATISTICS) + 1)
    return fit_rules(sample[:, 1:], sample[:, 0])


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``.

    ``learn`` says by ``doc_id`` which rows may be learned from. A null text is scored as
    an empty one; null ids are scored but never learned from; labels other than 0 and 1
    are ignored, and repeated labels of one document count once (1 wins). Rows that repeat
    are scored each. Empty tables give an empty result; without labels every score is 0.5.
    """
    stats = written(with_statistics(id_text(docs)), "statistics")
    model = train(stats.filter(learn), labels, sample_rows)
    return (stats.select("doc_id", model.score().alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
