"""Language identification by averaged hashed subword embeddings.

A text is the mean of the vectors of its hashed character 1- to 3-grams, within words, and
a linear softmax reads that mean. Vectors and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample. Since all is linear, the trained model is
folded into one table of logits per bucket; a text's logits are its mean row. A held-back
part of the sample sets the softmax temperature and the score below which an answer is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import hash_sample, id_text

BUCKETS = 1 << 13
GRAMS = 3
DIMENSIONS = 16
#: Documents of training at most, the ones with the smallest hash of their id.
SAMPLE_ROWS = 3_000
#: And of each language so many, so that a rare one is learned as well.
SAMPLE_EACH = 100
#: Characters hashed at a time, so that memory does not follow the longest text.
PIECE = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """How often each bucket occurs in the whole text; None for a text without letters."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    seen, before = False, np.zeros(GRAMS - 1, dtype=np.uint32)
    for start in range(0, len(text) + 1, PIECE):
        part = text[start:start + PIECE].lower() + (" " if start + PIECE >= len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = letters()[points]
        seen = seen or bool(known.any())
        points = np.concatenate([before, np.where(known, points, 0).astype(np.uint32)])
        before = points[len(points) - GRAMS + 1:]
        last = points[GRAMS - 1:]
        code = last * np.uint32(2654435761)
        inside = last > 0
        for n in range(1, GRAMS + 1):
            if n > 1:
                earlier = points[GRAMS - n:len(points) - n + 1]
                code = (code ^ (earlier + np.uint32(n))) * np.uint32(2246822519)
                code ^= code >> np.uint32(15)
                # A gram may touch the gap before or after a word, but not span one.
                inside = (last > 0) | (points[GRAMS - 2:len(points) - 1] > 0)
                if n == 3:
                    inside &= points[GRAMS - 2:len(points) - 1] > 0
            counts += np.bincount((code[inside] >> np.uint32(19)), minlength=BUCKETS)
    return counts if seen else None


def grams_of(docs: DataFrame, *labels: str) -> DataFrame:
    """The labels, with buckets and counts of texts that have letters."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(t) for t in batch.column(0).to_pylist()]
            where = [np.flatnonzero(c) if c is not None else np.zeros(0, int) for c in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([w.tolist() for w in where], pa.list_(pa.int32())),
                 pa.array([c[w].tolist() if c is not None else [] for c, w in zip(found, where)],
                          pa.list_(pa.int64()))], names=[*labels, "buckets", "counts"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in labels)
    return docs.select("text", *labels).mapInArrow(measure, f"{kinds}, buckets array<int>, counts array<bigint>")


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # bucket x language
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = counts @ self.logits / max(counts.sum(), 1) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 0.5,
        seed: int = 11) -> LanguageModel:
    """Samples are (buckets, counts, language). Every tenth is held back for calibration."""
    languages = sorted({s[2] for s in samples})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    number = {lang: i for i, lang in enumerate(languages)}
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    softmax = np.zeros((DIMENSIONS, len(languages)))
    held = [s for i, s in enumerate(samples) if i % 10 == 9]
    train = [s for i, s in enumerate(samples) if i % 10 != 9 or len(samples) < 20]
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in draw.permutation(len(train)):
            buckets, counts, lang = train[i]
            share = counts / counts.sum()
            mean = share @ vectors[buckets]
            z = mean @ softmax
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            step = rate * (1 - done / steps)
            back = softmax @ p
            softmax -= step * np.outer(mean, p)
            # A bucket's share is small; the step is scaled so that vectors learn as fast as weights.
            vectors[buckets] -= step * np.outer(share * len(buckets), back)
            done += 1
    model = LanguageModel(languages, vectors @ softmax)
    if held and len(languages) > 1:
        z = np.stack([c @ model.logits[b] / c.sum() for b, c, _ in held])
        truth = np.array([number[s[2]] for s in held])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            miss = np.log(np.exp(s).sum(axis=1))[:, None] - s
            # One more answer than was seen counts as wrong; else no error would ask for certainty.
            doubt = 1 / (len(s) + 1)
            return float((1 - doubt) * miss[np.arange(len(s)), truth].mean() + doubt * miss.mean())

        model.temperature = min((2.0 ** k for k in np.arange(-5, 12.25, 0.25)), key=loss)
        scores = np.sort([model_scores(z[i] / model.temperature) for i in range(len(z))])
        model.reject_below = float(min(scores[len(scores) // 100], 0.5))
    return model


def model_scores(z: np.ndarray) -> float:
    e = np.exp(z - z.max())
    return float(e.max() / e.sum())


def train(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``sample_rows`` documents with a language and ``SAMPLE_EACH`` of each
    language, the same ones on every run."""
    known = docs.filter(learn).filter("lang is not null").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    # Ids first, then the texts of those ids: the sort carries no texts.
    chosen = hash_sample(known.select("doc_id").distinct(), sample_rows, "doc_id")
    # The limit per language also runs before the shuffle.
    own = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id")
    each = known.select("doc_id", "lang").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= SAMPLE_EACH)
    chosen = chosen.unionByName(each.select("doc_id")).distinct()
    sample = grams_of(known.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", "lang")
    rows = sorted((r for r in sample.collect() if r.buckets),
                  key=lambda r: (str(r.doc_id), r.lang, r.buckets, r.counts))
    return fit([(np.array(r.buckets), np.array(r.counts, dtype=float), r.lang) for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of ``docs``.

    ``und`` with score 0 for null texts and texts without a letter, and for every text if
    the model has no language. ``rejected`` marks answers below the calibrated score.
    Repeated rows are answered each; an empty table gives an empty result; other columns,
    a language column included, take no part.
    """
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                counts = gram_counts(text) if model.languages else None
                if counts is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    p = model.probabilities(counts)
                    langs.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([s < model.reject_below or lang == "und" for s, lang in zip(scores, langs)], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_text(docs).mapInArrow(answer, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
