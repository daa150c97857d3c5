"""Ranked lexical search by MaxScore with pair bounds.

First one pass over all documents gathers what scores need: how many have terms, how many
terms they have, and for the terms of a block of items the documents that hold them. It
writes each document as its length and the numbers and counts of those terms, so texts
are read once and never shuffled.

A second pass cuts the written documents into shards of bounded size as they come. A shard
is an inverted index with each term's largest impact and, for pairs of terms that stand
next to each other in the order of some item, the list of documents that hold both with
the largest sum of their impacts there. An item's terms are taken from the frequent to the
rare. Its first terms are passed over as long as the documents that hold nothing else
cannot reach the score of the item's worst result so far: two terms of a pair together
count for the largest sum that occurs, in one document, of one or both, which is less than
the sum of their own largest impacts. Documents of the remaining terms are scored and
dropped as soon as the bound of what is left to add does not reach that score. Only strictly
smaller bounds drop documents, so ties are found, and results are those of scoring all.

Scores to beat come first from a bounded sample of documents. They are scores of real
documents, so they decide how much is skipped, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import hash_sample, written

RESULTS = 20
#: Items of a block: at most this many, and about this many characters of them.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 2_000_000
#: Postings a shard holds, about, and documents scored first for scores to beat, at most.
SHARD_POSTINGS, SAMPLE_ROWS = 1 << 20, 2_000
#: A character of a term is an ASCII letter or digit or lies outside ASCII: as bytes of
#: UTF-8, everything else is a blank here, and A-Z become a-z.
TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split() if text else []


@dataclass
class Block:
    """Items as term numbers with repeats counted; terms are numbered in their own order."""
    numbers: dict[bytes, int]
    items: list[tuple[object, np.ndarray, np.ndarray]]


def blocks_of(items: list[tuple[object, str | None]]) -> Block:
    cut = [(item, terms_of(text)) for item, text in items]
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in cut for t in terms}))}
    out = []
    for item, terms in cut:
        own, repeats = np.unique(np.array([numbers[t] for t in terms], dtype=np.int64), return_counts=True)
        out.append((item, own, repeats))
    return Block(numbers, out)


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), term and tf (of the given terms) of documents that have terms."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)  # terms of one block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.get
        for batch in batches:
            sizes, term, tf = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                known = np.array([x for x in map(of, words) if x is not None], dtype=np.int32)
                own, times = np.unique(known, return_counts=True)
                sizes.append((len(words), len(own)))
                term.append(own)
                tf.append(times)
            n, lengths = np.array(sizes, dtype=np.int64).reshape(-1, 2).T
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, int)]).astype(np.int32)))
                     for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n bigint, term array<int>, tf array<int>")


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    """A term's weight by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Shard:
    """Inverted index of some documents: postings with impacts, bounds of terms and pairs."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray,
                 n_docs: int, n_terms: int, pairs: np.ndarray):
        self.size = len(n)
        doc = np.repeat(np.arange(len(n)), sizes)
        length = (75 + 25 * n * n_docs // n_terms)[doc]
        tf = tf.astype(np.int64)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length))
        by = np.lexsort((doc, term))
        self.docs, self.impacts = doc[by], impact[by]
        self.starts = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.largest = np.zeros(len(weight), dtype=np.int64)
        np.maximum.at(self.largest, term, impact)
        # Pair lists: (documents, sums) of both; the largest sum of one document with either.
        held = np.diff(self.starts)
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        for a, b in pairs[(held[pairs] > 0).all(axis=1)].tolist():
            (docs_a, of_a), (docs_b, of_b) = self.postings(a), self.postings(b)
            both, at_a, at_b = np.intersect1d(docs_a, docs_b, assume_unique=True, return_indices=True)
            sums = of_a[at_a] + of_b[at_b]
            most = max(int(sums.max(initial=0)), int(self.largest[a]), int(self.largest[b]))
            self.pairs[a, b] = both, sums, most

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.starts[term], self.starts[term + 1]
        return self.docs[lo:hi], self.impacts[lo:hi]

    def pair_bound(self, a: int, b: int, times_a: int, times_b: int) -> int:
        """Most that both terms can add to one document, repeated as often as given."""
        one, two = int(self.largest[a]), int(self.largest[b])
        found = self.pairs.get((a, b))
        if found is None:  # one of them is not in this shard
            return one * times_a + two * times_b
        both = min(times_a, times_b)
        return both * found[2] + (times_a - both) * one + (times_b - both) * two

    def bounds(self, terms: np.ndarray, times: np.ndarray) -> list[int]:
        """By number of first terms, the most that they add to one document."""
        out = [0]
        for k in range(len(terms)):
            alone = int(self.largest[terms[k]] * times[k])
            if k % 2:
                pair = self.pair_bound(int(terms[k - 1]), int(terms[k]), int(times[k - 1]), int(times[k]))
                out.append(min(out[k - 1] + pair, out[k] + alone))
            else:
                out.append(out[k] + alone)
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of ``least`` or more, and above 0, among all of the shard."""
        bound = self.bounds(terms, times)
        least = max(least, 1)
        passed = max(k for k in range(len(bound)) if bound[k] < least)  # bound[0] is 0
        if passed == len(terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first, sizes = self.starts[terms[passed:]], np.diff(self.starts)[terms[passed:]]
        at = _ranges(first, sizes)
        docs, where = np.unique(self.docs[at], return_inverse=True)
        score = np.zeros(len(docs), dtype=np.int64)
        np.add.at(score, where, self.impacts[at] * np.repeat(times[passed:], sizes))
        k = passed
        while k:
            near = score + bound[k] >= least
            docs, score = docs[near], score[near]
            if not len(docs):
                break
            pair = self.pairs.get((int(terms[k - 2]), int(terms[k - 1]))) if k % 2 == 0 else None
            # Where both terms count alike, the pair's own list has their sum.
            if pair and times[k - 2] == times[k - 1]:
                both = self._add(docs, score, pair[0], pair[1], int(times[k - 1]))
                for t in (k - 1, k - 2):
                    self._add(docs, score, *self.postings(terms[t]), int(times[t]), ~both)
                k -= 2
            else:
                self._add(docs, score, *self.postings(terms[k - 1]), int(times[k - 1]))
                k -= 1
        good = score >= least
        return docs[good], score[good]

    @staticmethod
    def _add(docs: np.ndarray, score: np.ndarray, listed: np.ndarray, impacts: np.ndarray, times: int,
             where: np.ndarray | None = None) -> np.ndarray:
        if not len(listed):
            return np.zeros(len(docs), dtype=bool)
        at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
        hit = listed[at] == docs
        added = hit if where is None else hit & where
        score[added] += impacts[at[added]] * times
        return hit


class Best:
    """The best results of one item so far: score, then id, then arrival."""

    def __init__(self, most: int, least: int):
        self.most, self.least, self.rows = most, least, []

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows += zip(scores, ids)
        if len(self.rows) >= self.most:
            self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
            del self.rows[self.most:]
            self.least = max(self.least, self.rows[-1][0])


def ranked(matched: DataFrame, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, results: int,
           least: dict[int, int], shard_postings: int) -> DataFrame:
    """number (of the item), doc_id, score: per task, the best ``results`` of each item, none
    below what ``least`` says of it."""
    rare = [(own[o], times[o]) for _, own, times in block.items for o in [np.lexsort((own, weight[own]))]]
    pairs = {(int(own[k]), int(own[k + 1])) for own, _ in rare for k in range(0, len(own) - 1, 2)}
    held = matched.sparkSession.sparkContext.broadcast(
        (rare, np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2), weight, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, pairs, weight, least = held.value
        best = [Best(results, least.get(i, 0)) for i in range(len(items))]

        def look(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            sizes = np.concatenate([p.column(2).value_lengths().to_numpy() for p in parts])
            term, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in (2, 3))
            shard = Shard(table.column(1).to_numpy(), sizes, term, tf, weight, n_docs, n_terms, pairs)
            ids = table.column(0)
            for own, (terms, times) in zip(best, items):
                if len(terms):
                    docs, score = shard.search(terms, times, own.least)
                    if len(docs):
                        own.add(ids.take(pa.array(docs)).to_pylist(), score.tolist())

        parts, waiting, kind = [], 0, None
        for batch in batches:
            if batch.num_rows:
                kind = batch.schema.field(0).type
                parts.append(batch)
                waiting += len(batch.column(2).flatten())
                if waiting >= shard_postings:
                    look(parts)
                    parts, waiting = [], 0
        if parts:
            look(parts)
        rows = [(i, doc_id, score) for i, own in enumerate(best) for score, doc_id in own.rows]
        if rows:
            number, doc_id, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc_id, kind), pa.array(score, pa.int64())],
                                             names=["number", "doc_id", "score"])

    kind = matched.schema["doc_id"].dataType.simpleString()
    return matched.mapInArrow(run, f"number int, doc_id {kind}, score bigint")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def top(found: DataFrame, results: int) -> DataFrame:
    """The best rows per item with their rank; the limit also runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*_order()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= results)


def _search_block(docs: DataFrame, items: list[tuple], results: int, shard_postings: int, sample_rows: int,
                  item_kind: str) -> DataFrame:
    spark, block = docs.sparkSession, blocks_of(items)
    matched = written(counted(docs, block.numbers), "terms")
    n_docs, n_terms = matched.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(block.numbers), dtype=np.int64)
    for r in (matched.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
              .collect()):  # at most the terms of the block
        held[r.term] = r.n
    weight = weights(n_docs, held) if n_docs else held
    # Scores of some documents are scores to beat; of fewer than all results, 0 is.
    chosen = hash_sample(matched.select("doc_id").distinct(), sample_rows, "doc_id")
    sample = matched.join(F.broadcast(chosen), "doc_id", "left_semi")  # ``sample_rows`` ids
    some = top(ranked(sample, block, weight, n_docs, n_terms, results, {}, shard_postings), results)
    least = {r.number: r.score for r in some.filter(F.col("rank") == results).collect()}  # one row per item
    found = top(ranked(matched, block, weight, n_docs, n_terms, results, least, shard_postings), results)
    names = spark.createDataFrame([(i, item) for i, (item, _, _) in enumerate(block.items)], f"number int, item_id {item_kind}")
    return found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")  # one block of items


def search(docs: DataFrame, items: DataFrame, results: int = RESULTS, block_items: int = BLOCK_ITEMS,
           block_chars: int = BLOCK_CHARS, shard_postings: int = SHARD_POSTINGS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``results`` documents of every row of ``items``
    (item_id, text), by falling score above 0, equal scores by rising id, null ids last.

    Terms are runs of ASCII letters and digits and characters outside ASCII, A-Z lower-cased.
    Null texts have none; items without a term have no results, documents without one are
    in none and not counted. Rows with equal id are documents, or items, each. Empty tables
    give an empty result; other columns take no part. Items are read in blocks, and each
    block's result is written before the next block is begun.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score bigint")
    block, chars = [], 0

    def done(block: list[tuple], out: DataFrame) -> DataFrame:
        return out.unionByName(written(_search_block(docs, block, results, shard_postings, sample_rows, kind), "ranked"))

    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text or "")
        if len(block) >= block_items or chars >= block_chars:
            out, block, chars = done(block, out), [], 0
    return done(block, out) if block else out


SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sized AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM doc_terms WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sized),
item_terms AS (
  SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY q, item_id, term),
postings AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, total GROUP BY term),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * all_docs) // all_terms)))) AS impact
  FROM postings JOIN weights USING (term), total),
scores AS (
  SELECT q, item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
  FROM item_terms JOIN impacts USING (term) GROUP BY q, item_id, r, doc_id),
ordered AS (
  SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ordered WHERE rank <= 20
"""
