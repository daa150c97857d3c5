"""Substring dedup over words, by sorting the windows around anchors.

A relative Lempel-Ziv parse against every reference block would visit all blocks for every
document, which grows with the square of the corpus; the README says what is done instead.
The windows around anchors (``repeats``) are sorted in ranges; neighbouring windows of a
context whose earliest places follow one another become one factor (source document,
place, length), read off the sorted order. Factors end with their context; windows across
the end lie in the next anchor's context, so none is missed.

Contexts are compared as bytes. Inside the sort words are compared by 64-bit hashes, so
the result is exact but for the chance of two words of one range sharing a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.repeats import GROUP_BYTES, Group, Rule, true_runs, without_repeats

WORDS, GRAM = 20, 8

SCHEMA = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def _kept(group: Group, doc: int, removed: np.ndarray) -> tuple:
    start = int(group.starts[doc])
    kept = b" ".join([group.slice(start + a, start + b) for a, b in true_runs(~removed)])
    return len(removed), true_runs(removed), kept


def remove_repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, spans (removed [start, end) in words), kept (UTF-8): one row per row.

    Words are runs of anything but the six ASCII blanks. Removed is every word covered by
    a window of ``words`` words whose sequence also starts earlier: in a document with a
    smaller id, or earlier in the same document. Windows are judged on the input and lie
    within one document; null texts have no words. Null ids come last; rows with equal ids
    are one document in this order, an earlier place in one being earlier for the other,
    and at one place neither is. An empty table gives an empty result; other columns take
    no part."""
    return without_repeats(docs, Rule(words, gram, words=True, within=True), _kept, SCHEMA, group_bytes)
