"""Suffix-array dedup: bytes of texts that some 50-byte string of a smaller document covers.

Method and data flow are in ``repeats``: suffixes at anchors are range-partitioned by
sampled splitters over their leading bytes, sorted by multikey quicksort in their range,
and compared with their neighbours. All suffixes would be 50 times the text; those at
anchors, of repeated anchors only, are about its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.repeats import GROUP_BYTES, Group, Rule, true_runs, without_repeats

LENGTH, GRAM = 50, 24

SCHEMA = pa.schema([("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def _kept(group: Group, doc: int, removed: np.ndarray) -> tuple:
    start = int(group.starts[doc])
    raw = group.tokens[start:start + len(removed)]
    return len(removed), true_runs(removed), raw[~removed].tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (removed [start, end) in bytes), kept (binary): one row per row.

    Removed is every byte covered by a ``length``-byte string of UTF-8 that also starts in
    a document with a smaller id. Strings are judged on the input and lie within one
    document; null texts count as empty. Null ids come last and are not smaller than one
    another, nor are equal ids. An empty table gives an empty result; other columns take
    no part."""
    return without_repeats(docs, Rule(length, gram, words=False, within=False), _kept, SCHEMA, group_bytes)
