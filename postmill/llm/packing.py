"""Packing of token sequences with bounded space.

A task reads its documents as they come. Whole windows are cut off a long document; what
is left of it goes into the open window where it leaves the least room. Where none has
room and as many windows are open as may be, the fullest one is emitted. So a task holds
at most ``OPEN`` windows, whatever it reads. The windows still open at its end, at most
``OPEN`` per task, are merged: their pieces are dealt over buckets of bounded size, placed
best-fit from the largest on, and the emptiest windows are cut up to fill the others, so
that a bucket ends with one window that is not full.

Ids are those of the library ``tokenizers`` for the given vocabulary file, whose merges
``tiktoken`` runs here: the same ids (tested over all characters) at a quarter of the time.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import id_text, written

WINDOW, OPEN, END_ID = 2048, 256, 1
#: What a merging task holds at most, about.
BUCKET_TOKENS, BUCKET_PIECES = 1 << 22, 1 << 16
#: Tokens of a batch of results.
BATCH_TOKENS = 1 << 20
#: Fixed value: how byte-level vocabularies cut a text before merging.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COLUMNS = "doc_id {}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def load_vocabulary(path: str) -> tiktoken.Encoding:
    """Encoder of a byte-level vocabulary file. Special tokens' texts are ordinary text."""
    with open(path, encoding="utf-8") as file:
        table = json.load(file)
    if table["model"]["type"] != "BPE" or table["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path} holds no byte-level vocabulary")
    special = {t["content"] for t in table["added_tokens"]}
    # Such files write a byte as the character of its number where that can be seen, and
    # the others, in order, as the characters from 256 on.
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    unseen = [b for b in range(256) if b not in set(seen)]
    byte_of = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(unseen)}
    ranks = {bytes(map(byte_of.__getitem__, token)): rank
             for token, rank in table["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


class OpenWindows:
    """The open windows of a task, by the room they have left."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.number = window, most, 0
        self.rooms: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list] = {}

    def new(self) -> int:
        self.number += 1
        return self.number - 1

    def place(self, piece: tuple, size: int) -> list[tuple[int, list]]:
        """Place a piece shorter than a window; returns the windows this closes."""
        closed, at = [], bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                fullest = self.rooms.pop(0)[1]
                closed.append((fullest, self.held.pop(fullest)))
            room, number = self.window, self.new()
            self.held[number] = []
        self.held[number].append(piece)
        if room == size:
            closed.append((number, self.held.pop(number)))
        else:
            insort(self.rooms, (room - size, number))
        return closed


class Rows:
    """Pieces of closed windows, given out as batches."""

    def __init__(self, kind: pa.DataType, with_flag: bool = False):
        self.kind, self.with_flag, self.rows, self.tokens = kind, with_flag, [], 0

    def add(self, sequence_id: int, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), total, sequence_id, offset, is_open))
            offset += len(ids)
        self.tokens += offset

    def batch(self) -> pa.RecordBatch:
        kinds = [self.kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_open"]
        columns = list(zip(*self.rows)) or [()] * len(kinds)
        n = len(names) if self.with_flag else len(names) - 1
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n])], names=names[:n])
        self.rows, self.tokens = [], 0
        return out


def windowed(docs: DataFrame, vocabulary: str, window: int, most: int, end_id: int) -> DataFrame:
    """Pieces of all documents in windows, those of windows still open marked ``is_open``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_vocabulary(vocabulary).encode_ordinary
        base = TaskContext.get().partitionId() << 33
        windows, rows = OpenWindows(window, most), None
        for batch in batches:
            rows = rows or Rows(batch.schema.field(0).type, True)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    rows.add(base + 2 * windows.new(), [(doc_id, start, ids[start:start + window], len(ids))])
                if whole < len(ids):
                    for number, pieces in windows.place((doc_id, whole, ids[whole:], len(ids)), len(ids) - whole):
                        rows.add(base + 2 * number, pieces)
                if rows.tokens >= BATCH_TOKENS:
                    yield rows.batch()
        if rows:
            for number, pieces in windows.held.items():
                rows.add(base + 2 * number, pieces, True)
            yield rows.batch()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_text(docs).mapInArrow(run, COLUMNS.format(kind) + ", is_open boolean")


def merged(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """Windows of all the pieces (id, start, ids, tokens of the document): best-fit from the
    largest on, then the emptiest windows fill the others."""
    rooms: list[tuple[int, int]] = []
    held: list[list] = []
    for piece in sorted(pieces, key=lambda p: (-len(p[2]), str(p[0]), p[1])):
        size = len(piece[2])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = window, len(held)
            held.append([])
        held[number].append(piece)
        insort(rooms, (room - size, number))
    full = [held[n] for room, n in rooms if not room]
    rest = [(room, held[n]) for room, n in rooms if room]
    while rest:
        room, own = rest.pop(0)  # the fullest takes what it lacks from the emptiest
        while room and rest:
            left, other = rest.pop()
            doc_id, start, ids, total = other.pop()
            own.append((doc_id, start, ids[:room], total))
            taken = len(own[-1][2])
            if taken < len(ids):
                other.append((doc_id, start + taken, ids[taken:], total))
            room, left = room - taken, left + taken
            if other:
                rest.append((left, other))
        full.append(own)
    return full


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID,
         bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row per piece.

    ``vocabulary`` is a file every executor can read at that path. A document is its ids,
    then ``end_id``; ``start`` counts the ids before the piece, ``doc_tokens`` all of them,
    ``ids`` are little-endian unsigned 32-bit numbers. A sequence is its pieces by offset,
    gapless from 0, at most ``window`` ids. Null and empty texts are ``end_id`` alone.
    Repeated rows and null ids are documents like others; an empty table gives an empty
    result; other columns take no part.
    """
    first = written(windowed(docs, vocabulary, window, open_windows, end_id), "windows")
    closed, still_open = first.filter("not is_open").drop("is_open"), first.filter("is_open").drop("is_open")
    n, tokens = still_open.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    buckets = max(1, math.ceil(tokens / bucket_tokens), math.ceil(n / BUCKET_PIECES))

    def merge(table: pa.Table) -> pa.Table:
        rows = Rows(table.schema.field("doc_id").type)
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])
                  for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist()]
        base = table.column("bucket")[0].as_py() << 33
        for number, own in enumerate(merged(pieces, window)):
            rows.add(base + 2 * number + 1, own)  # odd, where those of tasks are even
        return pa.Table.from_batches([rows.batch()])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = (still_open.withColumn("bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(buckets)))
            .groupBy("bucket").applyInArrow(merge, COLUMNS.format(kind)))
    return closed.unionByName(written(rest, "merged"))
