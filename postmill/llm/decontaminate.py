"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case with runs of anything but letters and digits as one
blank. A benchmark item is cut into pieces, long ones and, for partial passages, short
ones; a piece of m characters matches where a region of a document is within
k = ``rate`` * m edits of it. Such a region shares at
least m - q + 1 - k * q character q-grams with the piece, all of them on k + 1 adjacent
diagonals. So shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by
half; bands that reach the bound are aligned, within their diagonals only.

The benchmark is read in blocks of bounded size, one pass over the documents carrying one
block; documents are never joined, shuffled or sent anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import id_text, written

Q, RATE = 8, 0.05
#: Longest piece, and how far the next one starts.
PIECE, STRIDE = 160, 80
#: The same of short pieces. Every passage of SHORT + STEP characters or of COUNTED words
#: holds a whole piece; of very short words that is a piece of its own.
SHORT, STEP, COUNTED = 64, 16, 13
#: Characters of pieces carried in one pass.
BLOCK_CHARS = 8 << 20
#: Places of a text's q-grams in pieces that are looked at together, about.
SLICE_POSTINGS = 1 << 20

_BASE = 0x9E3779B1
_FLAGS = 1 << 22
_WORD = re.compile("[^ ]+")


@lru_cache(1)
def _folds() -> np.ndarray:
    """By code point: itself for letters and digits, else a blank."""
    return np.fromiter((i if chr(i).isalnum() else 32 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def folded(text: str) -> np.ndarray:
    """Code points in lower case, runs of anything but letters and digits as one blank."""
    points = _folds()[codes(text.lower())]
    gap = points == 32
    gap[1:] &= gap[:-1]
    gap[:1] = False
    return points[~gap]


def origins(text: str) -> list[int]:
    """For each code point of ``folded(text)``, and its end, the place in ``text``."""
    places, gap = [], False
    for i, c in enumerate(text):
        for low in c.lower():
            if low.isalnum() or not gap:
                places.append(i)
            gap = not low.isalnum()
    return [*places, len(text)]


def grams(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every run of ``Q`` characters (doubling, so ``Q`` is a power of 2)."""
    h, width, power = points.astype(np.uint32), 1, _BASE
    while width < Q:
        if len(h) <= width:
            return np.zeros(0, dtype=np.uint32)
        h = h[:-width] * np.uint32(power & 0xFFFFFFFF) + h[width:]
        power, width = power * power, width * 2
    return h ^ (h >> np.uint32(15))


@dataclass
class Index:
    """Pieces of a block of items, and where each q-gram stands in them."""

    items: list
    texts: list[str]
    budgets: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    piece: np.ndarray
    place: np.ndarray
    flags: np.ndarray
    #: By class of piece lengths: least grams that a match shares, out of so many in a row.
    classes: list[tuple[int, int]]
    #: Characters of the longest piece.
    most: int


def cuts(whole: str) -> list[tuple[int, int]]:
    """Start and end of the pieces of a folded item."""
    size = len(whole)
    if size <= PIECE:
        found = {(0, size)}
    else:
        found = {(c, c + PIECE) for c in (*range(0, size - PIECE, STRIDE), size - PIECE)}
    ends = {c: c + SHORT for c in range(0, size - SHORT + 1, STEP)}
    words = [(m.start(), m.end()) for m in _WORD.finditer(whole)]
    for (a, _), (_, b) in zip(words, words[COUNTED - 1:]):
        c = -(-a // STEP) * STEP  # the first short piece that starts inside these words
        if b - c >= SHORT - STEP:
            ends[c] = min(ends.get(c, c + SHORT), b)
        else:
            found.add((a, b))
    return sorted(found | set(ends.items()))


def _item(text: str | None) -> str:
    return folded(text or "").tobytes().decode("utf-32-le", "surrogatepass").strip()


def build_index(items: list[tuple]) -> Index:
    """From (item_id, text). Items of fewer than ``Q`` characters, once folded, have no
    q-gram and match nothing."""
    owners, texts = [], []
    for item, text in items:
        whole = _item(text)
        if len(whole) < Q:
            continue
        pieces = list(dict.fromkeys(whole[a:b] for a, b in cuts(whole)))  # one of equal pieces
        owners += [item] * len(pieces)
        texts += pieces
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    budgets = np.minimum((RATE * sizes).astype(np.int64), (sizes - Q) // Q)
    found = [grams(codes(t)) for t in texts]
    all_grams = np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
    piece = np.repeat(np.arange(len(texts)), [len(g) for g in found])
    place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, dtype=np.int64)
    order = np.argsort(all_grams, kind="stable")
    keys, starts = np.unique(all_grams[order], return_index=True)
    flags = np.zeros(_FLAGS, dtype=bool)
    flags[keys & np.uint32(_FLAGS - 1)] = True
    bounds = sizes - Q + 1 - budgets * Q
    alike = [sizes // 32 == c for c in np.unique(sizes // 32)]
    classes = [(int(bounds[a].min()), int((sizes + budgets)[a].max()) - Q + 1) for a in alike]
    return Index(owners, texts, budgets, bounds, keys, np.append(starts, len(order)),
                 piece[order], place[order], flags, classes, max(map(len, texts), default=0))


def edit_distance_within(piece: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edits between ``piece`` and a run of ``region`` on diagonals low..high, where the
    diagonal of region[i], piece[j] is i - j; with that run's start and end."""
    far, width = 1 << 20, high - low + 1
    diagonals = np.arange(low, high + 1)
    cost = np.where((diagonals >= 0) & (diagonals <= len(region)), 0, far)
    start = diagonals.copy()
    steps = np.arange(width)
    for j in range(len(piece)):
        at = diagonals + j  # region characters used before this one
        inside = (at >= 0) & (at < len(region))
        same = np.zeros(width, dtype=bool)
        same[inside] = region[at[inside]] == piece[j]
        new = np.where(inside, cost + ~same, far)
        origin = start
        # Leaving out piece[j] comes from the next diagonal.
        skip = np.append(cost[1:] + 1, far)
        better = skip < new
        new, origin = np.where(better, skip, new), np.where(better, np.append(start[1:], 0), origin)
        # An extra region character comes from the diagonal before.
        slope = new - steps
        best = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == best, steps, 0))
        cost, start = best + steps, origin[source]
        cost = np.where((diagonals + j + 1 >= 0) & (diagonals + j + 1 <= len(region)), cost, far)
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), int(diagonals[end] + len(piece))


@lru_cache(4_096)
def _places_of(pattern: str) -> dict[str, int]:
    """By character, where it stands in the pattern, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def may_hold(region: str, pattern: str, most: int) -> bool:
    """Whether the pattern is within ``most`` edits of some run of the region, on whatever
    diagonals: a column of the edit table at a time, its steps up and down as bits."""
    size = len(pattern)
    places, every, last = _places_of(pattern), (1 << size) - 1, 1 << (size - 1)
    up, down, edits = every, 0, size
    for c in region:
        same = places.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        right_up, right_down = down | (every & ~(level | up)), up & level
        if right_up & last:
            edits += 1
        elif right_down & last:
            edits -= 1
            if edits <= most:
                return True
        right_up, right_down = right_up << 1 & every, right_down << 1 & every
        up, down = right_down | (every & ~(vertical | right_up)), right_up & vertical
    return edits <= most


def find(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(piece, edits, start, end) in the folded text, one for each piece and place found."""
    if not len(index.keys) or len(text) < Q:
        return []
    points = folded(text)
    own = grams(points)
    member = index.flags[own & np.uint32(_FLAGS - 1)]
    total = np.zeros(len(own) + 1, dtype=np.int32)
    np.cumsum(member, out=total[1:])
    cover = np.zeros(len(own) + 1, dtype=np.int32)
    for least, reach in index.classes:
        if total[-1] < least:
            continue
        last = max(len(own) - reach, 0)
        dense = np.flatnonzero(total[min(reach, len(own)):][:last + 1] - total[:last + 1] >= least)
        cover[dense] += 1
        np.subtract.at(cover, np.minimum(dense + reach, len(own)), 1)
    if not cover.any():
        return []
    line = points.tobytes().decode("utf-32-le", "surrogatepass")
    at = np.flatnonzero(member & (np.cumsum(cover[:-1]) > 0))
    slot = np.searchsorted(index.keys, own[at])
    slot[slot == len(index.keys)] = 0
    real = index.keys[slot] == own[at]
    at, slot = at[real], slot[real]
    n = index.starts[slot + 1] - index.starts[slot]
    out: list[tuple[int, int, int, int]] = []
    last: dict[int, tuple[int, int]] = {}  # of a piece's latest find: where it begins, its place in ``out``
    for begun, ended in _slices(at, n, index.most, len(points)):
        for p, b in _full_bands(index, at, slot, n, begun, ended, len(points)):
            k, pattern = int(index.budgets[p]), index.texts[p]
            low, high = b * (k + 1), (b + 2) * (k + 1) - 1
            before, held = last.get(p, (-1, -1))
            if low <= before <= high:
                continue  # the same place, seen from the band before
            begin = max(low, 0)
            exact = line.find(pattern, begin, high + len(pattern))
            if exact >= 0:
                new = (p, 0, exact, exact + len(pattern))
            else:
                stop = min(high + len(pattern) + 1, len(points))
                if not may_hold(line[begin:stop], pattern, k):
                    continue
                edits, start, end = edit_distance_within(codes(pattern), points[begin:stop], low - begin, high - begin)
                if edits > k:
                    continue
                new = (p, edits, begin + start, begin + end)
            if held >= 0 and out[held][2] <= new[2] <= out[held][3]:  # places that meet are one
                had = out[held]
                out[held] = (p, min(had[1], new[1]), had[2], max(had[3], new[3]))
            else:
                held = len(out)
                out.append(new)
            last[p] = new[2], held
    return out


def _slices(at: np.ndarray, n: np.ndarray, most: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of diagonals, each with about ``SLICE_POSTINGS`` postings of the hits at ``at``."""
    cut = np.flatnonzero(np.diff(np.cumsum(n) // SLICE_POSTINGS)) + 1
    edges = [-most, *np.unique(at[cut]).tolist(), size]
    return zip(edges, edges[1:])


def _full_bands(index: Index, at: np.ndarray, slot: np.ndarray, n: np.ndarray, begun: int, ended: int,
                size: int) -> Iterator[tuple[int, int]]:
    """(piece, band) of the bands that begin on these diagonals and reach their bound.

    Diagonals a band's width beyond are counted as well, so that no band is cut."""
    wide = 2 * (int(index.budgets.max()) + 1)
    lo, hi = np.searchsorted(at, [begun - wide, ended + wide + index.most])
    at, slot, n = at[lo:hi], slot[lo:hi], n[lo:hi]
    into = np.repeat(index.starts[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    piece, diagonal = index.piece[into], np.repeat(at, n) - index.place[into]
    near = (diagonal >= begun - wide) & (diagonal < ended + wide)
    piece, diagonal = piece[near], diagonal[near]
    step = index.budgets[piece] + 1
    band = diagonal // step
    span = np.int64(size + index.most + 2)
    # Each gram counts in the two bands that hold its diagonal.
    key = np.concatenate([piece * 2 * span + band + span, piece * 2 * span + band - 1 + span])
    key, count = np.unique(key, return_counts=True)
    piece, band = key // (2 * span), key % (2 * span) - span
    low = band * (index.budgets[piece] + 1)
    keep = (count >= index.bounds[piece]) & (low >= begun) & (low < ended)
    return zip(piece[keep].tolist(), band[keep].tolist())


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Index]:
    block, size = [], 0
    for row in benchmark.filter("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((row.item_id, row.text))
        size += sum(b - a for a, b in cuts(_item(row.text)))
        if size >= block_chars:
            yield build_index(block)
            block, size = [], 0
    if block:
        yield build_index(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, item_ids, spans: one row per row of ``docs``.

    ``item_ids`` are the matched items in ascending order, ``spans`` the matched places as
    ``start:end`` in code points of the text, merged and comma-joined. Null and empty
    texts, and an empty benchmark, match nothing; null items and items of fewer than 8
    folded characters are passed over. Repeated items match as each of their ids, repeated
    documents are judged each; other columns take no part.
    """
    spark = docs.sparkSession
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, item_ids array<{item_kind}>, spans array<array<int>>"
    rows = id_text(docs).select("doc_id", "text", F.array().cast(f"array<{item_kind}>").alias("item_ids"),
                                F.array().cast("array<array<int>>").alias("spans"))
    first = True
    for index in benchmark_blocks(benchmark, block_chars):
        if not first:  # what the block before found is kept, so that one block is alive at a time
            rows = written(rows, "block")
        first = False
        held = spark.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for i, text in enumerate(batch.column(1).to_pylist()):
                    found = find(text, index)
                    if found:
                        place = origins(text)
                        ids[i] = ids[i] + [index.items[p] for p, *_ in found]
                        spans[i] = spans[i] + [[place[s], place[e - 1] + 1] for _, _, s, e in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(ids, batch.column(2).type),
                     pa.array(spans, batch.column(3).type)], names=["doc_id", "text", "item_ids", "spans"])

        rows = rows.mapInArrow(look, kinds)
    # Sorted places, merged where they meet.
    merged = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<array<int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= s[0]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(
                F.element_at(done, -1)[0], F.greatest(F.element_at(F.element_at(done, -1), 2), s[1])))))
        .otherwise(F.concat(done, F.array(s))))
    joined = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s[0], s[1])), ",")
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"),
                       F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), joined.alias("spans"))
