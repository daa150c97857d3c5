"""Repeated windows of tokens across a corpus, exactly, in one plan.

A window is a run of ``window`` tokens (bytes or words) of one document. Every window has
an anchor: of the ``gram``-token runs inside it, the one with the smallest hash, the first
of equals. Equal windows have equal anchors at equal places, so only suffixes that start
at an anchor are handled, about two in ``window - gram + 2``.

1. Documents are dealt into groups of bounded size. A group sends the distinct hashes of
   its anchors, with counts, to hash buckets.
2. A bucket tells groups which of their hashes occur elsewhere too, and which are hot.
3. For those, a group sends each distinct context (the tokens of all windows with that
   anchor), with the earliest place it has it, to the range of the anchored suffix's
   leading tokens. Ranges are cut by splitters from a sample, which sets their balance and
   nothing else. Contexts of hot anchors go as single windows, each by all its tokens, so
   that a passage in a third of all documents is spread as well.
4. A range sorts all windows of its contexts by multikey quicksort. Neighbours that agree
   on every token are equal windows. Equal windows share an anchor, and the boundary test
   sees only the anchored tokens, so none lie on two sides of a boundary. The earliest
   place of each window goes back to the groups, neighbouring windows with one source as
   one factor (source document, source place, length).
5. A group applies the factors to all its documents.

The texts cross the network once: steps 1, 3 and 5 read the same exchange. A group holds
``GROUP_BYTES`` of text; whatever is sent is distinct per group before it is sent, so a
hot hash or context arrives once per group.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from postmill.llm.common import hash_sample

#: Text bytes in a group of documents, about; tokens hashed at a time; documents whose
#: anchors set the splitters; and from how many places on an anchor is hot.
GROUP_BYTES, PIECE, SAMPLE_ROWS, HOT = 8 << 20, 1 << 17, 256, 2_000
MOST_SAMPLE_ROWS = 1 << 16
#: Order of documents without an id: after all others.
NO_ID = (1 << 63) - 1

_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD64 = (1 << 64) - 1


@dataclass(frozen=True)
class Rule:
    """``words``: tokens are words, else bytes. ``within``: an earlier start in the same
    document counts as well, else only starts in documents with a smaller id."""

    window: int
    gram: int
    words: bool
    within: bool


# ---- packing: what groups and buckets send one another ----

def pack(*arrays: np.ndarray, blob: bytes = b"") -> bytes:
    """Arrays byte plane by byte plane, then ``blob``, compressed."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, blob]))


def unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    arrays, at = [], 1
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<2sI", raw, at)
        kind = np.dtype(kind.decode())
        at += 6
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return arrays, raw[at:]


# ---- tokens, anchors ----

def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of anything but the six ASCII blanks."""
    step = np.diff(np.concatenate([[0], ((raw != 32) & ((raw < 9) | (raw > 13))).astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, from running sums of all bytes."""
    codes, i = np.empty(len(starts), dtype=np.uint64), 0
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    up, down = _powers(_MULTIPLIER, PIECE), _powers(inverse, PIECE)
    while i < len(starts):
        begin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        n = int(ends[j - 1] - begin)
        if n > len(up):
            up, down = _powers(_MULTIPLIER, n), _powers(inverse, n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw[begin:begin + n] + np.uint64(1)) * up[:n], out=sums[1:])
        here = starts[i:j] - begin
        codes[i:j] = (sums[ends[i:j] - begin] - sums[here]) * down[here]
        i = j
    codes ^= codes >> np.uint64(32)
    return codes * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` tokens, put together from runs of powers of two."""
    h = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    whole, covered, width, power = None, 0, 1, _MULTIPLIER
    while True:
        if gram & width:
            if whole is None:
                whole, covered = h, width
            else:
                n = len(whole) - width
                whole = h[:n] * np.uint64(pow(_MULTIPLIER, covered, 1 << 64)) + whole[width:]
                covered += width
        if width * 2 > gram:
            break
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & _WORD64, width * 2
    whole = whole ^ (whole >> np.uint64(29))
    whole = whole * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, done = len(x) - width + 1, 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x[:n] if done == width else np.minimum(x[:n], x[width - done:width - done + n])


@dataclass
class Runs:
    """Maximal runs of windows ``first``..``last`` with one anchor, by token position."""

    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray  # 48 bits


def runs_of(tokens: np.ndarray, lengths: np.ndarray, rule: Rule) -> Runs:
    """Over documents laid end to end, ``lengths`` tokens each."""
    found, begin, doc = [], 0, 0
    while doc < len(lengths):
        # Whole documents, together about PIECE tokens.
        end, upto = begin, doc
        while upto < len(lengths) and (upto == doc or end - begin + lengths[upto] <= PIECE):
            end += int(lengths[upto])
            upto += 1
        if end - begin >= rule.window:
            found.append(_runs(tokens[begin:end], lengths[doc:upto], rule, begin))
        begin, doc = end, upto
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def _runs(tokens: np.ndarray, lengths: np.ndarray, rule: Rule, offset: int):
    hashes = gram_hashes(tokens, rule.gram)
    bits = np.uint64(max(1, len(tokens)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_min((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), rule.window - rule.gram + 1)
    ends = np.repeat(np.cumsum(lengths), lengths)[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + rule.window <= ends)
    anchor = (least[starts] & mask).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts))[:len(head)] - 1
    at = anchor[head]
    # Anchors have small hashes; mixed once more they fall evenly on buckets.
    return at + offset, starts[head] + offset, starts[tail] + offset, hashes[at] * np.uint64(_MULTIPLIER) >> np.uint64(16)


class Group:
    """Documents of one group in order of id, then text, laid end to end as tokens."""

    def __init__(self, table: pa.Table, rule: Rule):
        self.rule = rule
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        texts = [r[1].encode("utf-8", "surrogatepass") for r in rows]
        if rule.words:
            # Words of all documents with one blank between, and where each stands.
            raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
            starts, ends = word_places(raw)
            begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
            self.lengths = np.diff(np.searchsorted(starts, begin))
            self.tokens = word_codes(raw, starts, ends)
            self.word_ends = np.cumsum(ends - starts + 1)
            inside = np.zeros(len(raw) + 1, dtype=bool)
            inside[:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
            inside[ends] = True
            line = np.append(raw, np.uint8(32))
            line[ends] = 32
            self.raw = line[inside].tobytes()
        else:
            self.raw = b"".join(texts)
            self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
            self.tokens = np.frombuffer(self.raw, dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.runs = runs_of(self.tokens, self.lengths, rule)

    def slice(self, start: int, end: int) -> bytes:
        """Tokens as bytes, words with one blank between."""
        if not self.rule.words:
            return self.raw[start:end]
        return self.raw[self.word_ends[start - 1] if start else 0:self.word_ends[end - 1] - 1]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.cumsum(self.lengths), positions, side="right")


def _sent(rows: list[tuple], names: Sequence[str]) -> pa.Table:
    """``names``: two numbers and the payload."""
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, (pa.int32(), pa.int32(), pa.binary()))})


# ---- the five steps ----

def offer(table: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """Step 1: distinct hashes of the group's anchors, by bucket."""
    group = Group(table, rule)
    order = np.argsort(group.runs.hash, kind="stable")
    h, doc = group.runs.hash[order], group.doc_of(group.runs.first[order])
    head = np.flatnonzero(np.r_[len(h) > 0, h[1:] != h[:-1]][:len(h)])
    tail = np.append(head[1:], len(h))[:len(head)] - 1
    count = tail - head + 1
    repeated = count > 1 if rule.within else doc[head] != doc[tail]
    info = (np.minimum(count, 32_767) * 2 + repeated).astype(np.uint16)
    h = h[head]
    bucket = ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    number = table.column("part")[0].as_py()
    rows = []
    for b in np.unique(bucket):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        rows.append((int(b), number, pack(np.diff(h[lo:hi], prepend=np.uint64(0)), info[lo:hi])))
    return _sent(rows, ("bucket", "part", "payload"))


def match(table: pa.Table) -> pa.Table:
    """Step 2: to each group, those of its hashes that stand in several places; hot ones marked."""
    h, info, part = [], [], []
    for number, payload in zip(table.column("part").to_pylist(), table.column("payload").to_pylist()):
        (gaps, own), _ = unpack(payload)
        h.append(np.cumsum(gaps, dtype=np.uint64))
        info.append(own.astype(np.int64))
        part.append(np.full(len(own), number, dtype=np.int64))
    h, info, part = map(np.concatenate, (h, info, part))
    order = np.argsort(h, kind="stable")
    h, info, part = h[order], info[order], part[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.append(head, len(h)))
    several = (size > 1) | (np.bitwise_or.reduceat(info & 1, head) > 0)
    hot = np.add.reduceat(info >> 1, head) >= HOT
    keep = np.repeat(several, size)
    h, part, hot = h[keep], part[keep], np.repeat(hot, size)[keep]
    order = np.lexsort((h, part))
    h, part, hot = h[order], part[order], hot[order]
    rows = []
    for number in np.unique(part):
        lo, hi = np.searchsorted(part, [number, number + 1])
        rows.append((int(number), 0, pack(np.diff(h[lo:hi], prepend=np.uint64(0)), hot[lo:hi].astype(np.uint8))))
    return _sent(rows, ("part", "bucket", "payload"))


def contexts(left: pa.Table, right: pa.Table, rule: Rule, splitters: Sequence[bytes]) -> pa.Table:
    """Step 3: distinct contexts of the group's repeated anchors, by range."""
    if not left.num_rows or not right.num_rows:
        return _sent([], ("range", "part", "payload"))
    group = Group(left, rule)
    runs, told = group.runs, [unpack(p)[0] for p in right.column("payload").to_pylist()]
    known = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in told])
    hot = np.concatenate([x for _, x in told]).astype(bool)
    order = np.argsort(known, kind="stable")
    known, hot = known[order], hot[order]
    slot = np.minimum(np.searchsorted(known, runs.hash), len(known) - 1)
    marked = np.flatnonzero(known[slot] == runs.hash)
    doc = group.doc_of(runs.first[marked])
    # By content: [range, start, anchor's offset, whether hot, whether seen again, id, place in the document].
    seen: dict[bytes, list] = {}
    alone: dict[bytes, list] = {}
    window, gram = rule.window, rule.gram
    for first, last, at, is_hot, d in zip(runs.first[marked].tolist(), runs.last[marked].tolist(),
                                          runs.anchor[marked].tolist(), hot[slot[marked]].tolist(), doc.tolist()):
        for p in range(first, last + 1) if is_hot else (first,):
            text = group.slice(p, p + window if is_hot else last + window)
            into = alone if is_hot else seen
            had = into.get(text)
            if had is None:
                lead = text if is_hot else group.slice(at, at + gram)
                into[text] = [bisect_right(splitters, lead), p, at - p, is_hot, False, int(group.ids[d]),
                              p - int(group.starts[d]) if rule.within else 0]
            else:
                had[4] = True
    ranges: dict[int, list] = {}
    for text, x in [*seen.items(), *alone.items()]:
        ranges.setdefault(x[0], []).append((text, *x[1:]))
    number, rows = left.column("part")[0].as_py(), []
    for r, entries in ranges.items():
        entries.sort()
        text, start, offset, is_hot, again, ids, place = zip(*entries)
        rows.append((r, number, pack(
            np.array([len(t) for t in text], dtype=np.uint32), np.array(start, dtype=np.uint32),
            np.array(offset, dtype=np.int16),
            np.array(is_hot, dtype=np.uint8) * 2 + np.array(again, dtype=np.uint8), np.array(ids, dtype=np.int64),
            np.array(place, dtype=np.uint32), blob=b"".join(text))))
    return _sent(rows, ("range", "part", "payload"))


def multikey_order(column: Callable[[int, np.ndarray], np.ndarray], n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``n`` strings of ``width`` characters and, along it, their class of equals.

    Multikey quicksort, level by level: all parts that still agree are sorted by their
    next character at once, and parts of one string drop out."""
    order, rank = np.arange(n), np.zeros(n, dtype=np.int64)  # rank: where a string's part begins
    open_ = np.arange(n)
    for level in range(width):
        if not len(open_):
            break
        which = order[open_]
        key = column(level, which)
        by = np.lexsort((key, rank[open_])) if level else np.argsort(key, kind="stable")
        which, key, part = which[by], key[by], rank[open_]
        order[open_] = which
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        rank[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        single = new & np.r_[new[1:], True]
        open_ = open_[~single]
    return order, rank


def factors(table: pa.Table, rule: Rule) -> pa.Table:
    """Step 4: the earliest place of every window in the range, as factors, to each group."""
    arrays, texts, part = [], [], []
    for number, payload in zip(table.column("part").to_pylist(), table.column("payload").to_pylist()):
        own, blob = unpack(payload)
        arrays.append(own)
        ends = np.cumsum(own[0].astype(np.int64)).tolist()
        texts += [blob[a:b] for a, b in zip([0, *ends], ends)]
        part.append(np.full(len(own[0]), number, dtype=np.int64))
    _, start, offset, flags, ids, place = (np.concatenate([a[i] for a in arrays]) for i in range(6))
    part, place = np.concatenate(part), place.astype(np.int64)

    # Groups may send the same context: one of each is sorted, at its earliest place.
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in texts], dtype=np.int64)
    one = np.zeros(len(number), dtype=np.int64)
    by = np.lexsort((place, ids, which))
    lead = by[np.r_[True, which[by][1:] != which[by][:-1]]]
    one[which[lead]] = lead
    ids1, place1, offset1, hot1 = ids[one], place[one], offset[one].tolist(), (flags[one] >> 1).tolist()
    if rule.words:
        cut = [t.split() for t in number]
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        grams = [t if hot else b" ".join(c[o:o + rule.gram]) for t, c, o, hot in zip(number, cut, offset1, hot1)]
        cut = list(number)
    else:
        cut = list(number)
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        grams = [t if hot else t[o:o + rule.gram] for t, o, hot in zip(number, offset1, hot1)]
    windows = counts - rule.window + 1

    # A context with an anchor of its own shares no window: it is one factor from its own
    # earliest place. The windows of all others are sorted.
    anchored: dict[bytes, int] = {}
    gram = np.array([anchored.setdefault(g, len(anchored)) for g in grams], dtype=np.int64)
    shared = np.bincount(gram)[gram] > 1
    lone = np.flatnonzero(~shared)
    found = [(lone, np.zeros(len(lone), dtype=np.int64), windows[lone] - 1, ids1[lone], place1[lone])]
    if shared.any():
        found.append(_sorted_factors(np.flatnonzero(shared), cut, counts, ids1, place1, rule))
    context, j0, j1, from_id, from_place = (np.concatenate(x) for x in zip(*found))

    # Every sender of a context gets its factors, where the source is earlier than the
    # sender's own place or the sender has the context again later.
    by = np.argsort(context, kind="stable")
    context, j0, j1, from_id, from_place = (x[by] for x in (context, j0, j1, from_id, from_place))
    first, n = np.searchsorted(context, which), np.bincount(context, minlength=len(number))[which]
    sender = np.repeat(np.arange(len(which)), n)
    f = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    own = place[sender] + (j0[f] if rule.within else 0)
    useful = ((from_id[f] < ids[sender]) | ((from_id[f] == ids[sender]) & (from_place[f] < own))
              | (flags[sender] & 1 > 0))
    sender, f = sender[useful], f[useful]
    by = np.argsort(part[sender], kind="stable")
    sender, f = sender[by], f[by]
    rows, to = [], part[sender]
    for p in np.unique(to):
        lo, hi = np.searchsorted(to, [p, p + 1])
        x, y = sender[lo:hi], f[lo:hi]
        rows.append((int(p), 0, pack(start[x], j0[y].astype(np.uint32), j1[y].astype(np.uint32), flags[x] >> 1,
                                     from_id[y], from_place[y].astype(np.uint32))))
    return _sent(rows, ("part", "range", "payload"))


def _sorted_factors(chosen: np.ndarray, cut: list, counts: np.ndarray, ids: np.ndarray, place: np.ndarray, rule: Rule):
    """(context, first and last window, source id, source place) of the ``chosen`` contexts."""
    counts = counts[chosen]
    if rule.words:
        raw = np.frombuffer(b" ".join([cut[i] for i in chosen.tolist()]), dtype=np.uint8)
        keys, step = word_codes(raw, *word_places(raw)), 1
    else:
        # Eight bytes are one character of the sort; a last, shorter one keeps its own bytes.
        raw = np.frombuffer(b"".join([cut[i] for i in chosen.tolist()]) + bytes(8), dtype=np.uint8)
        keys, step = raw.astype(np.uint64), 8
        for width in (1, 2, 4):
            keys = (keys[:-width] << np.uint64(8 * width)) | keys[width:]
    windows = counts - rule.window + 1
    owner = np.repeat(np.arange(len(counts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(counts) - counts, windows) + inside

    def column(level: int, which: np.ndarray) -> np.ndarray:
        key = keys[at[which] + level * step]
        left = rule.window - level * step
        return key if left >= step else key >> np.uint64(8 * (step - left))

    order, rank = multikey_order(column, len(at), math.ceil(rule.window / step))
    head = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    size = np.diff(np.append(head, len(rank)))
    own_id, own_place = ids[chosen][owner], place[chosen][owner] + (inside if rule.within else 0)
    wide = np.repeat(np.minimum.reduceat(own_id[order], head), size)
    low_place = np.minimum.reduceat(np.where(own_id[order] == wide, own_place[order], NO_ID), head)
    from_id, from_place = np.empty_like(own_id), np.empty_like(own_place)
    from_id[order], from_place[order] = wide, np.repeat(low_place, size)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (from_id[1:] != from_id[:-1])
                | (np.diff(from_place) != (1 if rule.within else 0))]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1
    return chosen[owner[head]], inside[head], inside[tail], from_id[head], from_place[head]


def covered(group: Group, payloads: list[bytes]) -> np.ndarray:
    """Step 5: by token, whether a repeated window covers it."""
    cover = np.zeros(len(group.tokens) + 1, dtype=np.int32)
    told = [unpack(p)[0] for p in payloads]
    if not told:
        return cover[:-1] > 0
    start, j0, j1, hot, ids, place = (np.concatenate([t[i] for t in told]) for i in range(6))
    runs, window = group.runs, group.rule.window
    slot = np.searchsorted(runs.first, start.astype(np.int64), side="right") - 1
    by_text: tuple[dict, dict] = ({}, {})
    for s, lo, hi, is_hot, i, p, r in zip(start.tolist(), j0.tolist(), j1.tolist(), hot.tolist(), ids.tolist(), place.tolist(), slot.tolist()):
        text = group.slice(s, s + window if is_hot else int(runs.last[r]) + window)
        by_text[is_hot].setdefault(text, []).append((lo, hi, i, p))
    asked = np.flatnonzero(np.isin(runs.hash, runs.hash[slot]))
    doc = group.doc_of(runs.first[asked])
    for first, last, d in zip(runs.first[asked].tolist(), runs.last[asked].tolist(), doc.tolist()):
        own, begin = int(group.ids[d]), int(group.starts[d])
        looks = [(first, by_text[0].get(group.slice(first, last + window)))] if by_text[0] else []
        if by_text[1]:
            looks += [(p, by_text[1].get(group.slice(p, p + window))) for p in range(first, last + 1)]
        for at, found in looks:
            for lo, hi, i, p in found or ():
                if i < own or (group.rule.within and i == own and p < at - begin + lo):
                    cover[at + lo] += 1
                    cover[at + hi + window] -= 1
    return np.cumsum(cover[:-1]) > 0


def splitters_of(texts: list[str], rule: Rule, ranges: int) -> list[bytes]:
    """Cuts of the range of anchored suffixes into parts of like size, from sampled texts."""
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    group = Group(table, rule)
    last = len(group.tokens)
    # A lead counts as often as the sample has it: what many groups hold, many send. One that
    # fills several parts is one cut, and with few leads there are as many ranges as leads.
    lead = sorted(group.slice(a, min(a + rule.window, last)) for a in group.runs.anchor.tolist())
    return sorted({lead[len(lead) * i // ranges] for i in range(1, ranges)}) if lead else []


def without_repeats(docs: DataFrame, rule: Rule, kept: Callable[[Group, int, np.ndarray], tuple],
                    kept_schema: pa.Schema, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id and what ``kept(group, document, removed tokens)`` gives, by ``kept_schema``.

    ``doc_id`` must be a whole number; null ids come after all others and are no earlier
    than one another. Rows with one id are one document in this order, yet each has its
    own result; null texts count as empty."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / group_bytes))
    # Cuts are as many as ranges, so the sample grows with them: a document for every four
    # ranges, ``SAMPLE_ROWS`` at least and ``MOST_SAMPLE_ROWS`` at most.
    asked = min(max(SAMPLE_ROWS, parts // 4), MOST_SAMPLE_ROWS)
    chosen = hash_sample(rows.select("doc_id").distinct(), asked, "doc_id")
    # Only for the splitters, so a bounded part of a bounded sample will do.
    sample = [r.text for r in rows.join(F.broadcast(chosen), "doc_id", "left_semi")
              .select(F.substring("text", 1, 20_000).alias("text")).limit(4 * asked).collect()]
    splitters = splitters_of(sample, rule, parts)
    dealt = (rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
             .repartition(parts, "part"))
    grouped = dealt.groupBy("part")
    sent = "{} int, {} int, payload binary".format
    offered = grouped.applyInArrow(lambda t: offer(t, rule, parts), sent("bucket", "part"))
    matched = offered.groupBy("bucket").applyInArrow(match, sent("part", "bucket"))
    context = grouped.cogroup(matched.groupBy("part")).applyInArrow(
        lambda left, right: contexts(left, right, rule, splitters), sent("range", "part"))
    factored = context.groupBy("range").applyInArrow(lambda t: factors(t, rule), sent("part", "range"))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, rule)
        removed = covered(group, right.column("payload").to_pylist())
        out = [kept(group, d, removed[s:s + n]) for d, (s, n) in enumerate(zip(group.starts, group.lengths))]
        columns = list(zip(*out)) if out else [()] * len(kept_schema)
        ids = pa.array([None if i == NO_ID else i for i in group.ids.tolist()], pa.int64())
        return pa.table([ids, *(pa.array(c, kept_schema.field(i).type) for i, c in enumerate(columns))],
                        names=["doc_id", *kept_schema.names])

    return grouped.cogroup(factored.groupBy("part")).applyInArrow(apply, from_arrow_schema(pa.schema([pa.field("doc_id", pa.int64()), *kept_schema])))


def true_runs(flags: np.ndarray) -> list[list[int]]:
    """[start, end) of each maximal run of true."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).tolist()
