"""SimHash near-dedup with a generalised pigeonhole search.

Two fingerprints within ``radius`` bits agree, on at least one of ``m`` groups of bits,
to within that group's own threshold, when the thresholds add up to ``radius - m + 1``
(-1: the group is not asked). Bits that vary together share a group, since a group of
dependent bits tells fewer fingerprints apart than its width suggests and is better paid
for once. Thresholds, and the number of groups, come from a dynamic program over the
number of candidates each choice would give, estimated on a bounded sample.

Equal fingerprints are one node, whatever their number. A bucket's members are verified
against one another in numpy and linked to the smallest member of their part, so links
grow with members, not with pairs. Larger buckets are cut into blocks, each pair of
blocks being one unit of work, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import hash_sample, id_text, written
from postmill.llm.components import components

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Fingerprints on which bit groups and candidate counts are estimated, at most.
SAMPLE_ROWS = 2_048
#: Fingerprints of a bucket compared at a time.
BLOCK = 4_096


def fingerprint(text: str, words: int = WORDS) -> int:
    """As a signed 64-bit number; the docstring of ``near_duplicates`` has the rule."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    last = max(len(parts) - words, 0)
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 1 << 15
    for begin in range(0, last + 1, step):
        hashes = np.array([digest(line[starts[i]:ends[min(i + words, len(parts)) - 1]], SEED)
                           for i in range(begin, min(begin + step, last + 1))], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits((2 * ones > last + 1).astype(np.uint8), bitorder="little").view(np.int64)
    return int(value[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, print."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())],
                                             names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_text(docs).mapInArrow(measure, f"doc_id {kind}, print bigint")


@dataclass(frozen=True)
class Probe:
    """Bits (positions) and threshold of one group that is asked."""

    bits: tuple[int, ...]
    threshold: int


def correlated_groups(sample: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """All 64 bits in ``count`` groups of nearly equal width, each grown by the bit that
    varies most with those it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    spread = np.sqrt((bits ** 2).sum(axis=0)) + 1e-9
    bond = np.abs(bits.T @ bits) / np.outer(spread, spread)
    np.fill_diagonal(bond, 0)
    free, groups = list(range(BITS)), []
    for g in range(count):
        width = len(free) // (count - g)
        own = [free.pop(int(bond[np.ix_(free, free)].sum(axis=1).argmax()))]
        while len(own) < width:
            own.append(free.pop(int(bond[np.ix_(free, own)].sum(axis=1).argmax())))
        groups.append(tuple(sorted(own)))
    return groups


def _mask(bits: Sequence[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def ball(width: int, threshold: int) -> int:
    return sum(math.comb(width, k) for k in range(threshold + 1))


def plan_probes(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[Probe]:
    """The cheapest groups and thresholds for ``n`` fingerprints like those of ``sample``.

    Cost of a group at a threshold: the keys it sends (a few hundred comparisons each)
    and the pairs it brings together. ``best[s]`` is the cheapest way to spend ``s`` over
    the groups seen so far, where threshold t costs t + 1."""
    found: tuple[float, list[Probe]] = (math.inf, [])
    pairs = np.triu_indices(min(len(sample), 512), 1)
    differ = sample[pairs[0]] ^ sample[pairs[1]]
    for m in range(2, radius + 2):
        groups = correlated_groups(sample, m)
        best: dict[int, tuple[float, list[Probe]]] = {0: (0.0, [])}
        for bits in groups:
            apart = np.bitwise_count(differ & _mask(bits))
            grown: dict[int, tuple[float, list[Probe]]] = {}
            for spent, (cost, probes) in best.items():
                for t in range(-1, radius - m + 2):
                    if t < 0:
                        more, chosen = 0.0, probes
                    else:
                        share = max(float((apart <= t).mean()) if len(apart) else 0.0,
                                    ball(len(bits), t) / 2.0 ** len(bits))
                        sent = n * (1 + (ball(len(bits), t) if t else 0))
                        more, chosen = 300.0 * sent + share * n * n / 2, [*probes, Probe(bits, t)]
                    key = spent + t + 1
                    if key <= radius + 1 and cost + more < grown.get(key, (math.inf,))[0]:
                        grown[key] = (cost + more, chosen)
            best = grown
        # Thresholds that add up to radius - m + 1 have spent radius + 1.
        if radius + 1 in best and best[radius + 1][0] < found[0]:
            found = best[radius + 1]
    return found[1]


def _keys(prints: np.ndarray, probe: Probe) -> list[np.ndarray]:
    """The group's bits of every fingerprint, then those with up to ``threshold`` turned."""
    own = prints & _mask(probe.bits)
    return [own ^ _mask(c) for k in range(probe.threshold + 1) for c in combinations(probe.bits, k)]


def probe_rows(prints: DataFrame, probes: Sequence[Probe]) -> DataFrame:
    """part, value, home, print: where a fingerprint is kept (home) and where it asks."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, probe in enumerate(probes):
                for i, value in enumerate(_keys(own, probe)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), part, dtype=np.int32)), pa.array(value.view(np.int64)),
                         pa.array(np.full(len(own), i == 0)), batch.column(0)],
                        names=["part", "value", "home", "print"])

    return prints.select("print").mapInArrow(spread, "part int, value bigint, home boolean, print bigint")


def linked(prints: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join whatever is within ``radius`` over any chain in which each
    step has a fingerprint at home; b is the smallest of its part."""
    left, a, b = np.arange(len(prints)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        part = [front]
        while len(front) and len(left):
            now, front = front[:256], front[256:]
            near = np.bitwise_count(prints[now][:, None] ^ prints[left][None, :]) <= radius
            near &= home[now][:, None] | home[left][None, :]
            hit = near.any(axis=0)
            front = np.concatenate([front, left[hit]])
            part.append(left[hit])
            left = left[~hit]
        own = prints[np.concatenate(part)].view(np.int64)
        if len(own) > 1:
            low = own.min()
            a.append(own[own != low])
            b.append(np.full(len(a[-1]), low))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(prints: DataFrame, probes: Sequence[Probe], radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """a, b: verified links enough to connect all that any chain of them connects."""
    rows = probe_rows(prints, probes)
    large = written(rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
                    .filter(F.col("n") > block)
                    .select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    # A member of block i goes to every pair of blocks that has i.
    dealt = (rows.join(large, ["part", "value"], "left")
             .withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("part", "value", "home", "print", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j")))
    kept = ["part", "value", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Buckets come one after the other; only the last one of a batch may go on in the next.
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            change, data = _changes(table, kept)
            cut = int(change[-1]) if len(change) else 0
            rest = table.slice(cut)
            yield from _verified(data, change, cut)
        if rest is not None and rest.num_rows:
            change, data = _changes(rest, kept)
            yield from _verified(data, change, rest.num_rows)

    def _changes(table: pa.Table, names: Sequence[str]):
        data = {c: table.column(c).to_numpy() for c in (*names, "home", "print")}
        moved = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for c in names:
            moved |= data[c][1:] != data[c][:-1]
        return np.flatnonzero(moved) + 1, data

    def _verified(data, change, end: int) -> Iterator[pa.RecordBatch]:
        edges = [0, *change[change < end].tolist(), end]
        a, b = [], []
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                x, y = linked(data["print"][lo:hi].view(np.uint64), data["home"][lo:hi], radius)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                                             names=["a", "b"])

    return (dealt.repartition(*kept).sortWithinPartitions(*kept).select(*kept, "home", "print")
            .mapInArrow(verify, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, block: int = BLOCK,
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    A-Z are lower-cased, words are runs of anything but the six ASCII blanks; bit i of the
    fingerprint is set if bit i is set in more than half of the XXH64 values (seed 42) of
    all ``words``-word shingles, repeats counted. Texts with fewer words are one shingle;
    null texts count as empty; texts without a word have fingerprint 0 and are linked like
    any others. Fingerprints link at ``radius`` or fewer differing bits. component_id is
    the smallest id reachable; null ids are passed over, so it is null only where all ids
    are. Repeated rows come out each; an empty table gives an empty result; other columns
    take no part.
    """
    prints = written(fingerprints(docs, words), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    sample = np.array([r[0] for r in hash_sample(nodes.select("print"), sample_rows, "print").collect()],
                      dtype=np.int64).view(np.uint64)
    probes = plan_probes(sample, nodes.count(), radius)
    roots = components(links(nodes, probes, radius, block))
    rooted = nodes.join(roots, nodes.print == roots.node, "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
