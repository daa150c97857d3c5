"""URL filter by Bloom filter cascades.

A cascade answers membership in a list without error for every key of a known universe:
level 0 is a Bloom filter of the listed keys, level 1 one of the universe's keys that
level 0 wrongly lets through, level 2 one of the listed keys that level 1 wrongly lets
through, and so on until nothing is. The universe is every key that a url of the corpus
can ask for, so urls are judged exactly, in one pass over the pages and without a join.

All lists share one cascade: a key is tagged with its list. Its size follows the lists, not
the corpus. Keys are cut into shards of at most ``SHARD_KEYS`` by hash, and one pass over
the pages carries at most ``SHARDS_PER_PASS`` shards; longer lists take more passes, each
one's result written before the next begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import written

SHARD_KEYS = 1 << 20
SHARDS_PER_PASS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    start = F.locate("://", F.coalesce(url, F.lit("")))
    found = F.regexp_extract(F.substr(url, start + 3), "^[^/?#]*", 0)
    return F.when(start > 0, F.translate(found, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    start = F.locate("://", F.coalesce(url, F.lit("")))
    found = F.regexp_extract(F.substr(url, start + 3), "^[^/?#]*([^?#]*)", 1)
    return F.when(start > 0, found).otherwise("")


def keys_of(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """What a url asks for: each parent of its host, itself included, with each prefix of
    its path that is as long as some listed path."""
    labels = host.split(".")
    return [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)]


def places(key: str, level: int, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=level + 1)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(hashes)]


def shard_of(key: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) % shards


class Level:
    """One Bloom filter; ``words`` hold its bits."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(keys * self.hashes / math.log(2) / 64) * 64)
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)

    def __contains__(self, key: str) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in places(key, self.number, self.bits, self.hashes))


class Cascade:
    """Levels, read until one misses: an even level's miss means unlisted, an odd one's listed."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    def __contains__(self, key: str) -> bool:
        for level in self.levels:
            if key not in level:
                return level.number % 2 == 1
        return len(self.levels) % 2 == 1


def _filled(level: Level, keys: DataFrame) -> Level:
    """Bits are set in tasks, words merged by a shuffle; what comes here, in one job, has the
    level's size: ``bits`` / 64 words at most."""
    number, bits, hashes = level.number, level.bits, level.hashes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[int, int] = {}
            for key in batch.column(0).to_pylist():
                for p in places(key, number, bits, hashes):
                    words[p >> 6] = words.get(p >> 6, 0) | 1 << (p & 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.keys(), pa.int64()),
                 pa.array(np.fromiter(words.values(), dtype=np.uint64, count=len(words)).view(np.int64))],
                names=["word", "bits"])

    merged = keys.select("key").mapInArrow(place, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = merged.toArrow()
    level.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([key in level for key in batch.column(0).to_pylist()], pa.bool_()))

    return keys.select("key").mapInArrow(test, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Both have distinct ``key``s; keys of the universe that are listed count as listed."""
    n_in = listed.count()
    if n_in == 0:
        return Cascade([])
    inside, outside = listed, written(universe.join(listed, "key", "left_anti"), "unlisted")
    n_out, levels = outside.count(), []
    while True:
        # As small in all as can be: the first level lets through about as many as are listed.
        rate = min(0.5, n_in / max(n_out, 1) / math.sqrt(2)) if not levels else 0.5
        level = _filled(Level(len(levels), n_in, rate), inside)
        levels.append(level)
        passed = written(_passing(outside, level), "let-through")
        n_passed = passed.count()
        if n_passed == 0:
            return Cascade(levels)
        inside, outside, n_in, n_out = passed, inside, n_passed, n_in


def asked_keys(parsed: DataFrame, lengths: Mapping[str, Sequence[int]]) -> DataFrame:
    """The universe: distinct tagged keys of all urls, for the path lengths of each list."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            found = {tag + k for h, p in pairs for tag, own in lengths.items() for k in keys_of(h, p, own)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    reach = max((n for own in lengths.values() for n in own), default=0)  # longer paths ask for nothing more
    return (parsed.select("host", F.substring("path", 1, reach).alias("path"))
            .mapInArrow(spread, "key string").distinct())


def _shards(keys: DataFrame, shard: int, shards: int) -> DataFrame:
    if shards == 1:
        return keys

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shard_of(k, shards) == shard for k in batch.column(0).to_pylist()], pa.bool_()))

    return keys.mapInArrow(pick, "key string")


def with_longest(parsed: DataFrame, lists: Mapping[str, DataFrame], shard_keys: int = SHARD_KEYS,
                 shards_per_pass: int = SHARDS_PER_PASS) -> DataFrame:
    """``parsed`` (page_id, host, path) and, for each named list of host and path, the longest
    listed key the url asks for, or null."""
    tags = {name: f"{i}:" for i, name in enumerate(lists)}
    tagged = None
    for name, listed in lists.items():
        own = listed.select(F.lit(tags[name]).alias("tag"), F.concat(F.lit(tags[name]), "host", "path").alias("key"),
                            F.length("path").alias("n"))
        tagged = own if tagged is None else tagged.unionByName(own)
    # Path lengths are as many as the longest listed path has characters, at most.
    lengths: dict[str, list[int]] = {tag: [] for tag in tags.values()}
    for r in tagged.select("tag", "n").distinct().orderBy("tag", "n").collect():
        lengths[r.tag].append(r.n)
    keys = written(tagged.select("key").distinct(), "listed")
    universe = written(asked_keys(parsed, lengths), "asked")
    shards = max(1, math.ceil(keys.count() / shard_keys))
    names = list(lists)
    others = [c for c in parsed.columns if c not in names]
    out = parsed.select(*others, *[F.lit(None).cast("string").alias(n) for n in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for first in range(0, shards, shards_per_pass):
        cascades = {s: build_cascade(_shards(keys, s, shards), _shards(universe, s, shards))
                    for s in range(first, min(shards, first + shards_per_pass))}

        def look(batches: Iterable[pa.RecordBatch], cascades=cascades) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known: dict[str, bool] = {}
                best: dict[str, list] = {n: [] for n in names}
                columns = [batch.column(c).to_pylist() for c in ("host", "path", *names)]
                for host, path, *found in zip(*columns):
                    for name, had in zip(names, found):
                        tag = tags[name]
                        for key in keys_of(host, path, lengths[tag]):
                            asked = tag + key
                            if asked not in known:
                                cascade = cascades.get(shard_of(asked, shards))
                                known[asked] = cascade is not None and asked in cascade
                            if known[asked] and len(key) > len(had or ""):
                                had = key
                        best[name].append(had)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), *(pa.array(best[n], pa.string()) for n in names)],
                    names=[*others, *names])

        out = out.mapInArrow(look, kinds)
        if first + shards_per_pass < shards:
            out = written(out, "judged")
    return out


def filter_urls(pages: DataFrame, block: DataFrame, allow: DataFrame, listed: DataFrame,
                shard_keys: int = SHARD_KEYS, shards_per_pass: int = SHARDS_PER_PASS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: one row per row of ``pages``.

    ``block`` and ``allow`` are rules (host, path), ``listed`` is a block list of the same
    shape that applies where no rule does; ``listed`` in the result names its key. The
    longest rule wins; of a rule in both lists, block. A null url, or one without
    ``://``, has empty host and path. Null or empty listed hosts are ignored; a null
    listed path is an empty one. Repeated pages are judged each; empty tables give an
    empty result; other columns take no part.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lists = {name: rules.filter("host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"),
                                                     F.coalesce("path", F.lit("")).alias("path"))
             for rules, name in ((block, "blocked"), (allow, "allowed"), (listed, "listed"))}
    parsed = with_longest(parsed, lists, shard_keys, shards_per_pass)
    longer = F.coalesce(F.length("blocked"), F.lit(-1)) >= F.coalesce(F.length("allowed"), F.lit(0))
    return parsed.select(
        "page_id", "host", "path", F.when(longer, F.col("blocked")).otherwise(F.col("allowed")).alias("rule"),
        F.when(longer, "block").when(F.col("allowed").isNotNull(), "allow")
        .when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict"), "listed")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pa.table({"host": pa.array([h for h, _ in rules], pa.string()),
                                           "path": pa.array([p for _, p in rules], pa.string())}))


BLOCK = (("net", "/"), ("example.com", "/de/"))
ALLOW = (("example.net", "/en/"), ("org", "/fr/"))
#: Hosts listed as advertising, gambling, pills, spam and adult sites.
LISTED = tuple((f"{name}.example.{top}", "") for name in
               ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
               for top in ("com", "net", "org"))

SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    nullif(regexp_extract(host, '(^|\.)((ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)'
                                || '\.example\.(com|net|org))$', 2), '') AS listed
  FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""
