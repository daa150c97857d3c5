"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns find e-mail addresses, IP addresses, card and phone numbers as they are
usually written. The field adds what they miss (spelled-out addresses, national phone
numbers, other separators). It scores whole candidate segments by features of the span as
a whole; a dynamic program over segments of bounded length chooses boundaries and kinds
together. It is trained on what the patterns find in a bounded sample: each found value,
as it stands and rewritten in the ways people write it, in its own surroundings. It looks
only at zones with enough digits, four groups of them, or a spelled-out "at" or "dot".
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import hash_sample, id_text

KINDS = ("email", "ip", "card", "phone")
#: Documents of training at most, the ones with the smallest hash of their id, and found values.
SAMPLE_ROWS, SAMPLE_VALUES = 3_000, 800
#: Tokens of a segment at most.
REACH = 24
#: Tokens of a zone that are cut up together, and how many around them are looked at too.
STRETCH, AROUND = 2_048, 4 * REACH
#: A segment is added from this posterior probability on.
SURE = 0.5

# Fixed patterns. A look-behind spares starting again inside a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_NUMBERS = re.compile(r"[(+]?[0-9][0-9\x20().\[\]/_-]{5,}[0-9]")
_SPELLED = re.compile(r"(?i)[\[({<]\s?(?:at|dot)\s?[\])}>]|(?<![^\W_])dot(?![^\W_])")
_HEDGED = re.compile(r"[\[({<]\s?at")
# An "@" with blanks beside it, and four groups of digits around dots that are not plain.
_SPACED_AT = re.compile(r"(?<=[\w.%+-])(?:\s@\s?|@\s)(?=[\w-])")
_DOT = r"(?:\s?[\[({<]\s?(?:\.|(?i:dot))\s?[\])}>]\s?|\s?\.\s?|\s(?i:dot)\s)"
_FOUR = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Each ``@`` has at most one match, which starts where its run of local characters
    does, or where the match before it ended; so runs without ``@`` are never scanned."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield "email", start, end
        # What lies before this ``@`` cannot be local to a later one: ``@`` is no local character.
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """By kind as in ``KINDS``, then start. Matches that fail a kind's test are dropped."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group() if m.end() - m.start() > 64 else _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def zones(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Where the field looks: numbers of 7 digits or more that no pattern covers, four
    groups of digits however their dots are written, and the surroundings of a spaced "@"
    or a spelled-out "at" or "dot"."""
    out = []
    for m in _NUMBERS.finditer(text):
        if len(_NOT_DIGIT.sub("", m.group())) >= 7:
            out.append((max(0, m.start() - 16), m.end() + 16))
    out += [(max(0, m.start() - 16), m.end() + 16) for m in _FOUR.finditer(text)]
    if "@" in text:
        out += [(max(0, m.start() - 64), m.end() + 64) for m in _SPACED_AT.finditer(text)]
    low = text.lower()  # most texts are settled by these two quick tests
    if "dot" in low or _HEDGED.search(low):
        out += [(max(0, m.start() - 64), m.end() + 64) for m in _SPELLED.finditer(text)]
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    # Spans of two kinds may overlap: joined, they stand in order with their ends.
    covered: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if covered and s < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    free, at = [], 0
    for a, b in merged:
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        end = at
        while end < len(covered) and covered[end][0] < b:
            end += 1
        # Base spans split a zone; what is left is searched if it could still hold something.
        for s, e in covered[at:end] + [(b, b)]:
            part = text[a:max(a, s)]
            if (len(_NOT_DIGIT.sub("", part)) >= 7 or _SPELLED.search(part) or _FOUR.search(part)
                    or _SPACED_AT.search(part)):
                free.append((a, s))
            a = max(a, e)
    return [(a, min(b, len(text))) for a, b in free]


def _kind_of(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c in "+(@." else "p"


def span_features(span: str, before: str, after: str) -> list[str]:
    """Features of a segment as a whole; ``before`` and ``after`` are the next characters."""
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    low = span.lower()
    letters = any(c.isalpha() for c in re.sub(r"\b(?:at|dot)\b", "", low))
    at = "@" if "@" in span else "[at]" if re.search(r"[\[({<]\s?at\s?[\])}>]", low) else "at" if re.search(r"\bat\b", low) else ""
    dot = "[dot]" if re.search(r"[\[({<]\s?dot\s?[\])}>]", low) else "dot" if re.search(r"\bdot\b", low) else "." if "." in span else ""
    marks = "".join(sorted(set(re.sub(r"[\w\s]", "", span))))
    out = ["bias", f"first={_kind_of(span[0])}", f"last={_kind_of(span[-1])}", f"before={_kind_of(before) if before else ''}",
           f"after={_kind_of(after) if after else ''}", f"letters={letters}",
           f"even={span.count('(') == span.count(')') and span.count('[') == span.count(']')}"]
    if letters or at:
        shape = re.fullmatch(r"[\w.%+-]+?\s?(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s)\s?[\w-]+"
                             r"(?:\s?(?:\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s)\s?[\w-]+)+", low)
        out += [f"at={at}", f"dot={dot}", f"address={shape is not None}", f"address={shape is not None},at={at},dot={dot}",
                f"end={len(re.split(r'[^a-z]+', low)[-1]) in (2, 3, 4)}", f"words={min(len(low.split()), 9)}"]
    else:
        out += [f"digits={min(len(digits), 20)}", f"groups={'-'.join(str(min(len(g), 9)) for g in groups[:6])}",
                f"marks={marks}", f"luhn={16 <= len(digits) <= 19 and luhn(digits)}",
                f"four={len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)},{marks}",
                f"plus={span[0] == '+'}", f"digits={min(len(digits), 20)},first={_kind_of(span[0])}"]
    return out


def candidates(tokens: list[str], before: str = "", after: str = "") -> list[tuple[int, int, list[str]]]:
    """Segments (first token, last token + 1, features) that could be an entity: bounded,
    no blank at either end, with four digits or a spelled-out part."""
    out = []
    for i, first in enumerate(tokens):
        if not (first[0].isalnum() or first in "(+"):
            continue
        n_digits, marked = 0, False
        for j in range(i, min(i + REACH, len(tokens))):
            last = tokens[j]
            n_digits += len(last) if last[0].isdigit() else 0
            marked = marked or last.lower() in ("@", "dot", "at")
            if not last[-1].isalnum() or n_digits > 19 and not marked:
                continue
            if n_digits >= 4 or marked and j - i >= 4:
                out.append((i, j + 1, span_features("".join(tokens[i:j + 1]), tokens[i - 1][-1] if i else before,
                                                    tokens[j + 1][0] if j + 1 < len(tokens) else after)))
    return out


@dataclass
class SemiMarkov:
    """Weights by (kind, feature); tokens outside entities score 0."""

    weights: dict[tuple[str, str], float] = field(default_factory=lambda: defaultdict(float))

    def scored(self, segments):
        w = self.weights
        return [(i, j, k, sum(w.get((k, f), 0.0) for f in feats)) for i, j, feats in segments for k in KINDS]

    def posterior(self, n: int, arcs) -> list[float]:
        """Probability of each arc, over all ways to cut ``n`` tokens into segments."""
        ending, starting = defaultdict(list), defaultdict(list)
        for a in arcs:
            ending[a[1]].append(a)
            starting[a[0]].append(a)
        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1]
            for i, _, _, s in ending[j]:
                ahead[j] = _log_add(ahead[j], ahead[i] + s)
        for i in range(n - 1, -1, -1):
            back[i] = back[i + 1]
            for _, j, _, s in starting[i]:
                back[i] = _log_add(back[i], back[j] + s)
        return [exp(min(0.0, ahead[i] + s + back[j] - ahead[n])) for i, j, _, s in arcs]

    def best(self, n: int, arcs) -> list[int]:
        """The arcs of the best way to cut."""
        ending = defaultdict(list)
        for x, a in enumerate(arcs):
            ending[a[1]].append(x)
        value, through = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for x in ending[j]:
                if value[arcs[x][0]] + arcs[x][3] > value[j]:
                    value[j], through[j] = value[arcs[x][0]] + arcs[x][3], x
        chosen, j = [], n
        while j > 0:
            if through[j] >= 0:
                chosen.append(through[j])
                j = arcs[through[j]][0]
            else:
                j -= 1
        return chosen[::-1]

    def find(self, zone: str, before: str = "", after: str = "", stretch: int = STRETCH) -> list[Span]:
        """Spans of a zone. A long one is cut up in stretches of tokens; each is read with
        its surroundings and answers for the spans that begin in it, so memory is bounded
        and time grows with the length."""
        tokens = _TOKEN.findall(zone)
        place = np.cumsum([0, *map(len, tokens)]).tolist()
        out: list[Span] = []
        for begin in range(0, len(tokens), stretch):
            lo, hi = max(0, begin - AROUND), min(len(tokens), begin + stretch + AROUND)
            own = tokens[lo:hi]
            segments = candidates(own, tokens[lo - 1][-1] if lo else before, tokens[hi][0] if hi < len(tokens) else after)
            if not segments:
                continue
            arcs = self.scored(segments)
            sure = self.posterior(len(own), arcs)
            for x in self.best(len(own), arcs):
                i, j, kind, _ = arcs[x]
                if sure[x] >= SURE and begin <= lo + i < begin + stretch and (not out or place[lo + i] >= out[-1][2]):
                    out.append((kind, place[lo + i], place[lo + j]))
        return out


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


def rewritten(kind: str, value: str, draw: np.random.Generator) -> str:
    """One of the ways people write such a value."""
    if kind == "email":
        at, dot = ((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."))[draw.integers(5)]
        name, _, host = value.partition("@")
        return f"{name}{at}{host.replace('.', dot)}"
    groups = re.findall("[0-9]+", value)
    if kind == "ip":
        return (" . ", "[.]", "(.)", "[dot]")[draw.integers(4)].join(groups)
    if kind == "card":
        digits = "".join(groups)
        return (".", "/", "_", "  ")[draw.integers(4)].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    digits = "".join(groups)[-10:]
    if len(digits) < 10:
        return value
    a, b, c = digits[:3], digits[3:6], digits[6:]
    return (f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")[draw.integers(4)]


def _examples(docs: DataFrame) -> DataFrame:
    """doc_id, kind ('' for a zone without a base span), before, value, after."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                found = [s for s in spans if s[2] - s[1] <= 80] + [("", *z) for z in zones(text, spans)]
                rows += [(str(doc), k, text[max(0, s - 24):s], text[s:min(e, s + 200)], text[e:e + 24]) for k, s, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows
                                             else [pa.array([], pa.string())] * 5,
                                             names=["doc_id", "kind", "before", "value", "after"])

    return docs.mapInArrow(cut, "doc_id string, kind string, before string, value string, after string")


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_values: int = SAMPLE_VALUES,
          epochs: int = 4, rate: float = 0.2, seed: int = 5) -> SemiMarkov:
    """Fit on values found in at most ``sample_rows`` documents, at most ``sample_values`` of
    each kind, the same ones on every run."""
    texts = id_text(docs)
    chosen = hash_sample(docs.select("doc_id").distinct(), sample_rows, "doc_id")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value", "before"), "value", "before", "after", "doc_id")
    found = (_examples(texts.join(F.broadcast(chosen), "doc_id", "left_semi"))
             .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample_values)
             .select("kind", "before", "value", "after").collect())
    draw, model = np.random.default_rng(seed), SemiMarkov()
    lessons = []
    for kind, before, value, after in sorted(found):
        for written in ([value] if not kind else [value, rewritten(kind, value, draw), rewritten(kind, value, draw)]):
            head, span, tail = _TOKEN.findall(before), _TOKEN.findall(written), _TOKEN.findall(after)
            segments = candidates([*head, *span, *tail])
            gold = (len(head), len(head) + len(span), kind)
            if not kind or any(s[:2] == gold[:2] for s in segments):
                lessons.append((len(head) + len(span) + len(tail), segments, gold))
    w = model.weights
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for x in draw.permutation(len(lessons)):
            n, segments, gold = lessons[x]
            arcs = model.scored(segments)
            for (i, j, k, _), p, feats in zip(arcs, model.posterior(n, arcs), (f for s in segments for f in [s[2]] * len(KINDS))):
                slope = ((i, j, k) == gold) - p
                if abs(slope) > 1e-4:
                    for f in feats:
                        w[k, f] += step * slope
    model.weights = dict(w)
    return model


def apart_from(spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``others``."""
    others = sorted((s, e) for _, s, e in others)
    starts, reach = [s for s, _ in others], [0]
    for _, e in others:
        reach.append(max(reach[-1], e))
    # Of the others that begin before a span's end, none may reach beyond its start.
    return [x for x in spans if reach[bisect_left(starts, x[2])] <= x[1]]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def personal_data(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row.

    The counts and the digest are of what the fixed patterns find; ``spans`` lists those
    and what the field adds (``n_added`` of them), as kind:start:end in code points, by
    kind, then start. Added spans overlap no other span. Null texts count as empty and
    have no span. Repeated rows come out each; an empty table gives an empty result; other
    columns take no part.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                added: list[Span] = []
                for a, b in zones(text, base):
                    found = model.find(text[a:b], text[a - 1:a] if a else "", text[b:b + 1])
                    added += [(k, a + s, a + e) for k, s, e in found]
                added = apart_from(added, base)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS),
                             sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_text(docs).mapInArrow(search, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                                    + ", base_sha256 string, spans string, n_added bigint")
