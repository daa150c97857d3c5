"""Whole-term alias matching of a dictionary against text, inside one row.

The dictionary travels as one constant array column. Each text is cut into
words once; an alias is a candidate only if its anchor, its longest ASCII word,
is among them. An alias that is its own anchor has then been found; others pass
a substring search and a boundary-aware regular expression. Cost follows the
hits, not the size of the dictionary, and nothing here shuffles.

Matching ignores case by working on folded text (see `functions.text.fold`),
in which white space is single blanks and offsets are those of the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.fixed import (APPLIED_TERMS, CONTEXT_CHARS, EDUCATION_TERMS, EXCERPT_AFTER,
                            EXCERPT_BEFORE, STUDY_FIELD_SKILL)
from postmill.functions.text import fold, squash, strip


@dataclass(frozen=True)
class Skill:
    key: str
    name: str
    category: str
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class ContextRule:
    """Ignore a hit of `skill` whose surroundings hold one of `when_terms` and
    none of `unless_terms`; only the first hit of an alias is looked at."""
    skill: str
    when_terms: tuple[str, ...]
    unless_terms: tuple[str, ...]
    chars: int = CONTEXT_CHARS


STUDY_FIELD_RULE = ContextRule(STUDY_FIELD_SKILL, EDUCATION_TERMS, APPLIED_TERMS)


def skills_from_rows(rows: Iterable[Sequence[str]]) -> tuple[Skill, ...]:
    """Skills from (key, name, category, pipe-joined aliases) rows."""
    return tuple(Skill(key, name, category,
                       tuple(a.strip() for a in aliases.split("|") if a.strip()))
                 for key, name, category, aliases in rows)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _needle(alias: str) -> str:
    return " ".join(alias.split()).translate(str.maketrans("İıſK", "iisk")).lower()


def _anchor(needle: str) -> str:
    return max(re.findall("[a-z0-9_]+", needle), key=lambda w: (len(w), w), default="")


def dictionary_column(skills: Sequence[Skill]) -> Column:
    """The dictionary as a constant array of structs <skill_key, alias, needle, anchor>."""
    entries = ", ".join(
        f"named_struct('skill_key', {_quote(s.key)}, 'alias', {_quote(a)}, "
        f"'needle', {_quote(_needle(a))}, 'anchor', {_quote(_anchor(_needle(a)))})"
        for s in skills for a in s.aliases)
    return F.expr(f"array({entries})")


def whole_term(needle: Column) -> Column:
    """Pattern for a folded term that no ASCII letter, digit or '_' touches."""
    return F.concat(F.lit(r"(?<![a-z0-9_])\Q"), needle, F.lit(r"\E(?![a-z0-9_])"))


def anchors_in(folded: Column, skills: Sequence[Skill]) -> Column:
    """The anchors of the dictionary that occur in one text as words.

    An alias without ASCII words has the anchor '', which every text contains.
    """
    anchors = sorted({_anchor(_needle(a)) for s in skills for a in s.aliases})
    return F.array_intersect(F.lit(anchors), _words_and_blank(folded))


def candidates(dictionary: Column, anchors: Column) -> Column:
    return F.filter(dictionary, lambda e: F.array_contains(anchors, e["anchor"]))


def _words_and_blank(folded: Column) -> Column:
    return F.concat(F.regexp_extract_all(folded, F.lit("[a-z0-9_]+"), 0), F.array(F.lit("")))


def _has_any(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def match_context(text: Column, pattern: Column, chars: int) -> Column:
    """Up to `chars` characters either side of the first match, with the match.

    Splitting once at the match gives both sides in code points and in linear
    time. Null when nothing matches.
    """
    def around(sides: Column) -> Column:
        before, after = F.length(F.get(sides, 0)), F.length(F.get(sides, 1))
        start = F.greatest(before - chars, F.lit(0))
        end = F.least(F.length(text), F.length(text) - after + chars)
        return F.when(F.size(sides) == 2, F.substring(text, start + 1, end - start))

    return once(F.split(text, pattern, 2), around)


def alias_hits(folded: Column, entries: Column, rules: Sequence[ContextRule]) -> Column:
    """Those of the candidate entries that are found in one folded text."""
    def found(entry: Column) -> Column:
        needle = entry["needle"]
        hit = (needle == entry["anchor"]) | (F.contains(folded, needle)
                                             & F.rlike(folded, whole_term(needle)))
        for rule in rules:
            # The surroundings are cut out once for all terms.
            hit = hit & ~((entry["skill_key"] == rule.skill) & once(
                match_context(folded, whole_term(needle), rule.chars),
                lambda around: _has_any(around, rule.when_terms) & ~_has_any(around, rule.unless_terms)))
        return hit

    return F.filter(entries, found)


def excerpt(text: Column, folded: Column, aliases: Column, before: int = EXCERPT_BEFORE,
            after: int = EXCERPT_AFTER) -> Column:
    """Text around the first of `aliases` (in their order) that occurs anywhere
    in the cleaned text, ignoring case and word boundaries; else null. `folded`
    is the folded text, a column of its own."""
    first = F.get(F.filter(aliases, lambda a: (a != "") & F.contains(folded, fold(a))), 0)
    at = F.instr(folded, fold(first))
    start = F.greatest(at - 1 - before, F.lit(0))
    end = F.least(F.length(text), at - 1 + F.length(first) + after)
    return F.when(first.isNotNull(), F.trim(F.substring(text, start + 1, end - start)))
