"""Text normalisation as Column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Java leaves out.
WS = r"[\s\x1c-\x1f]"


def squash(c: Column) -> Column:
    """Collapse white space to single blanks and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"(?U){WS}+", " "))


def strip(c: Column) -> Column:
    """Trim white space of any kind at both ends; null becomes ''."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"(?U)^{WS}+|{WS}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def drop_urls(c: Column) -> Column:
    """Blank out web addresses, then squash.

    The expression runs only on texts that hold what every address holds.
    """
    low = F.lower(c)
    return squash(F.when(low.contains("://") | low.contains("www."),
                         F.regexp_replace(c, r"(?iU)https?://\S+|www\.\S+", " ")).otherwise(c))


def fold(c: Column) -> Column:
    """Lower case in which one character stays one character.

    The four letters listed are the ones a case-insensitive ASCII match also
    accepts; mapping them first keeps offsets equal to those of the input.
    """
    for char, plain in zip("İıſK", "iisk"):
        c = F.replace(c, F.lit(char), F.lit(plain))
    return F.lower(c)


def casefold_sort(values: Column) -> Column:
    """Sort strings ignoring case, ties by the raw value."""
    keyed = F.transform(values, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def pipe_list(values: Column, ignore_case: bool = True) -> Column:
    """Clean, de-duplicate, sort and pipe-join an array; null becomes ''."""
    clean = F.array_distinct(F.filter(F.transform(values, squash), lambda x: x != ""))
    ordered = casefold_sort(clean) if ignore_case else F.array_sort(clean)
    return F.coalesce(F.array_join(ordered, "|"), F.lit(""))


def location_list(values: Column) -> Column:
    """Pipe list of place names; elements are names or JSON objects with `name`."""
    def name_of(x: Column) -> Column:
        is_object = F.ltrim(x).startswith("{")
        return F.when(is_object, F.get_json_object(x, "$.name")).otherwise(x)

    return (F.when(values.isNull(), "")
            .when(F.size(values) == 0, "Worldwide")
            .otherwise(pipe_list(F.transform(values, name_of))))


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    """First 20 hex digits of SHA-256 over the three lower-cased parts."""
    parts = [F.lower(squash(c)) for c in (company, title, location)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


# A tag starts with a letter, '/' and a letter, '!' or '?'; any other '<' is text.
# Quoted values may hold '>'; where quotes do not close, the next '>' ends the tag.
TAG = (r"""<(?:[A-Za-z]|/[A-Za-z]|[!?])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""")
DROPPED = (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", TAG)

# The named character references of HTML, from the table in Python's library. Those
# without a semicolon are the old ones that HTML also takes bare.
NAMED = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}
BARE = {name: chars for name, chars in html5.items() if not name.endswith(";")}
BARE_PATTERN = "^(" + "|".join(sorted(BARE, key=lambda n: (-len(n), n))) + ")"


def _by_letter(table: dict[str, str]) -> str:
    """A table as JSON text, by the first letter of its names."""
    letters: dict[str, dict[str, str]] = {}
    for name, chars in table.items():
        letters.setdefault(name[0], {})[name] = chars
    return json.dumps(letters)


def _lookup(table: str, key: Column) -> Column:
    """The value of a table made by `_by_letter`; null for any other key.

    The table is one literal, which the planner turns into a constant once, and a look-up
    passes over the names with one first letter only."""
    letters = F.from_json(F.lit(table), "map<string, map<string, string>>")
    return F.try_element_at(F.try_element_at(letters, F.substring(key, 1, 1)), key)


def _windows_1252() -> dict[str, str]:
    """What the numbers 128 to 159 stand for in HTML, where they stand for anything."""
    found = {str(i): bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
    return {number: char for number, char in found.items() if char}


NAMED_TABLE, BARE_TABLE, WINDOWS_TABLE = (_by_letter(t) for t in (NAMED, BARE, _windows_1252()))


def _numbered(digits: Column) -> Column:
    """The character of a decimal number or x and a hexadecimal one; null if there is none."""
    hexadecimal = F.lower(F.substring(digits, 1, 1)) == "x"
    plain = F.regexp_replace(digits, "^[xX]?0*", "")
    code = F.when(F.length(plain) > 7, F.lit(0)).otherwise(
        F.when(hexadecimal, F.conv(plain, 16, 10)).otherwise(plain).try_cast("long"))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(valid, F.coalesce(_lookup(WINDOWS_TABLE, code.cast("string")), char))


def decode_references(c: Column) -> Column:
    """Decode character references once: &name; &#12; &#xC; and the old bare names.

    The text is cut at each '&', and each piece is looked at on its own, so what a
    reference stands for is never read as a part of another one.
    """
    def piece(part: Column) -> Column:
        digits = F.regexp_extract(part, "^#([xX][0-9A-Fa-f]+|[0-9]+);?", 1)
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(part, BARE_PATTERN, 1)
        named, numbered = _lookup(NAMED_TABLE, name), _numbered(digits)
        return (F.when((digits != "") & numbered.isNotNull(), F.concat(numbered, F.regexp_replace(
                    part, "^#([xX][0-9A-Fa-f]+|[0-9]+);?", "")))
                .when((name != "") & named.isNotNull(),
                      F.concat(named, F.substr(part, F.length(name) + 2)))
                .when(bare != "", F.concat(_lookup(BARE_TABLE, bare), F.substr(part, F.length(bare) + 1)))
                .otherwise(F.concat(F.lit("&"), part)))

    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.contains(c, F.lit("&")),
                  F.concat(parts[0], F.array_join(rest, ""))).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Plain text of an HTML string.

    Comments, script and style blocks go, every other tag becomes a blank,
    character references are decoded once, white space is collapsed.
    """
    text = F.coalesce(c, F.lit(""))
    for dropped in DROPPED:
        text = F.regexp_replace(text, dropped, " ")
    return squash(decode_references(text))
