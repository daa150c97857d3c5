"""Numbers, booleans, dates and salary text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.fixed import (DATE_PATTERNS, FALSE_WORDS, STRICT_FALSE_WORDS, STRICT_TRUE_WORDS,
                            TRUE_WORDS, WEEKDAY)
from postmill.functions.text import squash, strip

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
STAMP = "yyyyMMdd_HHmmss"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?\s*$"
EPOCH_UNITS = {"s": 1.0, "ms": 1000.0}
# First second of year 1 and of year 10000.
FIRST_SECOND, END_SECOND = -62_135_596_800, 253_402_300_800


def to_number(c: Column) -> Column:
    """Double, or null where the text is not a number in decimal digits.

    A cast alone would also take '1d', '5f', 'NaN' and 'Infinity'.
    """
    written = c.cast("string")
    return F.when(written.rlike(NUMBER), written.try_cast("double"))


def loose_bool(c: Column) -> Column:
    """Boolean from its usual spellings; anything else is null."""
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def strict_bool(c: Column) -> Column:
    """As loose_bool with y/n; null stays null and unknown text is an error."""
    word = F.lower(strip(c))
    return (F.when(c.isNull(), F.lit(None).cast("boolean"))
            .when(word.isin(*STRICT_TRUE_WORDS), True)
            .when(word.isin(*STRICT_FALSE_WORDS), False)
            .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c.cast("string")))
                       .cast("boolean")))


def parse_instant(c: Column, epoch_unit: str = "s") -> Column:
    """Timestamp from an epoch number or date text; anything else is null, also
    a number outside the years 1 to 9999."""
    number = to_number(c)
    if epoch_unit not in EPOCH_UNITS:
        raise ValueError(f"epoch_unit must be 's' or 'ms', not {epoch_unit!r}")
    seconds = number / EPOCH_UNITS[epoch_unit]
    inside = F.when((seconds >= FIRST_SECOND) & (seconds < END_SECOND), seconds)
    from_number = (F.timestamp_seconds(inside) if epoch_unit == "s" else
                   F.timestamp_millis(F.when(inside.isNotNull(), number).cast("long")))
    return F.when(number.isNotNull(), from_number).otherwise(parse_date_text(c))


def parse_date_text(c: Column) -> Column:
    """Timestamp from ISO text or one of the other usual ways to write a date."""
    written = strip(c)
    bare = F.regexp_replace(F.regexp_replace(written, WEEKDAY, ""), r"\s+", " ")
    # The other patterns are tried only where ISO fails and the text has a digit, and each
    # only on texts with the marks that it asks for and none that it has no place for. A
    # zone's name may hold a slash.
    shapes: dict[tuple[bool, ...], list[str]] = {}
    for p in DATE_PATTERNS:
        shapes.setdefault(("MMM" in p, ":" in p, "," in p), []).append(p)

    def otherwise(text: Column) -> Column:
        letters, slash, colon, comma = (text.rlike(m) for m in ("[A-Za-z]", "/", ":", ","))
        return F.coalesce(*[
            F.when((letters if named else ~letters & slash) & (colon if timed else ~colon)
                   & (comma if listed else ~comma),
                   F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in same]))
            for (named, timed, listed), same in shapes.items()])

    # The cleaned text is an element, so that it is made once and not for every pattern.
    return F.coalesce(F.try_to_timestamp(c.cast("string")), F.when(
        bare.rlike("[0-9]"), F.get(F.transform(F.array(bare), otherwise), 0)))


def parse_iso(c: Column) -> Column:
    return parse_date_text(c)


def parse_stamp(c: Column) -> Column:
    """Timestamp from compact file-name text such as 20260131_235959."""
    return F.try_to_timestamp(c, F.lit(STAMP))


def iso_z(c: Column) -> Column:
    return F.date_format(c, ISO_Z)


def salary_number(c: Column) -> Column:
    """Thousands separators; two decimals only where there is a fraction."""
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def salary_text(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Readable salary: 'a–b', 'From a' or 'Up to b', then currency and period."""
    low_text, high_text = salary_number(low), salary_number(high)
    amount = (F.when(low.isNotNull() & high.isNotNull(), F.concat(low_text, F.lit("–"), high_text))
              .when(low.isNotNull(), F.concat(F.lit("From "), low_text))
              .when(high.isNotNull(), F.concat(F.lit("Up to "), high_text)))
    per = F.nullif(F.lower(squash(period)), F.lit(""))
    full = F.concat_ws(" ", amount, F.nullif(squash(currency), F.lit("")),
                       F.concat(F.lit("per "), per))
    return F.when(amount.isNull(), "").otherwise(full)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole.cast("double")), digits)


def exact_mean(c: Column, digits: int = 2) -> Column:
    """Rounded average that does not depend on the order of addition.

    Money adds up in decimals, so a mean that ends in exactly half a cent
    rounds the same way however the rows are partitioned.
    """
    return F.round(F.avg(c.cast("decimal(28,8)")), digits).cast("double")
