"""Column expressions that clean text, numbers and dates; none raises on dirty input in ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
#: Fixed values. Each is tried in turn; the first that fits wins. Feeds of events write days first.
EVENT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "yyyy-MM-dd")
#: Those of shop orders, of which all else is guessed.
ORDER_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy")
#: For feeds that mix them; slashes have the month first.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def blank_to(c: Column, default: str) -> Column:
    """A null or blank text becomes ``default``."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def first_number(c: Column) -> Column:
    """The first signed number in a text, as double; null without one."""
    return F.regexp_extract(c, r"(-?\d+\.?\d*)", 1).try_cast("double")


def strip_currency(c: Column) -> Column:
    """A price text without currency sign, thousands separators and quotes, as double; null if that is no number."""
    return F.trim(F.regexp_replace(c, '[₹,"]', "")).try_cast("double")


def title_case(c: Column) -> Column:
    """Every run of ASCII letters with its first letter upper-cased and white space collapsed.

    ``initcap`` alone starts words at white space only.
    """
    squeezed = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.array_join(F.transform(F.regexp_extract_all(squeezed, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), F.initcap), "")


def invalid_email(c: Column) -> Column:
    return c.isNull() | ~F.trim(c).rlike(EMAIL)


def parse_timestamp(c: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def guess_timestamp(c: Column) -> Column:
    """An order's time: its two formats, then the engine's own reading of ISO dates and months first."""
    return F.coalesce(parse_timestamp(c, ORDER_FORMATS), c.try_cast("timestamp"), parse_timestamp(c, ("yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss")))


def rounded(c: Column, digits: int = 2) -> Column:
    """Half away from zero, by decimal digits: a double is first taken to 10 digits, so binary ties do not tell."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def signed_percent(c: Column) -> Column:
    """+1.5% or -2.0%, and n/a for a null."""
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.when(c >= 0, "+").otherwise(""), F.format_number(c, 1), F.lit("%")))


def forward_fill(c: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The last value so far that is not null, within ``keys`` and in an explicit order."""
    return F.last(c, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def percent_change(now: Column, before: Column) -> Column:
    """Null where there is nothing to compare with."""
    return F.when(before.isNull() | (before == 0), None).otherwise((now - before) * 100.0 / before)


def row_hash(*columns: Column) -> Column:
    """SHA-256 over the columns as text in the given order; a null is an empty text."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)
