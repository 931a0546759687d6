"""Timestamps as log exports write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 date, or date and time with an optional zone; nothing shorter, so a
# bare clock time or a plain number never turns into a date.
_ISO = (
    r"^\s*[0-9]{4}(?:-[0-9]{1,2}(?:-[0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}"
    r"(?::[0-9]{2}(?:[.][0-9]+)?)?\s*(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})?)?)?)?\s*$"
)

# Other everyday forms: what a text of that form looks like, what to drop from it (parsers
# take no day names), and the formats to try.
_FORMS = (
    (
        r"(?i)^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4},? [0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)? [ap]m\s*$",
        ",",
        ("M/d/yyyy h:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS] a",),
    ),
    (
        r"^\s*[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?: [0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)?)?\s*$",
        "",
        ("yyyy/M/d[ H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS]]",),
    ),
    (
        r"^\s*(?:[A-Z][a-z]{2}, )?[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}(?::[0-9]{2})? (?:GMT|UTC)\s*$",
        "^\\s*[A-Z][a-z]{2}, | (?:GMT|UTC)\\s*$",
        ("d MMM yyyy HH:mm[:ss]",),
    ),
)


def to_millis(ts: Column) -> Column:
    """Cut a timestamp to whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(ts))


def parse_timestamp(text: Column, extra_formats: tuple[str, ...] = ()) -> Column:
    """Timestamp in whole milliseconds, or NULL when ``text`` is no date."""
    parsed = F.when(text.rlike(_ISO), F.try_to_timestamp(text))
    for looks, drop, formats in _FORMS:
        plain = F.upper(text) if "ap]m" in looks else text
        plain = F.trim(F.regexp_replace(plain, drop, "") if drop else plain)
        tried = [F.try_to_timestamp(plain, F.lit(f)) for f in formats]
        parsed = parsed.when(text.rlike(looks), F.coalesce(*tried))
    if extra_formats:
        parsed = F.coalesce(parsed, *[F.try_to_timestamp(text, F.lit(f)) for f in extra_formats])
    return to_millis(parsed)


def epoch() -> Column:
    return F.timestamp_millis(F.lit(0).cast("bigint"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
