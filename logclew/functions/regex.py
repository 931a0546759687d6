"""JavaScript regular expressions as Java ones.

Rules and ticket patterns are written in JavaScript syntax. Spark runs Java
regexes, which read a few constructs differently: ``\\b`` and ``\\s`` cover other
characters, ``$`` also matches before a last line break, and ``[`` or ``&&``
inside a class mean set operations. Left alone, those differences let personal
data through.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_WORD = "A-Za-z0-9_"
_BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_NO_BOUNDARY = f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))"
# Java's own \s is [ \t\n\x0B\f\r]; JavaScript adds these.
_EXTRA_SPACE = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_DOT = r"[^\n\r\u2028\u2029]"

_OUTSIDE_CLASS = {
    r"\B": _NO_BOUNDARY,
    r"\s": rf"[\s{_EXTRA_SPACE}]",
    r"\S": rf"[^\s{_EXTRA_SPACE}]",
    r"\0": r"\x00",
    r"[^]": r"[\s\S]",
    r"[]": r"(?!)",
}
_INSIDE_CLASS = {
    r"\b": r"\x08",
    r"\s": rf"\s{_EXTRA_SPACE}",
    r"\S": rf"[^\s{_EXTRA_SPACE}]",
    r"\0": r"\x00",
    "[": r"\[",
    "&": r"\&",
}
_TOKEN = re.compile(r"\\.|\[\^?\]|\[(?:\\.|[^\]\\])+\]|\{\d+(?:,\d*)?\}|.", re.DOTALL)
_CLASS_TOKEN = re.compile(r"\\.|.", re.DOTALL)
_LEADING_FLAGS = re.compile(r"^\(\?([imsxu]+)\)")
# Atoms that match word characters only, and quantifiers that allow no match.
_WORD_ATOM = re.compile(r"\w|\\[dw]|\[(?:0-9|A-Z|a-z|A-F|a-f|\\[dw]|\w(?!-))+\]", re.ASCII)
_REPEAT = re.compile(r"\+|\{[1-9]\d*(?:,\d*)?\}")
_OPTIONAL = re.compile(r"[*?]|\{0")


def to_java(pattern: str, flags: str = "") -> str:
    """Translate ``pattern``; a leading ``(?i)``-style group counts as flags."""
    leading = _LEADING_FLAGS.match(pattern)
    if leading:
        flags += leading.group(1)
        pattern = pattern[leading.end() :]
    tokens = _TOKEN.findall(pattern)
    out: list[str] = []
    for i, token in enumerate(tokens):
        if token == r"\b":
            out.append(_boundary(tokens[:i], tokens[i + 1 :]))
        elif token == "$" and "m" not in flags:
            out.append(r"\z")
        elif token == "." and "s" not in flags:
            out.append(_DOT)
        elif token in _OUTSIDE_CLASS:
            out.append(_OUTSIDE_CLASS[token])
        elif len(token) > 2 and token[0] == "[":
            inside = _CLASS_TOKEN.findall(token[1:-1])
            out.append("[" + "".join(_INSIDE_CLASS.get(t, t) for t in inside) + "]")
        else:
            out.append(token)
    kept = "".join(f for f in "ims" if f in flags)
    if kept and not pattern.isascii():
        kept += "u"
    return (f"(?{kept})" if kept else "") + "".join(out)


def _boundary(before: list[str], after: list[str]) -> str:
    """An ASCII ``\\b``; one look-around is enough where a word character must touch it."""
    if after and _WORD_ATOM.fullmatch(after[0]):
        if len(after) == 1 or not _OPTIONAL.match(after[1]):
            return f"(?<![{_WORD}])"
    if before and _REPEAT.fullmatch(before[-1]):
        before = before[:-1]
    if before and _WORD_ATOM.fullmatch(before[-1]):
        return f"(?![{_WORD}])"
    return _BOUNDARY


def to_java_replacement(replacement: str) -> str:
    """Translate a JavaScript replacement string (``$1``, ``$$``, ``$&``, ``$<n>``)."""

    def convert(match: re.Match) -> str:
        token = match.group()
        if token == "\\":
            return r"\\"
        if token == "$$":
            return r"\$"
        if token == "$&":
            return "$0"
        if token.startswith("$<"):
            return "${" + token[2:-1] + "}"
        if token in ("$`", "$'"):
            raise ValueError(f"replacement {replacement!r}: {token} is not supported")
        return token if len(token) > 1 else r"\$"

    return re.sub(r"\\|\$\$|\$&|\$`|\$'|\$<\w+>|\$\d{1,2}|\$", convert, replacement)


def check_pattern(spark: SparkSession, pattern: str, what: str = "pattern") -> None:
    """Raise ``ValueError`` now, on the driver, when Java rejects ``pattern``."""
    probe = spark.range(1).select(F.regexp_replace(F.lit("x"), F.lit(pattern), F.lit("")))
    try:
        probe.collect()
    except Exception as exc:
        raise ValueError(f"invalid {what}: {pattern!r}") from exc
