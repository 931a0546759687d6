"""Redaction as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.functions.regex import check_pattern, to_java, to_java_replacement
from logclew.schema import RedactionRule

# Rule names, patterns and replacements, applied in this order.
# (Each hint is ours: what a text must contain before the rule can match.)
DEFAULT_RULES: tuple[RedactionRule, ...] = (
    RedactionRule(
        name="email",
        pattern=r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        replacement="[REDACTED:email]",
        hint=r"@",
    ),
    RedactionRule(
        name="jwt",
        pattern=r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
        replacement="[REDACTED:jwt]",
        hint=r"eyJ",
    ),
    RedactionRule(
        name="authorization-header",
        pattern=r"(?i)Authorization:\s*(?:Bearer|Basic|ApiKey)\s+\S+",
        replacement="Authorization: [REDACTED]",
        hint=r"(?i)authorization:",
    ),
    RedactionRule(
        name="guid-in-auth-context",
        pattern=(
            r"(?i)(token|secret|apikey|api_key|sessionid|session_id|cookie|auth)\s*[=:]\s*"
            r"""["']?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}["']?"""
        ),
        replacement="$1=[REDACTED:guid]",
        hint=r"[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-",
    ),
    RedactionRule(
        name="ipv4-private-rfc1918-10",
        pattern=r"\b10\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}\b",
        replacement="[REDACTED:ipv4]",
        hint=r"[0-9]\.[0-9]{1,3}\.[0-9]",
    ),
    RedactionRule(
        name="ipv4-private-rfc1918-192-168",
        pattern=r"\b192\.168\.[0-9]{1,3}\.[0-9]{1,3}\b",
        replacement="[REDACTED:ipv4]",
        hint=r"[0-9]\.[0-9]{1,3}\.[0-9]",
    ),
    RedactionRule(
        name="ipv4-private-rfc1918-172",
        pattern=r"\b172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}\b",
        replacement="[REDACTED:ipv4]",
        hint=r"[0-9]\.[0-9]{1,3}\.[0-9]",
    ),
    RedactionRule(
        name="ipv4-public",
        pattern=(
            r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
            r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
        ),
        replacement="[REDACTED:ipv4]",
        hint=r"[0-9]\.[0-9]{1,3}\.[0-9]",
    ),
    RedactionRule(
        name="ipv6",
        pattern=r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
        replacement="[REDACTED:ipv6]",
        hint=r":[0-9a-fA-F]{1,4}:[0-9a-fA-F]{1,4}:",
    ),
    RedactionRule(
        name="internal-hostname-suffix",
        pattern=r"\b[a-z0-9-]+\.(?:internal|corp|local)\b",
        flags="gi",
        replacement="[REDACTED:hostname]",
        hint=r"(?i)\.(?:internal|corp|local)",
    ),
)


def rules_with(extra: Sequence[RedactionRule] = ()) -> tuple[RedactionRule, ...]:
    """The default rules followed by the caller's own."""
    return DEFAULT_RULES + tuple(extra)


def check_rules(spark, rules: Sequence[RedactionRule]) -> None:
    """Raise ``ValueError`` for a pattern of the caller's that Java rejects."""
    for rule in rules:
        if rule not in DEFAULT_RULES:
            check_pattern(spark, to_java(rule.pattern, rule.flags), f"redaction rule {rule.name}")


def apply_rule(text: Column, rule: RedactionRule) -> Column:
    return F.regexp_replace(
        text, F.lit(to_java(rule.pattern, rule.flags)), F.lit(to_java_replacement(rule.replacement))
    )


def _maybe(text: Column, hint: str) -> Column:
    plain = hint.isalnum() or hint == "@"
    return text.contains(hint) if plain else text.rlike(hint)


def suspicious(text: Column, rules: Sequence[RedactionRule]) -> Column:
    """False only where no rule can change the text."""
    hints = dict.fromkeys(rule.hint for rule in rules)
    if None in hints:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [_maybe(text, hint) for hint in hints])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Written out, a chain of such uses would grow exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _apply_block(hint: str | None, rules: Sequence[RedactionRule]):
    """Rules that share a hint, skipped for a text without it."""

    def apply(text: Column) -> Column:
        redacted = reduce(apply_rule, rules, text)
        return redacted if hint is None else F.when(_maybe(text, hint), redacted).otherwise(text)

    return apply


def redact_text(text: Column, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> Column:
    """All rules in sequence; each one sees what the earlier ones left.

    A rule's hint is far cheaper than its pattern, so rules run behind their hints.
    """
    for hint, block in groupby(rules, key=lambda rule: rule.hint):
        text = _let(text, _apply_block(hint, list(block)))
    return text


# A JSON text as keys (with their colon), string values, and all between.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JSON_PIECES = rf'{_JSON_STRING}\s*+:|{_JSON_STRING}|[^"]++'


def redact_json(text: Column, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> Column:
    """Redact each string value of a JSON text; keys and numbers stay.

    A rule never sees the quotes around a value, so a greedy one cannot eat them.
    """

    def quoted(clean: Column) -> Column:
        return _let(
            F.to_json(F.array(clean)), lambda boxed: F.substring(boxed, F.lit(2), F.length(boxed) - 2)
        )

    def piece(p: Column) -> Column:
        def changed_or_as_is(value: Column) -> Column:
            return _let(
                redact_text(value, rules), lambda clean: F.when(clean != value, quoted(clean)).otherwise(p)
            )

        value = F.get_json_object(F.concat(F.lit("["), p, F.lit("]")), "$[0]")
        is_value = p.startswith('"') & p.endswith('"')
        return F.when(is_value, _let(value, changed_or_as_is)).otherwise(p)

    pieces = F.regexp_extract_all(text, F.lit(_JSON_PIECES), F.lit(0))
    rebuilt = F.array_join(F.transform(pieces, piece), "")
    # An escape such as \\u0040 hides what a hint looks for.
    maybe = suspicious(text, rules) | text.contains("\\")
    return F.when(maybe, rebuilt).otherwise(text)


def redact_raw(
    raw: Column, kind: Column, rules: Sequence[RedactionRule] = DEFAULT_RULES
) -> Column:
    """Redact a raw record held as a map of texts and a map of their kinds."""

    def leaf(key: Column, value: Column) -> Column:
        composite = kind[key].isin("object", "array")
        return (
            F.when(kind[key] == "string", redact_text(value, rules))
            .when(composite, redact_json(value, rules))
            .otherwise(value)
        )

    return F.transform_values(raw, leaf)


def redact_nested(
    value: Column, dtype: T.DataType, rules: Sequence[RedactionRule] = DEFAULT_RULES
) -> Column:
    """Redact every string inside a typed struct, array or map column."""
    if isinstance(dtype, T.StringType):
        return redact_text(value, rules)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: redact_nested(v, dtype.elementType, rules))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda k, v: redact_nested(v, dtype.valueType, rules))
    if isinstance(dtype, T.StructType):
        fields = [
            redact_nested(value[f.name], f.dataType, rules).alias(f.name) for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_columns(
    df: DataFrame, columns: Sequence[str], rules: Sequence[RedactionRule] = DEFAULT_RULES
) -> DataFrame:
    """Redact top-level columns of any type, by the schema."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: redact_nested(F.col(c), types[c], rules) for c in columns})
