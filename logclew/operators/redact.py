"""Redaction of findings tables and of text corpora."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclew.functions.redaction import (
    DEFAULT_RULES,
    apply_rule,
    redact_raw,
    redact_text,
)
from logclew.functions.regex import to_java
from logclew.schema import RedactionRule

# Text columns of each findings table that are always redacted, and those only
# the wider scope covers: links and evidence, which can hold personal data too.
ALWAYS = {
    "summary": ("headline",),
    "bullets": ("text",),
    "groups": ("label",),
    "group_rows": ("message",),
    "unmatched": ("message",),
    "group_report": ("label",),
    "raw_preview": ("message",),
    "linked_tickets": ("ticket",),
}
LINKED = {
    "group_tickets": ("ticket",),
    "group_commits": ("author", "subject"),
    "group_atoms": ("message",),
    "evidence": ("log_row_id", "evidence_ref"),
}
SCOPES = ("all", "reference")


def redact_rows(rows: DataFrame, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> DataFrame:
    """Message and raw record; timestamp, level and source stay as they are."""
    return rows.withColumns(
        {
            "message": redact_text(F.col("message"), rules),
            "raw": redact_raw(F.col("raw"), F.col("raw_kind"), rules),
        }
    )


def redact_table(
    name: str,
    table: DataFrame,
    rules: Sequence[RedactionRule] = DEFAULT_RULES,
    scope: str = "all",
) -> DataFrame:
    """Redact the findings table called ``name``.

    ``scope="reference"`` leaves links and evidence alone.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    columns = ALWAYS | (LINKED if scope == "all" else {})
    redacted = {c: redact_text(F.col(c), rules) for c in columns.get(name, ())}
    if name in ("group_rows", "unmatched"):
        redacted["raw"] = redact_raw(F.col("raw"), F.col("raw_kind"), rules)
    return table.withColumns(redacted)


def warn_bypass() -> None:
    warnings.warn(
        "redaction bypassed: the output may hold personal data, do not share it", stacklevel=3
    )


def redact_corpus(
    texts: DataFrame, text_col: str = "text", rules: Sequence[RedactionRule] = DEFAULT_RULES
) -> DataFrame:
    """``texts`` with ``redacted`` and whether that ``changed`` anything."""
    out = texts.withColumn("redacted", redact_text(F.col(text_col), rules))
    return out.withColumn("changed", F.col("redacted") != F.col(text_col))


def rule_hits(
    texts: DataFrame, text_col: str = "text", rules: Sequence[RedactionRule] = DEFAULT_RULES
) -> DataFrame:
    """``rule, hits, texts_hit`` over the corpus.

    A rule is counted on the text as the earlier rules left it. One pass: each
    step is its own projection, and the counts meet in a single aggregate.
    """

    def step(df: DataFrame, numbered: tuple[int, RedactionRule]) -> DataFrame:
        n, rule = numbered
        before = F.col(f"_t{n}")
        count = F.regexp_count(before, F.lit(to_java(rule.pattern, rule.flags)))
        after = apply_rule(before, rule)
        if rule.hint is not None:
            maybe = before.rlike(rule.hint)
            count = F.when(maybe, count).otherwise(0)
            after = F.when(maybe, after).otherwise(before)
        return df.withColumns({f"_n{n}": count, f"_t{n + 1}": after})

    start = texts.select(F.col(text_col).alias("_t0"))
    counted = reduce(step, enumerate(rules), start)
    sums = [F.coalesce(F.sum(f"_n{n}"), F.lit(0)).alias(f"_s{n}") for n in range(len(rules))]
    hits = [F.count_if(F.col(f"_n{n}") > 0).alias(f"_h{n}") for n in range(len(rules))]
    per_rule = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("rule_no"),
                    F.lit(rule.name).alias("rule"),
                    F.col(f"_s{n}").cast("bigint").alias("hits"),
                    F.col(f"_h{n}").alias("texts_hit"),
                )
                for n, rule in enumerate(rules)
            ]
        )
    )
    return counted.agg(*sums, *hits).select(per_rule)
