"""Finding groups, evidence and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logclew.functions.rawmap import string_value
from logclew.functions.timestamps import iso_text
from logclew.operators.keys import OPERATION_ID_FIELDS, group_label

NO_KEY_WARNING = (
    "no explicit join keys matched: operation id, ticket pattern and service allowlist"
)


# First rows are looked for in so many buckets of groups.
_BUCKETS = 4_096


def severity_rank(level: Column) -> Column:
    """2 for error, 1 for warn, 0 for the rest."""
    lowered = F.lower(level)
    error = lowered.contains("critical") | lowered.contains("fatal") | lowered.contains("err")
    return F.when(error, 2).when(lowered.contains("warn"), 1).otherwise(0)


def group_stats(keyed: DataFrame) -> DataFrame:
    """One row per group, and one with a NULL key for the unmatched rows.

    The single aggregate behind groups, summary and counts. Counts, minimum and
    maximum are numbers, so it hashes and a hot group shrinks to one row per
    task before the shuffle.
    """
    return keyed.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("group_key").alias("matched_count"),
        F.min("row_ord").alias("first_ord"),
        F.max(severity_rank(F.col("level"))).alias("rank"),
    )


def groups(stats: DataFrame) -> DataFrame:
    """``group_key, label, row_count, first_ord``; ``first_ord`` orders the groups.

    The filter reads a count, not the key: on the key, Catalyst would push it
    below the aggregate and compute every row's key twice.
    """
    return stats.where(F.col("matched_count") > 0).select(
        "group_key", group_label(F.col("group_key")).alias("label"), "row_count", "first_ord"
    )


def evidence(keyed: DataFrame) -> DataFrame:
    """One row per log row and key: what ties the row to its group. No shuffle."""
    built_in = F.coalesce(
        *[string_value(F.col("raw"), F.col("raw_kind"), f) for f in OPERATION_ID_FIELDS],
        F.lit("-"),
    )
    row_id = F.concat(
        iso_text(F.col("timestamp")),
        F.lit("|"),
        F.col("source"),
        F.lit("|"),
        built_in,
        F.lit("/row-"),
        F.col("row_ord").cast("string"),
    )
    n_tickets = F.size("tickets")
    refs = F.concat(F.array("op_id"), F.col("tickets"), F.array("service"))
    kind = (
        F.when(F.col("pos") == 0, "operationId")
        .when(F.col("pos") <= F.col("n_tickets"), "ticket")
        .otherwise("service")
    )
    return (
        keyed.select(
            "group_key",
            "row_ord",
            row_id.alias("log_row_id"),
            n_tickets.alias("n_tickets"),
            F.posexplode(refs).alias("pos", "evidence_ref"),
        )
        .where(F.col("evidence_ref").isNotNull())
        .select("group_key", "row_ord", "log_row_id", kind.alias("evidence_type"), "evidence_ref")
    )


def summary(stats: DataFrame) -> DataFrame:
    """One row: headline, severity, counts, and the warning when no key matched."""
    totals = stats.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count("group_key").alias("group_count"),
        F.coalesce(F.sum(F.col("row_count") - F.col("matched_count")), F.lit(0))
        .cast("bigint")
        .alias("unmatched_count"),
        F.max("rank").alias("rank"),
    )
    severity = F.when(F.col("rank") == 2, "error").when(F.col("rank") == 1, "warn").otherwise("info")
    headline = F.format_string(
        "[%s] %d row(s) correlated into %d finding group(s)",
        F.upper(severity),
        F.col("row_count"),
        F.col("group_count"),
    )
    no_key = (F.col("group_count") == 0) & (F.col("row_count") > 0)
    return totals.select(
        headline.alias("headline"),
        severity.alias("severity"),
        "row_count",
        "group_count",
        "unmatched_count",
        F.when(no_key, NO_KEY_WARNING).alias("warning"),
    )


def findings_counts(stats: DataFrame) -> DataFrame:
    return summary(stats).select("group_count", "unmatched_count", "warning")


def first_keys(keys: DataFrame, n: int) -> DataFrame:
    """``group_key, first_ord`` of the ``n`` groups that appear first; at most ``n`` rows.

    Not by way of all groups: each task keeps the first row of each of ``_BUCKETS`` buckets of keys.
    These are first rows of different groups, so the nth of them comes no earlier than the nth
    group does, and the rows up to it have all the groups asked for.
    """
    rows = keys.where(F.col("group_key").isNotNull()).select("group_key", "row_ord")
    firsts = rows.groupBy(F.pmod(F.xxhash64("group_key"), F.lit(_BUCKETS)).alias("bucket")).agg(
        F.min("row_ord").alias("first_ord")
    )
    leading = firsts.orderBy("first_ord").limit(n)
    last = leading.agg(F.when(F.count(F.lit(1)) == n, F.max("first_ord"))).scalar()
    early = rows.where(F.col("row_ord") <= F.coalesce(last, F.lit((1 << 63) - 1)))
    found = early.groupBy("group_key").agg(F.min("row_ord").alias("first_ord"))
    return found.orderBy("first_ord").limit(n)


def first_tickets(tickets: DataFrame, n: int) -> DataFrame:
    """``group_key, ticket_count, tickets``: count and the first ``n``, in order of mention."""
    order = Window.partitionBy("group_key").orderBy("first_ord", "first_pos")
    leading = (
        tickets.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= n)
        .groupBy("group_key")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "ticket"))).alias("leading"))
    )
    counts = tickets.groupBy("group_key").agg(F.count(F.lit(1)).alias("ticket_count"))
    return counts.join(leading, "group_key").select(
        "group_key",
        "ticket_count",
        F.array_join(F.transform("leading", lambda t: t["ticket"]), ", ").alias("tickets"),
    )


def bullets(top: DataFrame, tickets: DataFrame, commit_counts: DataFrame) -> DataFrame:
    """``bullet_no, text`` for the first groups, with their tickets and numbers of commits."""
    noted = (
        top.join(commit_counts, "group_key", "left")
        .join(first_tickets(tickets, 3), "group_key", "left")
        .withColumn(
            "bullet_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_ord"))
        )
    )
    text = F.concat(
        "label",
        F.format_string(": %d row(s)", "row_count"),
        F.when(
            F.col("commit_count") > 0, F.format_string(" — %d commit(s)", "commit_count")
        ).otherwise(""),
        F.coalesce(F.concat(F.lit(" — tickets: "), F.col("tickets")), F.lit("")),
    )
    return noted.select("bullet_no", text.alias("text"))


def of_groups(keyed: DataFrame, top: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that belong to the few groups of ``top``."""
    return keyed.join(F.broadcast(top.select("group_key")), "group_key", "left_semi")
