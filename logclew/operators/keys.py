"""Explicit correlation keys of a log row, and the one group it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclew.functions.rawmap import string_value
from logclew.functions.regex import check_pattern, to_java
from logclew.operators.normalize import time_known
from logclew.schema import JoinPolicy
from logclew.session import stage

# Built-in operation id fields, in order, and where tickets are
# looked for besides the message.
OPERATION_ID_FIELDS = ("operation_Id", "operationId", "operation_id")
TICKET_FIELD = "operationName"

_UNIT = "\u001f"

# Of written rows: whether they have a key.
MATCHED = "has_key"


def operation_id(raw: Column, kind: Column, field: str) -> Column:
    """First non-empty string among the configured and the built-in fields."""
    fields = dict.fromkeys((field, *OPERATION_ID_FIELDS))
    return F.coalesce(*[F.when((kind[f] == "string") & (raw[f] != ""), raw[f]) for f in fields])


def ticket_mentions(text: Column, regex: str | None) -> Column:
    """Distinct non-empty matches, first seen first."""
    if not regex:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(to_java(regex)), F.lit(0))
    return F.array_distinct(F.array_remove(found, ""))


def row_tickets(message: Column, raw: Column, kind: Column, regex: str | None) -> Column:
    in_message = ticket_mentions(message, regex)
    if not regex:
        return in_message
    in_field = ticket_mentions(string_value(raw, kind, TICKET_FIELD), regex)
    return F.array_distinct(F.concat(in_message, in_field))


def service_of(source: Column, allowlist: tuple[str, ...]) -> Column:
    """First listed service that is the source or a dotted prefix of it."""
    if not allowlist:
        return F.lit(None).cast("string")
    return F.coalesce(
        *[F.when((source == a) | source.startswith(f"{a}."), F.lit(a)) for a in allowlist]
    )


def service_table_lookup(logs: DataFrame, services: DataFrame) -> DataFrame:
    """``logs`` with ``service`` from a table ``(service, allow_ord)`` of any size.

    The prefix test becomes an equality join by listing each distinct source
    together with its dotted prefixes. Only distinct sources take part, so a
    source that fills a third of the log is one row here. Going back to the log
    rows, the staged result is broadcast if its files are small; if they are not,
    adaptive execution splits a hot source.
    """
    sources = logs.select("source").distinct()
    parts = F.split("source", r"\.")
    prefixes = sources.select(
        "source",
        F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"),
    ).select(
        "source",
        F.call_function("substring_index", "source", F.lit("."), F.col("depth")).alias("service"),
    )
    matches = (
        prefixes.join(services, "service")
        .groupBy("source")
        .agg(F.min_by("service", "allow_ord").alias("service"))
    )
    return logs.join(stage(matches, "service-matches"), "source", "left")


def group_key(op_id: Column, tickets: Column, service: Column) -> Column:
    """Operation id before tickets before service; NULL without any key.

    Tickets are joined with commas; a comma (or percent sign) inside one is
    percent-encoded, so two different ticket sets never share a group.
    """
    joined = F.array_join(tickets, _UNIT)
    for plain, safe in (("%", "%25"), (",", "%2C"), (_UNIT, ",")):
        joined = F.replace(joined, F.lit(plain), F.lit(safe))
    return (
        F.when(op_id.isNotNull(), F.concat(F.lit("op:"), op_id))
        .when(F.size(tickets) > 0, F.concat(F.lit("tickets:"), joined))
        .when(service.isNotNull(), F.concat(F.lit("service:"), service))
    )


def group_label(key: Column) -> Column:
    """Label of a group; a function of its key, so it is never shuffled."""
    tickets = F.substring(key, F.lit(9), F.length(key))
    for safe, plain in ((",", ", "), ("%2C", ","), ("%25", "%")):
        tickets = F.replace(tickets, F.lit(safe), F.lit(plain))
    return (
        F.when(
            key.startswith("op:"),
            F.concat(F.lit("operationId="), F.substring(key, F.lit(4), F.length(key))),
        )
        .when(key.startswith("tickets:"), F.concat(F.lit("tickets "), tickets))
        .when(
            key.startswith("service:"),
            F.concat(F.lit("service "), F.substring(key, F.lit(9), F.length(key))),
        )
    )


def row_keys(
    logs: DataFrame,
    policy: JoinPolicy,
    services: DataFrame | None = None,
    extra_formats: tuple[str, ...] = (),
) -> DataFrame:
    """Log rows with ``time_known, op_id, tickets, service, group_key``.

    ``services`` is an allowlist held as a table, for one too long for
    ``policy.service_allowlist``. ``extra_formats`` are the time formats the rows were read
    with. Tickets are sorted where they form the group
    and in order of mention where an operation id does.

    The group key leaves through a one-element ``explode``, past which Catalyst
    does not push filters; otherwise a filter on it would compute all keys twice.
    """
    if policy.ticket_regex:
        check_pattern(logs.sparkSession, to_java(policy.ticket_regex), "ticket_regex")
    raw, kind = F.col("raw"), F.col("raw_kind")
    tickets = row_tickets(F.col("message"), raw, kind, policy.ticket_regex)
    if services is not None:
        logs = service_table_lookup(logs, services)
        service = F.col("service")
    else:
        service = service_of(F.col("source"), policy.service_allowlist)
    found = logs.withColumns(
        {
            "time_known": time_known(F.col("timestamp"), raw, extra_formats),
            "op_id": operation_id(raw, kind, policy.operation_id_field),
            "tickets": tickets,
            "service": service,
        }
    )
    ordered = F.when(F.col("op_id").isNull(), F.sort_array("tickets")).otherwise(F.col("tickets"))
    key = group_key(F.col("op_id"), F.col("tickets"), F.col("service"))
    return found.withColumn("tickets", ordered).select(
        "*", F.explode_outer(F.array(key)).alias("group_key")
    )


def matched(keyed: DataFrame) -> DataFrame:
    """Rows with a key. Written rows lie in a folder of their own (``MATCHED``)."""
    return keyed.where(MATCHED if MATCHED in keyed.columns else F.col("group_key").isNotNull())


def unmatched(keyed: DataFrame) -> DataFrame:
    return keyed.where(~F.col(MATCHED) if MATCHED in keyed.columns else F.col("group_key").isNull())
