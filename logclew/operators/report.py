"""Report tables: linked tickets, one line per group, link details, row preview."""

from __future__ import annotations

from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclew.operators.findings import first_keys
from logclew.schema import PREVIEW_ROWS

# What a report says of a commit and of a note.
COMMIT_DETAILS = ("sha", "short_sha", "author", "authored_at", "subject")
ATOM_DETAILS = ("id", "ts", "message")

# Characters Spark's url_encode escapes and a URL path keeps.
_KEPT = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def check_link_base(base: str) -> tuple[str, str]:
    """What goes before and after a ticket id in a link; https only."""
    url = urlsplit(base)
    if url.scheme.lower() != "https" or not url.netloc:
        raise ValueError(f"ticket links need an https URL, got {base!r}")
    path = url.path if url.path.endswith("/") else url.path + "/"
    head = urlunsplit((url.scheme.lower(), url.netloc.lower(), path, "", ""))
    return head, urlunsplit(("", "", "", url.query, url.fragment))


def ticket_link(ticket: Column, base: str) -> Column:
    head, tail = check_link_base(base)
    encoded = F.url_encode(ticket)
    for escaped, kept in _KEPT:
        encoded = F.replace(encoded, F.lit(escaped), F.lit(kept))
    return F.concat(F.lit(head), encoded, F.lit(tail))


def linked_tickets(tickets: DataFrame, link_base: str | None = None) -> DataFrame:
    """``ticket, link``: distinct over all groups."""
    link = ticket_link(F.col("ticket"), link_base) if link_base else F.lit(None).cast("string")
    return tickets.select("ticket").distinct().withColumn("link", link)


def group_report(
    all_groups: DataFrame, tickets: DataFrame, commit_counts: DataFrame, atoms: DataFrame
) -> DataFrame:
    """One row per group: label, rows and numbers of links; the links are tables of their own.

    ``tickets`` and ``atoms`` are links, ``commit_counts`` is ``group_key, commit_count``.
    """

    def counted(links: DataFrame, name: str) -> DataFrame:
        return links.groupBy("group_key").agg(F.count(F.lit(1)).alias(name))

    report = (
        all_groups.join(commit_counts, "group_key", "left")
        .join(counted(atoms, "atom_count"), "group_key", "left")
        .join(counted(tickets, "ticket_count"), "group_key", "left")
    )
    counts = ("commit_count", "ticket_count", "atom_count")
    return report.select(
        "group_key",
        "label",
        "row_count",
        "first_ord",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
    )


def raw_preview(keys: DataFrame, logs: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a report: by group in order of appearance, then unmatched.

    Every group has a row, so the first ``rows`` rows lie in the first ``rows`` groups.
    Which rows they are is found from ``group_key, row_ord`` alone; at most ``rows`` rows of the log
    are then fetched by their number. Messages are whole and as they are; ``escape_cells`` makes
    them fit for a table.
    """
    top = F.broadcast(first_keys(keys, rows))
    is_other = F.col("group_key").isNull()
    shown = (
        keys.select("group_key", "row_ord")
        .join(top, "group_key", "left")
        .where(is_other | F.col("first_ord").isNotNull())
        .select(is_other.alias("part"), "first_ord", "row_ord")
        .orderBy("part", "first_ord", "row_ord")
        .limit(rows)
    )
    columns = ("row_ord", "timestamp", "level", "source", "message")
    found = logs.select(*columns).join(F.broadcast(shown), "row_ord")
    return found.select("part", "first_ord", *columns).orderBy("part", "first_ord", "row_ord").limit(rows)


def escape_cells(preview: DataFrame) -> DataFrame:
    """Bars in messages escaped; after redaction, whose rules should see the plain text."""
    return preview.withColumn("message", F.replace("message", F.lit("|"), F.lit("\\|")))
