"""All findings tables from logs, commits and notes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclew.operators import findings as fnd
from logclew.operators import links, report
from logclew.operators.keys import MATCHED, matched, row_keys, unmatched
from logclew.schema import ATOMS, BULLETS, PREVIEW_ROWS, JoinPolicy
from logclew.session import is_staged, prepare, stage

TABLES = (
    "summary",
    "bullets",
    "groups",
    "group_rows",
    "unmatched",
    "group_tickets",
    "group_commits",
    "group_atoms",
    "evidence",
)
_KEYS = ("row_ord", "timestamp", "time_known", "level", "op_id", "tickets", "service", "group_key")
_ROW = ("row_ord", "timestamp", "level", "message", "source", "raw", "raw_kind")


@dataclass(frozen=True)
class Findings:
    """The findings tables, tied together by ``group_key``.

    Each is built when first asked for. What later steps read more than once,
    the distinct (group, key) pairs and the links, is staged in the shared
    folder at that point, so the log itself is not scanned again for it.
    ``logs`` are the log rows, ``keyed`` these with their keys; ``keys`` is the narrow part of
    them that groups and links need.
    """

    logs: DataFrame
    keyed: DataFrame
    keys: DataFrame
    commits: DataFrame
    atoms: DataFrame
    policy: JoinPolicy
    staged: bool = False

    @property
    def _token_regex(self) -> str | None:
        return self.policy.ticket_regex if self.policy.ticket_match == "token" else None

    @cached_property
    def stats(self) -> DataFrame:
        return fnd.group_stats(self.keys)

    @cached_property
    def summary(self) -> DataFrame:
        return fnd.summary(self.stats)

    @cached_property
    def groups(self) -> DataFrame:
        return fnd.groups(self.stats)

    @cached_property
    def rows(self) -> DataFrame:
        """Whole rows with their keys; of a staged run written once, matched rows apart from others."""
        return staged_rows(self.keyed) if self.staged and not is_staged(self.keyed) else self.keyed

    @cached_property
    def group_rows(self) -> DataFrame:
        return matched(self.rows).select("group_key", *_ROW)

    @cached_property
    def unmatched(self) -> DataFrame:
        return unmatched(self.rows).select(*_ROW)

    @cached_property
    def evidence(self) -> DataFrame:
        return fnd.evidence(self.rows)

    @cached_property
    def group_tickets(self) -> DataFrame:
        return stage(links.group_tickets(self.keys), "group-tickets")

    @cached_property
    def commit_links(self) -> DataFrame:
        found = links.group_commits(
            self.keys,
            self.group_tickets,
            self.commits,
            self.policy.window_minutes,
            self._token_regex,
        )
        return stage(links.packed(found, "commit_ord"), "group-commits")

    @cached_property
    def _ticket_commits(self) -> DataFrame:
        found = links.ticket_commits(self.group_tickets, self.commits, self._token_regex)
        return stage(found, "ticket-commits")

    @cached_property
    def _spans(self) -> DataFrame | None:
        window = self.policy.window_minutes
        return stage(links.merged_spans(self.keys, window), "spans") if window else None

    @cached_property
    def commit_counts(self) -> DataFrame:
        """``group_key, commit_count`` without the links themselves."""
        return self._commit_counts(self.keys, self.group_tickets, self._ticket_commits, self._spans)

    def _commit_counts(self, keys: DataFrame, tickets: DataFrame, *known: DataFrame | None) -> DataFrame:
        return links.commit_counts(
            keys, tickets, self.commits, self.policy.window_minutes, self._token_regex, *known
        )

    @cached_property
    def atom_links(self) -> DataFrame:
        return stage(links.packed(self._atom_links, "atom_ord"), "group-atoms")

    @cached_property
    def _group_keys(self) -> DataFrame:
        return stage(links.group_match_keys(self.keys), "group-keys")

    @cached_property
    def _atom_keys(self) -> DataFrame:
        keys = stage(self._group_keys.select("key").distinct(), "match-keys")
        return stage(links.atom_keys(keys, self.atoms), "atom-keys")

    @cached_property
    def _atom_links(self) -> DataFrame:
        return links.group_atoms(self._group_keys, self.atoms, self._atom_keys)

    @cached_property
    def group_commits(self) -> DataFrame:
        return self.commit_rows(self.commits).select("commit_ord", "group_key", *report.COMMIT_DETAILS)

    @cached_property
    def group_atoms(self) -> DataFrame:
        return self.atom_rows(self.atoms).select("atom_ord", "group_key", *report.ATOM_DETAILS)

    def commit_rows(self, commits: DataFrame, group: Column | None = None) -> DataFrame:
        """Details of the commits of each group. ``commits`` may have other texts than those they are linked by."""
        details = commits.select("commit_ord", *report.COMMIT_DETAILS)
        tickets, window = self.group_tickets, self.policy.window_minutes
        return links.commit_rows(
            self.keys, tickets, self._ticket_commits, details, window, self._spans, group
        )

    def atom_rows(self, atoms: DataFrame, group: Column | None = None) -> DataFrame:
        details = atoms.select("atom_ord", *report.ATOM_DETAILS)
        return links.atom_rows(self._group_keys, self._atom_keys, details, group)

    @cached_property
    def bullets(self) -> DataFrame:
        return self.first_bullets(BULLETS)

    def first_bullets(self, n: int) -> DataFrame:
        """Of the first ``n`` groups; everything is worked out for those groups only."""
        rows = stage(fnd.of_groups(self.keys, fnd.first_keys(self.keys, n)), "first-rows")
        top = fnd.groups(fnd.group_stats(rows))
        tickets = stage(links.group_tickets(rows), "first-tickets")
        return fnd.bullets(top, tickets, self._commit_counts(rows, tickets))

    @cached_property
    def _report(self) -> DataFrame:
        # Only counted, and so neither staged nor shuffled, unless they have been staged.
        atoms = vars(self).get("atom_links")
        if atoms is None:
            atoms = links.atom_rows(self._group_keys, self._atom_keys)
        return report.group_report(self.groups, self.group_tickets, self.commit_counts, atoms)

    def _preview(self, rows: int = PREVIEW_ROWS) -> DataFrame:
        return report.raw_preview(self.keys, self.logs, rows)

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return getattr(self, name)


def staged_rows(keyed: DataFrame) -> DataFrame:
    """Whole keyed rows, written once; a filter on the key reads one of two folders."""
    has_key = F.col("group_key").isNotNull()
    return stage(keyed.withColumn(MATCHED, has_key), "keyed-rows", (MATCHED,))


def correlate(
    logs: DataFrame,
    commits: DataFrame,
    policy: JoinPolicy,
    atoms: DataFrame | None = None,
    services: DataFrame | None = None,
    staged: bool = False,
    whole: bool = False,
    extra_formats: tuple[str, ...] = (),
) -> Findings:
    """Group rows by explicit keys and link the groups.

    With ``staged`` the keys of all rows, without the rows themselves, are written
    once to the shared folder; use it when several of the tables will be computed. With
    ``whole`` the rows are written with their keys, and nothing reads ``logs`` again.
    ``extra_formats`` are the time formats the rows were read with.
    """
    spark = prepare(logs.sparkSession)
    keyed = row_keys(logs, policy, services, extra_formats)
    if whole:
        keyed = staged_rows(keyed)
        logs = keyed.select(*_ROW)
    keys = keyed.select(*_KEYS)
    if staged and not whole:
        keys = stage(keys, "keys")
    if atoms is None:
        atoms = spark.createDataFrame([], ATOMS)
    return Findings(logs, keyed, keys, commits, atoms, policy, staged or whole)
