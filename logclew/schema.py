"""Table schemas and the parameter objects of the library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType())

LOGS = T.StructType(
    [
        T.StructField("row_ord", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("raw", _MAP),
        T.StructField("raw_kind", _MAP),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("commit_ord", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("short_sha", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("authored_at", T.TimestampType()),
        T.StructField("subject", T.StringType()),
    ]
)

ATOMS = T.StructType(
    [
        T.StructField("atom_ord", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("message", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

# Field name, window, and lengths of the two top-k reports.
DEFAULT_OPERATION_ID_FIELD = "operation_Id"
DEFAULT_WINDOW_MINUTES = 10
PREVIEW_ROWS = 50
BULLETS = 10


@dataclass(frozen=True)
class JoinPolicy:
    """Which explicit keys tie log rows together and to commits and notes."""

    ticket_regex: str | None = None
    service_allowlist: tuple[str, ...] = ()
    operation_id_field: str = DEFAULT_OPERATION_ID_FIELD
    window_minutes: int = DEFAULT_WINDOW_MINUTES
    # How a commit subject names a ticket: it contains the id anywhere, or one of the
    # ticket pattern's matches in it is the id.
    ticket_match: str = "substring"

    def __post_init__(self) -> None:
        if self.ticket_match not in ("substring", "token"):
            raise ValueError("ticket_match must be substring or token")
        if self.ticket_match == "token" and not self.ticket_regex:
            raise ValueError("ticket_match token needs a ticket_regex")
        object.__setattr__(self, "service_allowlist", tuple(self.service_allowlist))
        if int(self.window_minutes) != self.window_minutes or self.window_minutes < 0:
            raise ValueError("window_minutes must be a whole number of minutes, 0 or more")


@dataclass(frozen=True)
class RedactionRule:
    """One replacement; ``pattern`` and ``replacement`` use JavaScript syntax.

    ``hint`` is an optional regex that every text the rule can change must
    match; it lets clean texts skip the rule. No hint means no skipping.
    """

    name: str
    pattern: str
    flags: str = ""
    replacement: str = "[REDACTED]"
    hint: str | None = None
