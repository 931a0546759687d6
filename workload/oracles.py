"""DuckDB SQL for each registered query, formulated on its own.

Joins are plain comparisons here (``contains``, ``abs(a - b) <= window``), so they
check the rewritten equality joins of the Spark side.
"""

from __future__ import annotations

from workload import views
from workload.queries import BUNDLE_TEXT, HOURS, LINK_BASE, RUN_SECRET

# Stated here on their own, so that a wrong table, rule or message of the library shows.
_TABLES = (
    "requests traces dependencies exceptions customEvents customMetrics pageViews browserTimings "
    "availabilityResults performanceCounters AzureDiagnostics AzureActivity AzureMetrics ContainerLogs "
    "ContainerLog ContainerLogV2 Heartbeat Syslog Event SecurityEvent Perf Update Operation AppExceptions "
    "AppRequests AppTraces AppDependencies AppEvents AppPageViews AppPerformanceCounters AppMetrics"
).split()
_BLANK_ERROR = "empty query text"
_NO_KEYS = "no explicit join keys matched: operation id, ticket pattern and service allowlist"

_FIELDS = ", ".join(f"{sql} AS f_{name}" for name, _, sql in views.LOG_FIELDS)
_COMMITS = ", ".join(f"{sql} AS {name}" for name, sql in views.COMMIT_COLUMNS)
_ATOMS = ", ".join(f"{sql} AS {name}" for name, sql in views.ATOM_COLUMNS)
_REGEX = views.TICKET_REGEX


def _level(value: str) -> str:
    return f"""CASE WHEN coalesce({value}, '') = '' THEN 'info'
        WHEN regexp_matches(lower({value}), 'crit|fatal|emerg') THEN 'critical'
        WHEN regexp_matches(lower({value}), 'err|severe') THEN 'error'
        WHEN regexp_matches(lower({value}), 'warn') THEN 'warn'
        WHEN regexp_matches(lower({value}), 'info|notice') THEN 'info'
        WHEN regexp_matches(lower({value}), 'debug|trace|verbose') THEN 'debug'
        WHEN {value} = '0' THEN 'info' WHEN {value} = '1' THEN 'warn'
        WHEN {value} = '2' THEN 'error' WHEN {value} = '3' THEN 'critical' ELSE {value} END"""


def _time(value: str) -> str:
    return f"""coalesce(date_trunc('milliseconds', try_cast({value} AS TIMESTAMP)),
        TIMESTAMP '1970-01-01 00:00:00')"""


_CTE = {
    "fields": f"SELECT event_id AS row_ord, ts, {_FIELDS} FROM events",
    "logs": f"""SELECT *, {_time('f_timestamp')} AS timestamp,
        {_level('coalesce(f_level, f_severityLevel)')} AS level, coalesce(f_message, '') AS message,
        coalesce(f_source, 'unknown') AS source FROM fields""",
    "commits": f"SELECT {_COMMITS} FROM events WHERE {views.COMMIT_ROWS}",
    "atoms": f"SELECT {_ATOMS} FROM events WHERE {views.ATOM_ROWS}",
    "found": f"""SELECT *, nullif(f_operation_Id, '') AS op_id,
        regexp_extract_all(message, '{_REGEX}')
        || regexp_extract_all(coalesce(f_operationName, ''), '{_REGEX}') AS mentions,
        CASE WHEN source = 'svc1' OR starts_with(source, 'svc1.') THEN 'svc1'
             WHEN source = 'svc3' OR starts_with(source, 'svc3.') THEN 'svc3' END AS service
        FROM logs""",
    "distinct_found": """SELECT *,
        list_filter(mentions, lambda x, i: list_position(mentions, x) = i) AS tickets0 FROM found""",
    "keyed": """SELECT *, CASE WHEN op_id IS NULL THEN list_sort(tickets0) ELSE tickets0 END AS tickets,
        CASE WHEN op_id IS NOT NULL THEN 'op:' || op_id
             WHEN len(tickets0) > 0 THEN 'tickets:' || array_to_string(list_sort(tickets0), ',')
             WHEN service IS NOT NULL THEN 'service:' || service END AS group_key,
        CASE WHEN op_id IS NOT NULL THEN 'operationId=' || op_id
             WHEN len(tickets0) > 0 THEN 'tickets ' || array_to_string(list_sort(tickets0), ', ')
             WHEN service IS NOT NULL THEN 'service ' || service END AS label
        FROM distinct_found""",
    "groups": """SELECT group_key, min(label) AS label, count(*) AS row_count, min(row_ord) AS first_ord
        FROM keyed WHERE group_key IS NOT NULL GROUP BY group_key""",
    "row_tickets": """SELECT group_key, row_ord, unnest(tickets) AS ticket,
        unnest(range(1, len(tickets) + 1)) AS pos FROM keyed WHERE group_key IS NOT NULL""",
    "group_tickets": """SELECT group_key, ticket, min(row_ord) AS first_ord,
        arg_min(pos, row_ord) AS first_pos FROM row_tickets GROUP BY group_key, ticket""",
    "ticket_commits": """SELECT t.ticket AS key, c.commit_ord
        FROM (SELECT DISTINCT ticket FROM group_tickets) t JOIN commits c
        ON contains(c.subject, t.ticket)""",
    "near_commits": f"""SELECT DISTINCT k.group_key, c.commit_ord FROM keyed k JOIN commits c
        ON c.authored_at BETWEEN k.timestamp - INTERVAL {views.WINDOW_MINUTES + 1} MINUTE
                             AND k.timestamp + INTERVAL {views.WINDOW_MINUTES + 1} MINUTE
        WHERE k.op_id IS NOT NULL AND try_cast(k.f_timestamp AS TIMESTAMP) IS NOT NULL
        AND abs(epoch_ms(c.authored_at) - epoch_ms(k.timestamp)) <= {views.WINDOW_MINUTES * 60_000}""",
    "group_commits": """SELECT g.group_key, t.commit_ord FROM group_tickets g
        JOIN ticket_commits t ON t.key = g.ticket UNION SELECT group_key, commit_ord FROM near_commits""",
    "group_keys": """SELECT DISTINCT group_key, key FROM (
        SELECT group_key, op_id AS key FROM keyed UNION ALL
        SELECT group_key, ticket FROM row_tickets UNION ALL
        SELECT group_key, service FROM keyed WHERE group_key IS NOT NULL) WHERE key IS NOT NULL""",
    "key_atoms": """SELECT k.key, a.atom_ord FROM (SELECT DISTINCT key FROM group_keys) k JOIN atoms a
        ON a.tag1 = k.key OR a.tag2 = k.key OR contains(a.message, k.key)""",
    "group_atoms": """SELECT DISTINCT g.group_key, a.atom_ord FROM group_keys g
        JOIN key_atoms a ON a.key = g.key""",
    "texts": f"SELECT event_id AS query_id, {views.QUERY_TEXT} AS text FROM events",
    # The view has at most one comment, at the start, and one string without escapes.
    "uncommented": """SELECT query_id, text, CASE WHEN starts_with(text, '//')
        THEN ' ' || substr(text, strpos(text, chr(10)))
        ELSE ' ' || substr(text, strpos(text, '*/') + 2) END AS u FROM texts""",
    "scrubbed": """SELECT query_id, text, split_part(u, '"', 1) || CASE WHEN contains(u, '"')
        THEN '""' || split_part(u, '"', 3) ELSE '' END AS s FROM uncommented""",
    "parsed": rf"""SELECT *, list_filter(regexp_extract_all(s, '\b[A-Za-z][A-Za-z0-9_]*\b'),
            lambda t: list_contains({_TABLES}, t)
                      OR regexp_full_match(t, '[A-Za-z][A-Za-z0-9_]*_CL')) AS tables0,
        list_filter(list_transform(flatten(list_transform(list_filter(string_split(s, '|')[2:],
            lambda st: starts_with(lower(trim(st)), 'project ')),
            lambda st: string_split(substr(trim(split_part(st, ';', 1)), 9), ','))),
            lambda p: trim(split_part(p, '=', 1))),
            lambda p: p <> '') AS projections0,
        regexp_extract_all(text, '{_REGEX}') AS tickets0,
        rtrim(split_part(split_part(s, 'ago(', 2), ')', 1), 'dhms') AS qty,
        ltrim(split_part(split_part(s, 'ago(', 2), ')', 1), '0123456789.') AS unit,
        split_part(split_part(split_part(s, 'between(datetime(', 2), '..', 1), ')', 1) AS b1,
        split_part(split_part(split_part(s, 'between(datetime(', 2), '.. datetime(', 2), ')', 1) AS b2
        FROM scrubbed""",
    "ranges": f"""SELECT query_id, try_cast(qty AS DOUBLE) * CASE unit WHEN 'd' THEN 86400000
            WHEN 'h' THEN 3600000 WHEN 'm' THEN 60000 WHEN 's' THEN 1000 WHEN 'ms' THEN 1 END AS back,
        try_cast(b1 AS TIMESTAMP) AS b_from, try_cast(b2 AS TIMESTAMP) AS b_to,
        TIMESTAMP '{views.AS_OF}' AS now FROM parsed""",
    "facts": """SELECT p.query_id, p.text, p.tickets0, p.projections0, p.tables0,
        CASE WHEN back > 0 THEN make_timestamp(CAST(floor(epoch_ms(now) - back) AS BIGINT) * 1000)
             WHEN b_to IS NOT NULL THEN b_from END AS range_from,
        CASE WHEN back > 0 THEN now WHEN b_from IS NOT NULL THEN b_to END AS range_to
        FROM parsed p JOIN ranges r ON p.query_id = r.query_id""",
    "recent": f"SELECT * FROM commits WHERE authored_at <= TIMESTAMP '{views.AS_OF}'",
    "poisoned": f"SELECT doc_id, {views.POISONED_TEXT} AS text FROM documents",
    "glued": f"SELECT doc_id, {views.GLUED_TEXT} AS text FROM documents",
}

_NEEDS = {
    "logs": ["fields"], "found": ["logs"], "distinct_found": ["found"], "keyed": ["distinct_found"],
    "groups": ["keyed"], "row_tickets": ["keyed"], "group_tickets": ["row_tickets"],
    "ticket_commits": ["group_tickets", "commits"], "near_commits": ["keyed", "commits"],
    "group_commits": ["ticket_commits", "near_commits"], "group_keys": ["keyed", "row_tickets"],
    "key_atoms": ["group_keys", "atoms"], "group_atoms": ["key_atoms"],
    "uncommented": ["texts"], "scrubbed": ["uncommented"], "parsed": ["scrubbed"], "ranges": ["parsed"], "facts": ["ranges"],
    "recent": ["commits"],
}


def _with(needed: list[str], query: str, **extra: str) -> str:
    """``query`` preceded by the named CTEs and all they rest on."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    ctes = [f"{n} AS ({_CTE[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(ctes)} {query}"


# --- redaction: the rules in RE2 syntax --------------------------------------

_SPACE = r"[\s\x0b\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NO_SPACE = "[^" + _SPACE[1:]


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
_HEX = "[0-9a-f]"
_RULES = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED:email]", "email"),
    (r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}\b", "[REDACTED:jwt]", "jwt"),
    (
        f"(?i)authorization:{_SPACE}*(?:bearer|basic|apikey){_SPACE}+{_NO_SPACE}+",
        "Authorization: [REDACTED]",
        "authorization-header",
    ),
    (
        f"(?i)(token|secret|api_?key|session_?id|cookie|auth){_SPACE}*[=:]{_SPACE}*"
        f"[\"']?{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}[\"']?",
        r"\1=[REDACTED:guid]",
        "guid-in-auth-context",
    ),
    (r"\b10(?:\.[0-9]{1,3}){3}\b", "[REDACTED:ipv4]", "ipv4-private-rfc1918-10"),
    (r"\b192\.168(?:\.[0-9]{1,3}){2}\b", "[REDACTED:ipv4]", "ipv4-private-rfc1918-192-168"),
    (r"\b172\.(?:1[6-9]|2\d|3[01])(?:\.[0-9]{1,3}){2}\b", "[REDACTED:ipv4]", "ipv4-private-rfc1918-172"),
    (rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", "[REDACTED:ipv4]", "ipv4-public"),
    (rf"(?i)\b{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{7}}\b", "[REDACTED:ipv6]", "ipv6"),
    (r"(?i)\b[a-z0-9-]+\.(?:internal|corp|local)\b", "[REDACTED:hostname]", "internal-hostname-suffix"),
]
_EXTRA = [(r"(?i)\buser\d+\b", "[REDACTED:user]", "user-id"), (r"([A-Z]+)-\d+", r"\1-#", "ticket-id")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _redacted(text: str, rules=_RULES) -> str:
    for pattern, replacement, _ in rules:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"
    return text


def _corpus(table: str, ids: str, text: str, rules=_RULES) -> str:
    return f"""SELECT {ids}, redacted, redacted <> {text} AS changed FROM
        (SELECT *, {_redacted(text, rules)} AS redacted FROM {table})"""


def _rule_hits() -> str:
    steps, counts = ["t0 AS (SELECT text AS x FROM poisoned)"], []
    for n, (pattern, replacement, name) in enumerate(_RULES):
        p = _quoted(pattern)
        steps.append(
            f"t{n + 1} AS (SELECT regexp_replace(x, {p}, {_quoted(replacement)}, 'g') AS x FROM t{n})"
        )
        counts.append(
            f"""SELECT CAST({n} AS INTEGER) AS rule_no, '{name}' AS rule,
            CAST(sum(len(regexp_extract_all(x, {p}))) AS BIGINT) AS hits,
            count(*) FILTER (WHERE len(regexp_extract_all(x, {p})) > 0) AS texts_hit FROM t{n}"""
        )
    return (
        f"WITH poisoned AS ({_CTE['poisoned']}), {', '.join(steps)} " + " UNION ALL ".join(counts)
    )


# --- exports -----------------------------------------------------------------

_CSV_TEXT = {name: f"coalesce(f_{name}, '')" for name, _, _ in views.LOG_FIELDS}
_ORACLE_CSV = _with(
    ["fields"],
    f"""SELECT row_ord AS event_id, {_time('f_timestamp')} AS timestamp,
    {_level(_CSV_TEXT['level'])} AS level, {_CSV_TEXT['message']} AS message,
    {_CSV_TEXT['source']} AS source, 'string,string' AS kinds, f_props AS props FROM fields""",
)


def _json_export(severity_absent: str) -> str:
    return _with(
        ["logs"],
        f"""SELECT row_ord AS event_id, timestamp, level, message, source,
        CASE WHEN f_severityLevel IS NULL THEN '{severity_absent}' ELSE 'number,number' END AS kinds,
        '{{"by":"user' || CAST(user_id AS VARCHAR) || '@example.com","ips":["10.0.0.'
        || CAST(user_id % 250 AS VARCHAR) || '","ok"],"k":' || CAST(row_ord AS VARCHAR) || '}}' AS props
        FROM logs JOIN events ON event_id = row_ord""",
    )


_ROW = "row_ord, timestamp, level, message, source"
_COLUMN_TYPES = " UNION ALL ".join(
    f"SELECT '{name}' AS name, {sql} AS v, '{kind}' AS kind, row_ord FROM kept"
    for name, kind, sql in [(n, k, f"f_{n}") for n, k, _ in views.LOG_FIELDS]
)


def _column_types(kept: str) -> str:
    filled = "v <> ''"
    number = r"(kind = 'number' OR (kind = 'string' AND regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?')))"
    date = """(kind = 'string' AND try_cast(v AS TIMESTAMP) IS NOT NULL AND regexp_matches(v, '[-:T]'))"""
    return _with(
        ["fields"],
        f"""SELECT name, CASE WHEN count(*) FILTER (WHERE {filled}) = 0 THEN 'string'
        WHEN bool_and({number}) FILTER (WHERE {filled}) THEN 'number'
        WHEN bool_and({date}) FILTER (WHERE {filled}) THEN 'datetime'
        WHEN bool_and(kind = 'string') FILTER (WHERE {filled}) THEN 'string' ELSE 'dynamic' END AS type,
        min(row_ord) AS first_ord FROM cells WHERE v IS NOT NULL GROUP BY name""",
        kept=kept,
        cells=_COLUMN_TYPES,
    )


_SUMMARY = """SELECT '[' || upper(severity) || '] ' || row_count || ' row(s) correlated into '
    || group_count || ' finding group(s)' AS headline, severity, row_count, group_count, unmatched_count,
    CASE WHEN group_count = 0 AND row_count > 0 THEN '{warning}' END AS warning FROM (
    SELECT CASE WHEN bool_or(regexp_matches(level, '(?i)critical|fatal|err')) THEN 'error'
                WHEN bool_or(regexp_matches(level, '(?i)warn')) THEN 'warn' ELSE 'info' END AS severity,
        count(*) AS row_count, count(DISTINCT group_key) AS group_count,
        count(*) FILTER (WHERE group_key IS NULL) AS unmatched_count FROM keyed)""".format(
    warning=_NO_KEYS
)

_EVIDENCE = """SELECT group_key, row_ord, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || source
    || '|' || coalesce(f_operation_Id, '-') || '/row-' || row_ord AS log_row_id, evidence_type, evidence_ref
    FROM (SELECT *, 'operationId' AS evidence_type, op_id AS evidence_ref FROM keyed
          UNION ALL SELECT *, 'ticket', unnest(tickets) FROM keyed
          UNION ALL SELECT *, 'service', service FROM keyed)
    WHERE group_key IS NOT NULL AND evidence_ref IS NOT NULL"""

_FIRST_TICKETS = """SELECT group_key, count(*) AS n, array_to_string(
    list(ticket ORDER BY first_ord, first_pos)[1:3], ', ') AS tickets FROM group_tickets GROUP BY group_key"""
_COMMIT_COUNTS = "SELECT group_key, count(*) AS n FROM group_commits GROUP BY group_key"
_ATOM_COUNTS = "SELECT group_key, count(*) AS n FROM group_atoms GROUP BY group_key"

_BULLETS = """SELECT CAST(row_number() OVER (ORDER BY first_ord) AS INTEGER) AS bullet_no,
    label || ': ' || row_count || ' row(s)'
    || CASE WHEN c.n > 0 THEN ' — ' || c.n || ' commit(s)' ELSE '' END
    || CASE WHEN t.n > 0 THEN ' — tickets: ' || t.tickets ELSE '' END AS text
    FROM (SELECT * FROM groups ORDER BY first_ord LIMIT 10) g
    LEFT JOIN (%s) c ON c.group_key = g.group_key LEFT JOIN (%s) t ON t.group_key = g.group_key""" % (
    _COMMIT_COUNTS,
    _FIRST_TICKETS,
)

_COMMIT_DETAILS = """SELECT g.group_key, c.commit_ord, c.sha, c.short_sha, c.author, c.authored_at, c.subject
    FROM group_commits g JOIN commits c ON c.commit_ord = g.commit_ord"""
_ATOM_DETAILS = """SELECT g.group_key, a.atom_ord, a.id, a.ts, a.message
    FROM group_atoms g JOIN atoms a ON a.atom_ord = g.atom_ord"""


def _redacted_findings() -> str:
    parts = {
        "summary": f"SELECT headline FROM ({_SUMMARY})",
        "bullets": f"SELECT text FROM ({_BULLETS})",
        "groups": "SELECT label FROM groups",
        "group_rows": "SELECT message FROM keyed WHERE group_key IS NOT NULL",
        "unmatched": "SELECT message FROM keyed WHERE group_key IS NULL",
        "group_tickets": "SELECT ticket FROM group_tickets",
        "group_atoms": f"SELECT message FROM ({_ATOM_DETAILS})",
    }
    selects = [f"SELECT '{p}' AS part, {_redacted('x')} AS text FROM ({sql}) q(x)" for p, sql in parts.items()]
    pairs = {
        "group_commits": f"SELECT author, subject FROM ({_COMMIT_DETAILS})",
        "evidence": f"SELECT log_row_id, evidence_ref FROM ({_EVIDENCE})",
    }
    selects += [
        f"SELECT '{p}' AS part, {_redacted('x')} || ' ' || {_redacted('y')} AS text FROM ({sql}) q(x, y)"
        for p, sql in pairs.items()
    ]
    union = " UNION ALL ".join(selects)
    return _with(
        ["groups", "group_commits", "group_atoms"],
        f"SELECT part, text, count(*) AS n FROM ({union}) GROUP BY part, text",
    )


_PREVIEW = f"""SELECT k.row_ord, timestamp, level, replace({_redacted('message')}, '|', '\\|') AS message,
    source, (SELECT count(*) FROM keyed) AS total_rows
    FROM keyed k LEFT JOIN groups g ON g.group_key = k.group_key
    ORDER BY k.group_key IS NULL, g.first_ord, k.row_ord LIMIT 50"""


def _bundle_counts() -> str:
    texts = {
        "summary": _SUMMARY, "bullets": _BULLETS, "groups": "SELECT label FROM groups",
        "group_rows": "SELECT message FROM keyed WHERE group_key IS NOT NULL",
        "unmatched": "SELECT message FROM keyed WHERE group_key IS NULL",
        "group_tickets": "SELECT ticket FROM group_tickets",
        "group_commits": _COMMIT_DETAILS, "group_atoms": _ATOM_DETAILS, "evidence": _EVIDENCE,
        "group_report": "SELECT label FROM groups", "raw_preview": _PREVIEW,
        "linked_tickets": f"SELECT DISTINCT '{LINK_BASE}/' || url_encode(ticket) AS link FROM group_tickets",
        "column_types": f"SELECT DISTINCT name FROM ({_COLUMN_TYPES.replace('FROM kept', 'FROM fields')}) WHERE v IS NOT NULL",
        "rowset_meta": "SELECT 'events' AS source",
    }
    plain = ("raw_preview", "linked_tickets", "column_types", "rowset_meta")
    rows = []
    for name, sql in texts.items():
        text = BUNDLE_TEXT[name] if name in plain else _redacted(BUNDLE_TEXT[name])
        for form in ("parquet", "json"):
            rows.append(
                f"""SELECT '{form}' AS format, '{name}' AS table_name, count(*) AS n,
                CAST(sum(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)) AS BIGINT) AS texts FROM ({sql})"""
            )
    return _with(["groups", "group_commits", "group_atoms"], " UNION ALL ".join(rows))


_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _listed(column: str) -> str:
    return f"array_to_string({_ORDERED.format(column)}, '|')"


_PROPS = f"""'{{"k":' || row_ord || ',"by":"' || {_redacted("'user' || user_id || '@example.com'")}
    || '","ips":["' || {_redacted("'10.0.0.' || (user_id % 250)")} || '","ok"]}}'"""

_LINKED_TO_RECENT = f"""SELECT t.group_key, c.commit_ord FROM group_tickets t
    JOIN recent c ON contains(c.subject, t.ticket)
    UNION SELECT k.group_key, c.commit_ord FROM keyed k JOIN recent c ON k.op_id IS NOT NULL
    AND try_cast(k.f_timestamp AS TIMESTAMP) IS NOT NULL
    AND abs(epoch_ms(c.authored_at) - epoch_ms(k.timestamp)) <= {views.WINDOW_MINUTES * 60_000}"""
_INVESTIGATED = f"""SELECT {_redacted('label', _RULES + _EXTRA)} AS label, row_count, first_ord,
    count(DISTINCT commit_ord) AS commit_count FROM groups g LEFT JOIN ({_LINKED_TO_RECENT}) l
    ON l.group_key = g.group_key GROUP BY label, row_count, first_ord"""


def _investigate_export() -> str:
    """The group report and meta of a bundle made from a CSV export, and the rows of its tables."""
    tables = {
        "summary": "SELECT 1",
        "bullets": "SELECT group_key FROM groups LIMIT 10",
        "groups": "SELECT group_key FROM groups",
        "group_rows": "SELECT row_ord FROM keyed WHERE group_key IS NOT NULL",
        "unmatched": "SELECT row_ord FROM keyed WHERE group_key IS NULL",
        "group_tickets": "SELECT ticket FROM group_tickets",
        "group_commits": _LINKED_TO_RECENT,
        "group_atoms": "SELECT atom_ord FROM group_atoms",
        "evidence": _EVIDENCE,
        "group_report": "SELECT group_key FROM groups",
        "raw_preview": "SELECT row_ord FROM keyed LIMIT 50",
        "linked_tickets": f"SELECT DISTINCT {_redacted('ticket', _RULES + _EXTRA)} FROM group_tickets",
        "column_types": f"SELECT unnest(range({len(views.LOG_FIELDS) + 1}))",
        "rowset_meta": "SELECT 1",
    }
    counts = " UNION ALL ".join(
        f"SELECT 'manifest' AS part, '{name}' AS name, count(*) AS row_count, CAST(0 AS BIGINT) AS commit_count FROM ({sql})"
        for name, sql in tables.items()
    )
    return _with(
        ["groups", "group_tickets", "group_atoms", "recent"],
        f"""SELECT 'group_report' AS part, label AS name, row_count, commit_count FROM ({_INVESTIGATED})
        UNION ALL {counts} UNION ALL SELECT 'rowset_meta', 'csv', count(*),
        count(*) FILTER (WHERE try_cast(f_timestamp AS TIMESTAMP) IS NULL) FROM fields""",
    )


ORACLES = {
    "normalize_logs": _with(["logs"], f"SELECT {_ROW} FROM logs"),
    "column_types": _column_types("SELECT * FROM fields"),
    "preview": _with(["logs"], f"SELECT {_ROW} FROM logs ORDER BY row_ord LIMIT 50"),
    "rowset_meta": _with(
        ["fields"],
        """SELECT 'events' AS source, count(*) AS row_count,
        count(*) FILTER (WHERE try_cast(f_timestamp AS TIMESTAMP) IS NULL) AS unreadable_times FROM fields""",
    ),
    "csv_roundtrip": _ORACLE_CSV,
    "json_roundtrip": _json_export("number"),
    "json_lines_roundtrip": _json_export("number"),
    "tabular_roundtrip": _json_export("number,null"),
    "commit_log_roundtrip": _with(
        ["commits"],
        """SELECT sha, short_sha, author, date_trunc('milliseconds', authored_at) AS authored_at, subject
        FROM commits""",
    ),
    "recent_commits": _with(["recent"], "SELECT * FROM recent"),
    "time_bounded_scan": f"""SELECT event_id, ts, event_type FROM events
        WHERE ts BETWEEN TIMESTAMP '{views.AS_OF}' - INTERVAL {HOURS} HOUR AND TIMESTAMP '{views.AS_OF}'""",
    "atoms_source": _with(
        ["atoms"],
        """SELECT atom_ord, id, date_trunc('milliseconds', ts) AS ts, message,
        CASE WHEN atom_ord % 7 <> 0 THEN tag1 || '|' || tag2 ELSE '' END AS tags,
        CAST(CASE WHEN atom_ord % 7 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS n_tags FROM atoms""",
    ),
    "query_facts": _with(
        ["facts"],
        f"""SELECT query_id, {_listed('tables0')} AS tables, {_listed('projections0')} AS projections,
        {_listed('tickets0')} AS tickets, CASE WHEN trim(text) = '' THEN '{_BLANK_ERROR}' END AS error
        FROM facts""",
    ),
    "query_time_range": _with(["facts"], "SELECT query_id, range_from, range_to FROM facts"),
    "table_usage": _with(
        ["facts"],
        f"""SELECT table_name, count(*) AS query_count, min(range_from) AS earliest_from,
        max(range_to) AS latest_to FROM (SELECT unnest({_ORDERED.format('tables0')}) AS table_name,
        range_from, range_to FROM facts) GROUP BY table_name""",
    ),
    "row_keys": _with(
        ["keyed"], "SELECT row_ord, op_id, array_to_string(tickets, '|') AS tickets, service FROM keyed"
    ),
    "service_table": _with(
        ["logs"],
        """SELECT l.row_ord, l.source, (SELECT arg_min('svc' || c_custkey, c_custkey) FROM customer
        WHERE l.source = 'svc' || c_custkey OR starts_with(l.source, 'svc' || c_custkey || '.')) AS service
        FROM logs l""",
    ),
    "unmatched_rows": _with(["keyed"], f"SELECT {_ROW} FROM keyed WHERE group_key IS NULL"),
    "group_assignment": _with(
        ["keyed"], "SELECT row_ord, group_key, label FROM keyed WHERE group_key IS NOT NULL"
    ),
    "group_counts": _with(["groups"], "SELECT * FROM groups"),
    "group_tickets": _with(
        ["group_tickets"], "SELECT group_key, ticket, first_ord FROM group_tickets"
    ),
    "ticket_commits": _with(["ticket_commits"], "SELECT * FROM ticket_commits"),
    "proximity_commits": _with(["near_commits"], "SELECT * FROM near_commits"),
    "group_commits": _with(["group_commits"], _COMMIT_DETAILS),
    "group_atoms": _with(["group_atoms"], _ATOM_DETAILS),
    "evidence": _with(["keyed"], _EVIDENCE),
    "summary": _with(["keyed"], _SUMMARY),
    "bullets": _with(["groups", "group_commits"], _BULLETS),
    "findings_counts": _with(
        ["keyed"], f"SELECT group_count, unmatched_count, warning FROM ({_SUMMARY})"
    ),
    "redact_documents": _corpus("documents", "doc_id", "text"),
    "redact_conversations": _corpus("conversations", "conv_id, turn", "text"),
    "redact_pages": _corpus("pages", "page_id", "html"),
    "redact_poisoned": _with(["poisoned"], _corpus("poisoned", "doc_id", "text")),
    "redact_glued": _with(["glued"], _corpus("glued", "doc_id", "text")),
    "redact_rule_hits": _rule_hits(),
    "redact_extra_rules": _with(["logs"], _corpus("logs", "row_ord", "message", _RULES + _EXTRA)),
    "redact_raw_map": _with(
        ["logs"],
        f"""SELECT row_ord, {_redacted('message')} AS message, source, {_redacted('f_message')} AS raw_message,
        {_redacted('f_operationName')} AS "raw_operationName", {_PROPS} AS raw_props,
        f_severityLevel AS "raw_severityLevel", CAST({' + '.join(
            f'(f_{n} IS NOT NULL)::INT' for n, _, _ in views.LOG_FIELDS)} AS INTEGER) AS n_keys
        FROM logs JOIN events ON event_id = row_ord""",
    ),
    "redact_findings": _redacted_findings(),
    "linked_tickets": _with(
        ["group_tickets"],
        f"""SELECT DISTINCT {_redacted('ticket')} AS ticket,
        '{LINK_BASE}/' || url_encode({_redacted('ticket')}) AS link FROM group_tickets""",
    ),
    "group_report": _with(
        ["groups", "group_commits", "group_atoms"],
        f"""SELECT sha256('{RUN_SECRET}' || g.group_key) AS group_id, {_redacted('label')} AS label,
        row_count, first_ord, coalesce(c.n, 0) AS commit_count,
        coalesce(t.n, 0) AS ticket_count, coalesce(a.n, 0) AS atom_count
        FROM groups g LEFT JOIN ({_COMMIT_COUNTS}) c ON c.group_key = g.group_key
        LEFT JOIN ({_FIRST_TICKETS}) t ON t.group_key = g.group_key
        LEFT JOIN ({_ATOM_COUNTS}) a ON a.group_key = g.group_key""",
    ),
    "raw_preview": _with(
        ["groups"],
        _PREVIEW,
    ),
    "bundle_roundtrip": _bundle_counts(),
    "investigate": _with(["groups", "group_tickets", "recent"], _INVESTIGATED),
    "investigate_export": _investigate_export(),
    "query_validity": _with(
        ["texts"],
        f"""SELECT query_id, CASE WHEN query_id % 4 < 2 THEN '{_BLANK_ERROR}' END AS error,
        CASE WHEN query_id % 4 < 2 THEN 0 ELSE 1 END AS has_facts FROM texts""",
    ),
    "no_key_warning": f"""SELECT CAST(0 AS BIGINT) AS group_count, count(*) AS unmatched_count,
        CASE WHEN count(*) > 0 THEN '{_NO_KEYS}' END AS warning FROM events""",
    "redact_bypass": _with(
        ["groups", "group_commits"],
        f"""SELECT 'groups' AS part, label AS text, count(*) AS n FROM groups GROUP BY ALL
        UNION ALL SELECT 'unmatched', message, count(*) FROM keyed WHERE group_key IS NULL GROUP BY ALL
        UNION ALL SELECT 'group_commits', subject, count(*) FROM ({_COMMIT_DETAILS}) GROUP BY ALL""",
    ),
    "token_commits": _with(
        ["group_tickets", "commits"],
        f"""SELECT DISTINCT t.ticket, c.commit_ord FROM group_tickets t JOIN commits c
        ON list_contains(regexp_extract_all(c.subject, '{_REGEX}'), t.ticket)""",
    ),
    "json_array_roundtrip": _json_export("number"),
    "tabular_document_roundtrip": _json_export("number,null"),
}
