"""Tickets, commits and external notes of each finding group.

Every operator here works on distinct (group, key) pairs, never on log rows, and
joins by equality only: a text search or a time window is first rewritten so
that it has an equality key. A side that was aggregated by the key it is joined by is
staged before, so that a hot key of the other can be split (see ``skew_join``).

There may be as many links as groups times commits. So what lists them (``proximity_commits``,
``commit_rows``, ``atom_rows``) meets each link once, where it is put out, and neither stages nor shuffles links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.functions.skew import skew_join
from logclew.functions.timestamps import epoch
from logclew.operators.keys import ticket_mentions
from logclew.session import is_staged, spread, stage

# The index of a text holds its grams of so many characters, and shorter ones for shorter keys.
_GRAM = 6
# Texts are cut into chunks of so many characters, so that no gram is looked for from the
# start of a long text.
_CHUNK = 64
# Which grams occur in keys is told by one bit each in so many words of 64 bits.
_WORDS = 65_536
# Running counts over time are made in stretches of so many milliseconds.
_STRETCH_MILLIS = 600_000
# Commits and notes meet their groups in arrays of about so many.
_BLOCK = 16
# Those of one key are dealt out by so many, and the groups of the key to each share.
_SHARE = 16_384
# A commit or note with more keys than that has its links made distinct by a shuffle.
_MANY_KEYS = 32
# The spans of a group are looked up by stretches of so many windows.
_WINDOWS = 64
# The stretch of commits without a date.
_UNDATED = -(1 << 62)


def group_tickets(keyed: DataFrame) -> DataFrame:
    """``group_key, ticket, first_ord, first_pos``: distinct tickets, order of mention.

    The outer ``posexplode`` keeps Catalyst from adding a filter on the ticket
    array, which it would push down and so extract all tickets twice.
    """
    mentions = keyed.select(
        "group_key", "row_ord", F.posexplode_outer("tickets").alias("pos", "ticket")
    ).where(F.col("ticket").isNotNull())
    return mentions.groupBy("group_key", "ticket").agg(
        F.min("row_ord").alias("first_ord"), F.min_by("pos", "row_ord").alias("first_pos")
    )


def group_match_keys(keyed: DataFrame) -> DataFrame:
    """Distinct ``group_key, key`` over operation ids, tickets and services."""
    keys = F.concat(F.array("op_id"), F.col("tickets"), F.array("service"))
    return (
        keyed.select("group_key", F.explode(keys).alias("key"))
        .where(F.col("key").isNotNull())
        .distinct()
    )


def texts_containing(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct ``key, text_ord`` where ``text`` contains ``key``.

    ``texts`` is ``(text_ord, text)`` and ``keys`` distinct non-empty ``(key)``, staged. The texts
    are indexed by their grams, short pieces with their positions; of the grams only those go on that
    some key has too. A key is then looked up by the rarest of its grams, at all places of that one, and
    the rest of it is compared where it would have to stand. A key with a gram that no text has is
    in none. The work is linear in the texts, whatever lengths the keys have.
    """
    size = F.least(F.length("key"), F.lit(_GRAM))
    sizes = keys.agg(F.sort_array(F.collect_set(size))).scalar()  # at most _GRAM numbers
    offsets = F.explode(F.sequence(F.lit(0), F.length("key") - F.col("size")))
    of_keys = (
        keys.select("key", size.alias("size"))
        .select("key", "size", offsets.alias("offset"))
        .select("key", "offset", F.substring(F.col("key"), F.col("offset") + 1, F.col("size")).alias("gram"))
    )
    chunks = _chunks(spread(texts, "text_ord"))
    places = stage(_places(chunks, sizes, of_keys), "text-grams")
    counts = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        of_keys.join(stage(counts, "gram-counts"), "gram", "left")
        .groupBy("key")
        .agg(
            F.count_if(F.col("n").isNull()).alias("missing"),
            F.min(F.struct("n", "offset", "gram")).alias("first"),
        )
        .where(F.col("missing") == 0)
        .select("key", "first.offset", "first.gram")
    )
    candidates = (
        places.join(rarest, "gram")
        .select("key", "text_ord", (F.col("at") - F.col("offset")).alias("at"))
        .where(F.col("at") >= 0)
    )
    return _verified(candidates, chunks)


def _chunks(texts: DataFrame) -> DataFrame:
    """``text_ord, nth, chunk``: texts in chunks, each with the first characters of the next."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    cut = texts.select("text_ord", F.explode(F.array(parts)).alias("parts"))
    ahead = lambda n: F.coalesce(F.substring(F.get("parts", n + 1), 1, _GRAM - 1), F.lit(""))
    joined = F.transform("parts", lambda part, n: F.concat(part, ahead(n)))
    return cut.select("text_ord", F.posexplode(joined).alias("nth", "chunk")).withColumn(
        "nth", F.col("nth").cast("bigint")
    )


def _places(chunks: DataFrame, sizes: Column, of_keys: DataFrame) -> DataFrame:
    """``gram, text_ord, at`` of the grams of texts that occur in some key, and by chance of a few more.

    Asked of a table of at most ``_WORDS`` words of bits, which is broadcast.
    """
    hashed = of_keys.select(F.xxhash64("gram").alias("h"))
    word, bit = F.pmod("h", F.lit(_WORDS)), F.expr("shiftleft(1L, CAST(pmod(shiftright(h, 32), 64) AS INT))")
    bits = hashed.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    starts = F.sequence(F.lit(1), F.least(F.lit(_CHUNK), F.length("chunk") - F.col("size") + 1))
    return (
        chunks.select("text_ord", "nth", "chunk", F.explode(sizes).alias("size"))
        .where(F.col("size") <= F.length("chunk"))
        .select("text_ord", "nth", "chunk", "size", F.explode(starts).alias("start"))
        .select(
            F.substring(F.col("chunk"), F.col("start"), F.col("size")).alias("gram"),
            "text_ord",
            (F.col("nth") * _CHUNK + F.col("start") - 1).alias("at"),
        )
        .withColumn("h", F.xxhash64("gram"))
        .withColumn("word", word)
        .join(F.broadcast(bits), "word")
        .where(F.col("bits").bitwiseAND(bit) != 0)
        .select("gram", "text_ord", "at")
    )


def _verified(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct ``key, text_ord`` of candidates whose whole key stands at ``at``, chunk by chunk."""
    first = F.expr(f"at div {_CHUNK}")
    last = F.expr(f"(at + length(key) - 1) div {_CHUNK}")
    parts = candidates.distinct().select("*", F.explode(F.sequence(first, last)).alias("nth"))
    in_chunk = F.greatest(F.col("at") - F.col("nth") * _CHUNK, F.lit(0))
    in_key = F.greatest(F.col("nth") * _CHUNK - F.col("at"), F.lit(0))
    length = F.least(F.lit(_CHUNK) - F.col("in_chunk"), F.length("key") - F.col("in_key"))
    whole = parts.withColumns({"in_chunk": in_chunk, "in_key": in_key}).select(
        "key",
        "text_ord",
        "at",
        "nth",
        (F.col("in_chunk") + 1).cast("int").alias("from"),
        length.cast("int").alias("length"),
        F.substring(F.col("key"), (F.col("in_key") + 1).cast("int"), length.cast("int")).alias("part"),
    )
    same = F.substring(F.col("chunk"), F.col("from"), F.col("length")) == F.col("part")
    return (
        whole.join(chunks, ["text_ord", "nth"], "left")
        .groupBy("key", "text_ord", "at")
        .agg(F.min(F.coalesce(same, F.lit(False))).alias("same"))
        .where("same")
        .select("key", "text_ord")
        .distinct()
    )


def ticket_commits(
    tickets: DataFrame, commits: DataFrame, token_regex: str | None = None
) -> DataFrame:
    """Distinct ``ticket, commit_ord`` where the commit subject contains the ticket.

    With ``token_regex`` a subject names the tickets that the pattern finds in it, and no
    text is searched: an equality join of two narrow tables.
    """
    if token_regex:
        named = commits.select(
            F.explode(ticket_mentions(F.col("subject"), token_regex)).alias("ticket"), "commit_ord"
        )
        known = stage(tickets.select("ticket").distinct(), "ticket-keys")
        return named.join(known, "ticket", "left_semi")
    texts = commits.select(F.col("commit_ord").alias("text_ord"), F.col("subject").alias("text"))
    keys = stage(tickets.select(F.col("ticket").alias("key")).distinct(), "ticket-keys")
    return texts_containing(texts, keys).select(
        F.col("key").alias("ticket"), F.col("text_ord").alias("commit_ord")
    )


def proximity_commits(keyed: DataFrame, commits: DataFrame, window_minutes: int) -> DataFrame:
    """Distinct ``group_key, commit_ord`` with a commit within the window of a row.

    Only rows with an operation id and a readable time count, and commits with a date. Time is cut into buckets of one window,
    and the rows of a group in a bucket reduce, map-side, to their earliest and
    latest time, so an operation id that fills a third of the log costs one row per bucket. The time
    around them is merged into disjoint spans. A commit lies in at most one span of a group, and
    is met in its own bucket only, so a pair is found once. Commits of one number and
    several times are apart: their pairs are made distinct.
    """
    if window_minutes == 0:
        pairs = T.StructType([keyed.schema["group_key"], commits.schema["commit_ord"]])
        return keyed.sparkSession.createDataFrame([], pairs)
    window = window_minutes * 60_000
    dated = commits.where(F.col("authored_at") != epoch()).select("commit_ord", "authored_at")
    at = F.col("authored_at")
    times = dated.groupBy("commit_ord").agg(F.min(at).alias("authored_at"), F.max(at).alias("latest"))
    times = stage(times, "commit-times")
    once = times.where(at == F.col("latest")).drop("latest")
    spans = stage(merged_spans(keyed, window_minutes), "spans")
    near = _near_rows(spans, once, window, F.col("group_key")).select("group_key", "commit_ord")
    several = times.where(at != F.col("latest")).select(F.col("commit_ord").alias("ord"))
    if several.isEmpty():
        return near
    apart = dated.join(several, F.col("commit_ord").eqNullSafe(F.col("ord")), "left_semi")
    return near.unionByName(_near(keyed, apart, window_minutes).distinct())


def _near(keyed: DataFrame, commits: DataFrame, window_minutes: int) -> DataFrame:
    """``group_key, commit_ord`` of ``proximity_commits``; a pair once per bucket it is found in.

    A commit in the bucket of a row always matches, one in the next bucket matches exactly when it is near
    the latest row, one in the bucket before when it is near the earliest.
    """
    window = window_minutes * 60_000
    spans, at = _spans(keyed, window), F.unix_millis("authored_at")
    steps = F.array(*[F.floor(F.col("commit_at") / window) + step for step in (-1, 0, 1)])
    near = (
        commits.where(F.col("authored_at") != epoch())
        .select("commit_ord", at.alias("commit_at"))
        .select("commit_ord", "commit_at", F.explode(steps).alias("bucket"))
    )
    in_reach = (F.col("commit_at") >= F.col("earliest") - window) & (
        F.col("commit_at") <= F.col("latest") + window
    )
    return (
        skew_join(spans, near, "bucket", name="near")
        .where(in_reach)
        .select("group_key", "commit_ord")
    )


def _spans(keyed: DataFrame, window: int) -> DataFrame:
    """``group_key, bucket, earliest, latest`` of rows with an operation id and a readable time."""
    at = F.unix_millis("timestamp")
    return (
        keyed.where(F.col("op_id").isNotNull() & F.col("time_known"))
        .select("group_key", at.alias("at"))
        .withColumn("bucket", F.floor(F.col("at") / window))
        .groupBy("group_key", "bucket")
        .agg(F.min("at").alias("earliest"), F.max("at").alias("latest"))
    )


def merged_spans(keyed: DataFrame, window_minutes: int) -> DataFrame:
    """``group_key, since, until``: disjoint spans of time that lie within the window of a row.

    Rows of one bucket are within a window of each other, so theirs is one span. A
    group has at most a span per window of the log's time, however many rows it has.
    """
    window = window_minutes * 60_000
    order = Window.partitionBy("group_key").orderBy("since")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    since, until = F.col("earliest") - window, F.col("latest") + window
    return (
        _spans(keyed, window)
        .select("group_key", since.alias("since"), until.alias("until"))
        .withColumn("starts", F.when(F.col("since") <= before, 0).otherwise(1))
        .withColumn("span", F.sum("starts").over(order))
        .groupBy("group_key", "span")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"))
        .drop("span")
    )


def _ranks(times: DataFrame, instants: DataFrame) -> DataFrame:
    """``at, upto, before``: of each of ``instants``, how many of ``times`` are not after it, and before it.

    Counted by instant first, so that one in which much happens is one row; then summed up within
    stretches, which have a bounded number of instants, and over the stretches, one row each.
    """
    both = times.select("at", F.lit(1).alias("n")).unionByName(instants.select("at", F.lit(0).alias("n")))
    counted = stage(both.groupBy("at").agg(F.sum("n").alias("n")), "instants")
    stretch = F.floor(F.col("at") / _STRETCH_MILLIS).alias("stretch")
    earlier = Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(stretch)
        .agg(F.sum("n").alias("n"))
        .select("stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    within = F.sum("n").over(Window.partitionBy("stretch").orderBy("at"))
    upto = F.col("offset") + F.col("within")
    return (
        counted.select(stretch, "at", "n")
        .withColumn("within", within)
        .join(offsets, "stretch")
        .select("at", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    )


def commit_counts(
    keyed: DataFrame,
    tickets: DataFrame,
    commits: DataFrame,
    window_minutes: int,
    token_regex: str | None = None,
    found: DataFrame | None = None,
    spans: DataFrame | None = None,
) -> DataFrame:
    """``group_key, commit_count``: how many commits ``group_commits`` would list.

    Commits near a group are counted without listing them: in the order of time, the commits up to the end of a span
    less those before it. To these come the commits of its tickets that are near none of its rows.
    ``tickets`` are the ``group_tickets`` of ``keyed``; pass them staged. So are ``found``, the ``ticket_commits`` of
    them, and ``spans``, the ``merged_spans`` of ``keyed``, where they are known.
    """
    dated = F.when(F.col("authored_at") != epoch(), F.unix_millis("authored_at"))
    when = commits.select("commit_ord", dated.alias("at"))
    found = ticket_commits(tickets, commits, token_regex) if found is None else found
    linked = stage(found.join(when, "commit_ord"), "dated-commits")
    pairs = tickets.join(linked, "ticket").select("group_key", "commit_ord", "at").distinct()
    count = F.count(F.lit(1)).alias("commit_count")
    if window_minutes == 0:
        return pairs.groupBy("group_key").agg(count)
    window = window_minutes * 60_000
    spans = stage(merged_spans(keyed, window_minutes), "spans") if spans is None else spans
    edge = lambda at, first: F.struct(F.col(at).alias("at"), F.lit(first).alias("first"))
    edges = spans.select("group_key", F.inline(F.array(edge("since", True), edge("until", False))))
    ranks = _ranks(when.where(F.col("at").isNotNull()), edges)
    rank = F.when(F.col("first"), -F.col("before")).otherwise(F.col("upto"))
    near = edges.join(ranks, "at").groupBy("group_key").agg(F.sum(rank).alias("commit_count"))
    # Only groups of an operation id have spans. A span is cut into the buckets it reaches, so that
    # the commits of a group are compared with the few of its spans that are in their bucket.
    has_spans = F.col("group_key").startswith("op:")
    bucket = lambda at: F.floor(F.col(at) / window)
    reached = spans.select("*", F.explode(F.sequence(bucket("since"), bucket("until"))).alias("bucket")).alias("s")
    linked_to_op = pairs.where(has_spans).withColumn("bucket", bucket("at")).alias("p")
    same_bucket = (F.col("p.group_key") == F.col("s.group_key")) & (F.col("p.bucket") == F.col("s.bucket"))
    within = F.col("p.at").between(F.col("s.since"), F.col("s.until"))
    apart = linked_to_op.join(reached, same_bucket & within, "left_anti")
    every = [near] + [some.groupBy("group_key").agg(count) for some in (pairs.where(~has_spans), apart)]
    counts = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("group_key")
    return counts.agg(F.sum("commit_count").alias("commit_count")).where(F.col("commit_count") > 0)


def group_commits(
    keyed: DataFrame,
    tickets: DataFrame,
    commits: DataFrame,
    window_minutes: int,
    token_regex: str | None = None,
) -> DataFrame:
    """Distinct ``group_key, commit_ord`` by ticket or by time.

    ``tickets`` are the ``group_tickets`` of ``keyed``; pass them staged.
    """
    linked = stage(ticket_commits(tickets, commits, token_regex), "ticket-commits")
    by_ticket = tickets.join(linked, "ticket").select("group_key", "commit_ord")
    if window_minutes == 0:
        return _distinct_by_group(by_ticket)
    near = _near(keyed, commits, window_minutes)
    return _distinct_by_group(by_ticket.unionByName(near))


def _distinct_by_group(links: DataFrame) -> DataFrame:
    """Distinct links, those of a group (at most one per commit or note) in one partition."""
    return links.repartition("group_key").distinct()


def _blocks(rows: DataFrame, by: list[str], ordinal: str) -> tuple[DataFrame, DataFrame]:
    """``*by, rows`` with the other columns in arrays of about ``_BLOCK``, and ``*by, n``; ``rows`` are staged."""
    sizes = stage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "block-sizes")
    block = F.pmod(F.xxhash64(ordinal), F.ceil(F.col("n") / _BLOCK)).alias("block")
    rest = F.struct(*[c for c in rows.columns if c not in by])
    dealt = skew_join(rows, sizes, by, name="blocks").groupBy(*by, block)
    return dealt.agg(F.collect_list(rest).alias("rows")).drop("block"), sizes


def _met(blocks: DataFrame, groups: DataFrame, by: list[str], group: Column, checked: list[str]) -> DataFrame:
    """Each row of ``blocks`` with each of ``groups``: ``group_key``, which is ``group``, ``checked``, columns of the row.

    Merged, not broadcast, so that a block is met by one group after another: what
    is written then repeats what was written shortly before, and packs well.
    """
    sides = [side if is_staged(side) else stage(side, name) for side, name in ((blocks, "blocks"), (groups, "met"))]
    met = sides[0].hint("merge").join(sides[1], by)
    return met.select(group.alias("group_key"), *checked, "rows").select("group_key", *checked, F.inline("rows"))


def _near_rows(spans: DataFrame, commits: DataFrame, window: int, group: Column) -> DataFrame:
    """``group_key`` and the columns of commits that lie within a span of the group."""
    at = F.unix_millis("authored_at")
    bucket = lambda millis: F.floor(millis / window)
    dated = commits.where(F.col("authored_at") != epoch()).withColumn("at", at)
    dated = stage(dated.withColumn("bucket", bucket(F.col("at"))), "dated")
    blocks, _ = _blocks(dated, ["bucket"], "commit_ord")
    reached = F.sequence(bucket(F.col("since")), bucket(F.col("until")))
    groups = spans.select("group_key", "since", "until", F.explode(reached).alias("bucket"))
    met = _met(blocks, groups, ["bucket"], group, ["since", "until"])
    near = met.where(F.col("at").between(F.col("since"), F.col("until")))
    return near.select("group_key", *commits.columns)


def _ranked(linked: DataFrame, ordinal: str) -> DataFrame:
    """``<ordinal>, key, n, before`` of links of commits or notes with few keys.

    ``n`` have the key. ``before`` are the keys of the same commit or note that come earlier in one order of all
    keys: those that more have come first.
    """
    sizes = stage(linked.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key-sizes")
    rank = F.struct((-F.col("n")).alias("rank"), "key")
    keys = linked.join(sizes, "key").groupBy(ordinal).agg(F.sort_array(F.collect_list(rank)).alias("keys"))
    return keys.select(ordinal, "keys", F.posexplode("keys").alias("pos", "own")).select(
        ordinal, "own.key", (-F.col("own.rank")).alias("n"), F.slice("keys.key", F.lit(1), F.col("pos")).alias("before")
    )


def _groups_of_keys(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """``group_key, key, earlier``: keys of the group that come before ``key`` in some commit or note.

    A key has few of them: of the keys that come before it, each is in as many commits or more.
    """
    before = stage(ranked.select("key", F.explode("before").alias("earlier")).distinct(), "earlier-keys")
    known = pairs.select("group_key", F.col("key").alias("earlier"))
    both = pairs.join(before, "key").join(known, ["group_key", "earlier"], "left_semi")
    both = both.select("group_key", "key", "earlier")
    alone = pairs.join(stage(ranked.select("key").distinct(), "linked-keys"), "key", "left_semi")
    alone = alone.select("group_key", "key", F.lit(None).cast("string").alias("earlier"))
    return alone.unionByName(both).groupBy("group_key", "key").agg(F.collect_set("earlier").alias("earlier"))


def _key_rows(
    pairs: DataFrame,
    linked: DataFrame,
    rows: DataFrame | None,
    ordinal: str,
    group: Column,
    spans: DataFrame | None = None,
    window: int = 0,
) -> DataFrame:
    """``group_key`` and the columns of ``rows`` (commits or notes) that have a key of the group, each once.

    Without ``rows`` their number only.

    ``pairs`` are ``group_key, key`` and ``linked`` is ``key, <ordinal>``, both distinct and staged. A commit that has several
    keys of a group is met by the earliest of them only (see ``_ranked``), which is
    seen from the few keys of both that can meet. With ``spans``, those within one are left out.
    """
    ranked = stage(_ranked(linked, ordinal), "ranked")
    shared = ranked if rows is None else ranked.join(rows, ordinal)
    share = F.pmod(F.xxhash64(ordinal), F.ceil(F.col("n") / _SHARE))
    if spans is not None:
        at = F.when(F.col("authored_at") != epoch(), F.unix_millis("authored_at"))
        shared = shared.withColumn("at", at)
        share = F.coalesce(F.floor(F.col("at") / (_WINDOWS * window)), F.lit(_UNDATED))
    shared = stage(shared.withColumn("share", share).drop("n"), "key-rows")
    blocks, sizes = _blocks(shared, ["key", "share"], ordinal)
    groups = stage(_groups_of_keys(pairs, ranked), "key-groups").join(sizes.drop("n"), "key")
    checked, met_before = ["earlier"], F.arrays_overlap("earlier", "before")
    if spans is not None:
        stretch = lambda millis: F.floor(F.col(millis) / (_WINDOWS * window))
        reached = spans.select("*", F.explode(F.sequence(stretch("since"), stretch("until"))).alias("share"))
        reached = reached.groupBy("group_key", "share").agg(F.collect_list(F.struct("since", "until")).alias("spans"))
        groups = skew_join(groups, reached, ["group_key", "share"], "left", "key-spans")
        near = F.exists("spans", lambda span: F.col("at").between(span["since"], span["until"]))
        checked, met_before = ["earlier", "spans"], met_before | F.coalesce(near, F.lit(False))
    met = _met(blocks, groups, ["key", "share"], group, checked)
    return met.where(~met_before).select("group_key", *([ordinal] if rows is None else rows.columns))


def _apart(linked: DataFrame, ordinal: str) -> DataFrame:
    """``<ordinal>`` of commits or notes with more than ``_MANY_KEYS`` keys."""
    counts = linked.groupBy(ordinal).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > _MANY_KEYS).select(ordinal)


def commit_rows(
    keyed: DataFrame,
    tickets: DataFrame,
    linked: DataFrame,
    commits: DataFrame,
    window_minutes: int,
    spans: DataFrame | None = None,
    group: Column | None = None,
) -> DataFrame:
    """The commits of each group: ``group_key`` (or ``group``, a function of it) and the columns of ``commits``.

    Commits near a group come from its spans, those of its tickets from what is near none of them; a commit
    of many tickets, or of one number and several times, has its links made distinct instead. ``tickets``,
    ``linked``, the ``ticket_commits`` of them, and ``spans``, the ``merged_spans`` of ``keyed``, are staged.
    """
    group, window = F.col("group_key") if group is None else group, window_minutes * 60_000
    linked = linked.withColumnRenamed("ticket", "key")
    pairs = tickets.select("group_key", F.col("ticket").alias("key"))
    time = F.struct("authored_at")
    times = commits.groupBy("commit_ord").agg(F.min(time).alias("first"), F.max(time).alias("last"))
    several = times.where(~F.col("first").eqNullSafe(F.col("last"))).select("commit_ord")
    apart = stage(several.union(_apart(linked, "commit_ord")).distinct(), "apart")
    some = not apart.isEmpty()
    rest = lambda df: df.join(apart, "commit_ord", "left_anti") if some else df
    rows = rest(commits).where(F.col("commit_ord").isNotNull())
    if window and spans is None:
        spans = stage(merged_spans(keyed, window_minutes), "spans")
    found = [_key_rows(pairs, rest(linked), rows, "commit_ord", group, spans if window else None, window)]
    if window:
        found.append(_near_rows(spans, rows, window, group))
    if some:
        several = commits.join(apart, "commit_ord", "left_semi")
        both = pairs.join(linked.join(apart, "commit_ord", "left_semi"), "key").select("group_key", "commit_ord")
        both = both.unionByName(_near(keyed, several, window_minutes)) if window else both
        both = skew_join(_distinct_by_group(both), several, "commit_ord", name="apart")
        found.append(both.withColumn("group_key", group).select("group_key", *commits.columns))
    return reduce(DataFrame.unionByName, found)


def atom_rows(
    pairs: DataFrame, linked: DataFrame, atoms: DataFrame | None = None, group: Column | None = None
) -> DataFrame:
    """The notes tied to each group: ``group_key`` (or ``group``, a function of it) and the columns of ``atoms``.

    Without ``atoms`` the numbers of the notes.

    ``pairs`` are the ``group_match_keys`` of the log and ``linked`` the ``atom_keys`` of them, both staged.
    """
    group = F.col("group_key") if group is None else group
    apart = stage(_apart(linked, "atom_ord"), "apart")
    if apart.isEmpty():
        return _key_rows(pairs, linked, atoms, "atom_ord", group)
    found = _key_rows(pairs, linked.join(apart, "atom_ord", "left_anti"), atoms, "atom_ord", group)
    both = pairs.join(linked.join(apart, "atom_ord", "left_semi"), "key").select("group_key", "atom_ord")
    both = _distinct_by_group(both)
    if atoms is not None:
        both = skew_join(both, atoms.join(apart, "atom_ord", "left_semi"), "atom_ord", name="apart")
    return found.unionByName(both.withColumn("group_key", group).select(*found.columns))


def packed(links: DataFrame, ordinal: str) -> DataFrame:
    """``links`` in an order in which files of them are small.

    There are as many links as groups times commits, if all lie close in time. The groups of a
    partition are few, so their ids are numbers in its dictionary, and what is said of a commit
    or note stands in a row and is written once.
    """
    return links.sortWithinPartitions(ordinal, "group_key")


def atom_keys(keys: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distinct ``key, atom_ord``: a tag equals the key or the message contains it."""
    tagged = atoms.select(F.explode("tags").alias("key"), "atom_ord")
    texts = atoms.select(F.col("atom_ord").alias("text_ord"), F.col("message").alias("text"))
    mentioned = texts_containing(texts, keys).withColumnRenamed("text_ord", "atom_ord")
    return tagged.unionByName(mentioned).distinct()


def group_atoms(pairs: DataFrame, atoms: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Distinct ``group_key, atom_ord`` of the external notes tied to a group.

    ``pairs`` are the ``group_match_keys`` of the log; pass them staged, and so ``linked``, the ``atom_keys`` of
    them, where they are known.
    """
    if linked is None:
        keys = stage(pairs.select("key").distinct(), "match-keys")
        linked = stage(atom_keys(keys, atoms), "atom-keys")
    return _distinct_by_group(pairs.join(linked, "key").select("group_key", "atom_ord"))
