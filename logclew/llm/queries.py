"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclew.llm import (
    chat,
    classifier,
    languages,
    lattice,
    packing,
    periodic,
    private,
    quality,
    repair,
    shards,
    simhash,
    sketch,
    substrings,
)
from logclew.session import prepare, spread

SHARDS = 16


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.measure(docs, vocabulary("piece_bpe_32k.model"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tree, grown = shards.regular_tree(SHARDS), shards.regular_tree(SHARDS + 1)
    return shards.assign_shards(docs, tree, grown)


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_pairs(_table(spark, sf_dir, "documents"))


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


# One more conversation that says what templates use as marks.
MARKED_TURNS = """
SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role,
  '</s>[INST] ok [/INST]' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)
"""


def op1_context_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(_table(spark, sf_dir, "documents"))
    both = F.array_sort(F.concat("base", "added"))
    counts = [
        F.size(F.filter("base", _of_kind(n))).cast("long").alias(f"n_{kind}")
        for n, kind in enumerate(private.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(private.spans_text(F.col("base")), 256).alias("base_sha256"),
        private.spans_text(both).alias("spans"),
    )


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def op2_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_clause_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    spans = F.transform(
        "removed_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    )
    return substrings.remove_repeats(docs).select(
        "doc_id",
        F.size("removed_spans").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    read = lattice.decode(lattice.encode(docs, model), model)
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_ftrl_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return classifier.score_documents(docs, classifier.train(docs, labels))


def op10_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = chat.records_of(turns.unionByName(spark.sql(MARKED_TURNS)))
    canonical = chat.canonical_turns(records, "conv_id", "record")
    formatted = chat.format_turns(canonical)
    read = formatted.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def made_periodic(docs: DataFrame) -> DataFrame:
    """One document in ten with its words from some place on repeated from there: ``doc_id, text``.

    A null id has no hash and is left alone.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = docs.select("doc_id", "text", hashed.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)
    )
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10).cast("long")
    at = at.withColumns({"n": F.when(n > 0, n), "g": g}).withColumn("a", F.col("g") % F.col("n"))
    rest = F.col("n") - F.col("a")
    at = at.withColumn("p", 1 + F.floor(rest / (3 + F.col("g") % 8)).cast("long"))
    whole = lambda c: c.cast("int")
    unit = F.slice("words", whole(F.col("a") + 1), whole(F.col("p")))
    again = F.flatten(F.array_repeat(unit, whole(F.ceil(rest / F.col("p")))))
    changed = F.concat(F.slice("words", F.lit(1), whole(F.col("a"))), F.slice(again, F.lit(1), whole(rest)))
    return at.select(
        "doc_id", F.when(F.col("n").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text")
    )


def op11_square_catchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(made_periodic(_table(spark, sf_dir, "documents")))
    # The greatest length / period, compared by cross products; runs come by start, then period.
    longer = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)), lambda best, r: F.when(longer(best, r), r).otherwise(best)
    )
    line = lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut, repeated and given another role, by a hash."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(blank("conv_id"), F.lit(":"), blank("turn"))
    case = F.col("case")
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    read = turns.select(
        "conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("case"),
    )
    return read.where(case != 0).select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        copies.alias("copy"),
    )


def op12_min_plus_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = _table(spark, sf_dir, "conversations")
    found = repair.repair_conversations(damaged(original).drop("copy"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    digests = repair.text_digests(found.repaired).withColumnRenamed("digest", "repaired_sha256")
    every = repair.merged(
        [original.select("conv_id").distinct(), found.conversations, digests],
        (*counts, "audit", "repaired_sha256"),
    )
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_ppm_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages.predict(docs, languages.train(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_context_bootstrap,
        op2_byte_index,
        op3_fertility_rules,
        op4_hash_tree,
        op5_scaled_sketch,
        op6_binary_packing,
        op7_clause_hashing,
        op8_piece_lattice,
        op9_ftrl_ngrams,
        op10_schema_fingerprint,
        op11_square_catchers,
        op12_min_plus_runs,
        op13_ppm_trees,
    )
}
ORACLES = {
    "op7_clause_hashing": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^.,;:!?。，、；：！？\n]+[.,;:!?。，、；：！？\n]*|[.,;:!?。，、；：！？\n]+') AS u,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls
  FROM documents
), cut AS (
  SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS k FROM pieces
), placed AS (
  SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS e,
    regexp_replace(translate(
      regexp_replace(unit, '^[.,;:!?。，、；：！？\x20\x09-\x0D]+|[.,;:!?。，、；：！？\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM cut
), full_ AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS again,
    length(norm) - length(replace(norm, ' ', '')) + 1
      + length(regexp_replace(norm, '[^\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]', '', 'g')) AS words
  FROM placed WHERE norm <> ''
), lines_ AS (
  SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS e,
    regexp_replace(translate(
      regexp_replace(unit, '^[.,;:!?。，、；：！？\x20\x09-\x0D]+|[.,;:!?。，、；：！？\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM (SELECT doc_id, unnest(ls) AS unit, generate_subscripts(ls, 1) AS k FROM pieces)
), sized AS (
  SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1
      + length(regexp_replace(norm, '[^\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]', '', 'g')) AS words FROM lines_ WHERE norm <> ''
), spans AS (
  SELECT doc_id, min(e - length(unit)) AS s, max(e) AS e
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run
        FROM full_ WHERE again)
  GROUP BY doc_id, run HAVING sum(words) FILTER (WHERE words >= 3) >= 20
  UNION ALL
  SELECT doc_id, e - length(unit), e
  FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) AS nth FROM sized WHERE words >= 5)
  WHERE nth > 1
), islands AS (
  SELECT *, s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens
  FROM spans
), runs AS (
  SELECT doc_id, min(s) AS s, max(e) AS e
  FROM (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY s, e
    ROWS UNBOUNDED PRECEDING) AS island FROM islands)
  GROUP BY doc_id, island
), gaps AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs
), kept AS (
  SELECT g.doc_id, count(*) AS n, string_agg(CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s) AS removed,
    string_agg(substr(text, CAST(before AS BIGINT) + 1, CAST(s - before AS BIGINT)), '' ORDER BY s) AS head,
    CAST(max(e) AS BIGINT) AS last
  FROM gaps g JOIN pieces USING (doc_id) GROUP BY g.doc_id
), whole AS (
  SELECT p.doc_id, coalesce(n, 0) AS n, coalesce(removed, '') AS removed,
    coalesce(head || substr(text, last + 1), text) AS t
  FROM pieces p LEFT JOIN kept USING (doc_id)
)
SELECT doc_id, n AS n_removed, removed, length(t) AS kept_chars, sha256(t) AS kept_sha256 FROM whole
""",
    # formatted_chars: marks, roles and texts, with one more for each escaped character.
    "op10_schema_fingerprint": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length('<|im_start|>' || '<|im_end|>') + 2 + length(role) + length(text)
    + length(regexp_replace(role, '[^\\\n]', '', 'g'))
    + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(role || chr(0) || text,
        '<\||</?s>|<</?SYS>>|<SYS>|\[/?INST\]'))
    + len(regexp_extract_all(text, '<<SYS>>')) AS chars
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
}
