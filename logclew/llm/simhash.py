"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are compared as 8 bytes at 8 positions. If at most 3 bits
differ, at most 3 bytes do, so a pair shares 5 positional bytes or more. Postings of one
byte would hold 1/256 of all fingerprints each, so the index is over four positional
bytes at once: the 14 blocks of the Steiner system S(3, 4, 8). Whatever 3 positions
differ lie in a block, hence the complement, a block too, holds 4 that agree: every
pair with the guaranteed minimum of 5 shares a posting. Within a posting the shared
positional bytes of each pair are tallied, pairs below the minimum go, and the rest are
verified by their differing bits. A posting gives a spanning forest of its links, never
its pairs.

Postings of more than ``MAX_POSTING`` different fingerprints are not compared in a task.
Their fingerprints meet by codes instead: each is sent to all codes within 1 bit
and within 2 bits. Two fingerprints differ in at most 3 bits exactly if a code is within 1
of one and 2 of the other, and all that are within 2 of a code link to the ones within
1. So a star around a least one within 1 gives every link, in a number of rows that is
proportional to the fingerprints.

Equal fingerprints are one node from the start, so copies cost nothing.

Nulls: a null text is empty; no words give fingerprint 0, linked like any other. A
null id takes part in links but never names a component unless it has no other. Ties:
the least id names a component; repeated rows share it, and ``keep_first`` keeps one of
them. Texts are read whole. Other columns are ignored by ``near_duplicates`` and
kept by ``keep_first``. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import free_name, id_field, map_batches, text_or_empty
from logclew.llm.components import component_roots
from logclew.session import stage

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
MAX_POSTING = 4096

# Four positions whose numbers, written with 3 bits, cancel out.
BLOCKS = [
    block
    for block in itertools.combinations(range(8), 4)
    if block[0] ^ block[1] ^ block[2] ^ block[3] == 0
]


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, space-joined; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(data, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    hashes = [digest(data[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is set if it is in more than half of the shingles' hashes. Signed."""
    hashes = shingle_hashes((text or "").encode("utf-8").lower().split(), SHINGLE)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fingerprint (as a signed number) of each row."""
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("text_hash", T.LongType()),
            T.StructField("fingerprint", T.LongType()),
        ]
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array(map(fingerprint, batch.column(2).to_pylist()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), made], names=schema.names
        )

    text = F.col(text_col).cast("string")
    return map_batches(docs.select(F.col(id_col), F.xxhash64(text_or_empty(text_col)), text), rows, schema)


def _postings(prints: DataFrame) -> DataFrame:
    """(block, bytes, fp): the fingerprint under each of its 14 index entries."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]

    def entry(n: int, block: tuple[int, ...]) -> Column:
        value = F.lit(n).cast("long")
        for i in block:
            value = F.shiftleft(value, 8).bitwiseOR(byte[i])
        return value

    entries = F.array(*[entry(n, block) for n, block in enumerate(BLOCKS)])
    return prints.select(F.explode(entries).alias("entry"), "fp")


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is within ``MAX_BITS`` among different fingerprints.

    Each search step compares a front of members with those not reached yet.
    """
    rest, links = np.sort(members), []
    while len(rest) > 1:
        root, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for one in front:
                differ = rest ^ one
                shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                near |= (shared >= MIN_BYTES) & (np.bitwise_count(differ) <= MAX_BITS)
            front, rest = rest[near], rest[~near]
            links += [(int(root), int(x)) for x in front.view(np.int64)]
    return [(np.uint64(a).astype(np.int64).item(), b) for a, b in links]


def _posting_links(postings: DataFrame) -> DataFrame:
    """Links of postings, each a list of at most ``MAX_POSTING`` fingerprints."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for members in batch.column(0).to_pylist():
            found += forest(np.array(members, np.int64).view(np.uint64))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
        )

    return map_batches(postings, rows, "a long, b long")


def _code_links(prints: DataFrame) -> DataFrame:
    """Links of any number of different fingerprints through codes near both."""
    bit = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    ones = F.array(F.lit(0).cast("long"), *[F.lit(b).cast("long") for b in bit])
    one = prints.select("fp", F.explode(ones).alias("flip"))
    near = one.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("code"))
    least = near.groupBy("code").agg(F.min("fp").alias("least"))
    two = one.select("fp", F.explode(ones).alias("second"), "flip")
    reach = two.select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseXOR(F.col("second")).alias("code")
    )
    return reach.join(least, "code").select(F.col("least").alias("a"), F.col("fp").alias("b"))


def find_links(prints: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """Links (a, b) that connect all of ``prints`` (column fp, distinct) within 3 bits."""
    postings = _postings(prints)
    sizes = postings.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(postings.join(sizes, "entry"), "postings")
    small = shared.where(F.col("n") <= max_posting).groupBy("entry")
    links = _posting_links(small.agg(F.collect_list("fp").alias("fps")).select("fps"))
    crowded = stage(shared.where(F.col("n") > max_posting).select("fp").distinct(), "crowded")
    return links if crowded.isEmpty() else links.unionByName(_code_links(crowded))


def with_components(prints: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with ``root``, the least fingerprint of its
    component, and ``component_id``, the least id in it."""
    nodes = stage(
        prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least_id")),
        "fingerprints",
    )
    roots = component_roots(find_links(nodes.select("fp"), max_posting))
    rooted = nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("r")), "fp", "left")
    rooted = rooted.select("fp", F.coalesce("r", "fp").alias("root"), "least_id")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.select(F.col("fp").alias("fingerprint"), "root").join(named, "root")
    return prints.join(stage(classes, "classes"), "fingerprint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_posting: int = MAX_POSTING,
) -> DataFrame:
    """One row per document: its fingerprint in hex and its component."""
    prints = stage(fingerprints(docs, id_col, text_col).drop("text_hash"), "prints")
    return with_components(prints, max_posting).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least id (then text hash) of every component, with all its columns.

    Rows are named by id and text hash. Rows that repeat both are few or many alike: they
    are merged by an aggregate with partial results.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "prints")
    name = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    kept = (
        with_components(prints).groupBy("root").agg(F.min(name).alias("first")).select("first.*")
    )
    repeated = (
        prints.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    same = F.col("k.doc_id").eqNullSafe(F.col("r.doc_id")) & (
        F.col("k.text_hash") == F.col("r.text_hash")
    )
    kept = stage(
        kept.alias("k")
        .join(repeated.alias("r"), same, "left")
        .select("k.doc_id", "k.text_hash", F.col("r.n").isNotNull().alias("repeated")),
        "kept",
    )
    mark = free_name(docs, "_text_hash")
    marked = docs.withColumn(mark, F.xxhash64(text_or_empty(text_col))).alias("d")

    def rows(names: DataFrame) -> DataFrame:
        on = F.col(f"d.{id_col}").eqNullSafe(F.col("k.doc_id")) & (
            F.col(f"d.{mark}") == F.col("k.text_hash")
        )
        return marked.join(names.alias("k"), on, "left_semi")

    once = rows(kept.where("NOT repeated"))
    again = rows(stage(kept.where("repeated"), "repeated"))
    return once.unionByName(again.dropDuplicates([id_col, mark])).drop(mark)
