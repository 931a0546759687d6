"""Hierarchical weighted hash tree: rows descend region, rack and shard by hash draws.

At each node every child draws ``-ln(u) / weight`` for a row, ``u`` being the row's hash with
that child and the weight the sum of the shards below it; the row goes to the child of the
smallest draw. Exponential draws share rows in proportion to the weights, and a child's
draw changes only with its own weight. So a change moves rows only into or out of the subtrees whose
weights change, level by level: regions that keep their weight exchange no rows, nor do racks of
a region, nor shards of a rack. A row costs as many hashes as the nodes on its
way have children. A shard that opens a region of its own takes rows only into itself
(from 16 to 17 shards of ``regular_tree``, for instance); one that joins a rack also draws rows
into its region and rack, some of which go to the other shards there.

Ties (equal draws) go to the child listed first. Nulls: a null id is replaced by the hash of the
text; a null text has no bytes. Rows with equal ids go to one shard, repeated rows too, each with a slot
of its own. A text is only measured and hashed, whatever its length. Other columns of the input
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclew.llm.batches import number_rows, text_or_empty

# 2^52: hashes are cut to as many values, which doubles hold exactly.
_UNIT = float(1 << 52)


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree, named by its path and number, with its capacity."""

    region: int
    rack: int
    number: int
    weight: float = 1.0


def regular_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Shards 0 to ``shards`` - 1 of weight 1, filling rack after rack, region after region."""
    per_region = per_rack * racks_per_region
    return [Shard(n // per_region, n // per_rack, n) for n in range(shards)]


def _draw(key: Column, path: tuple[int, ...], weight: float) -> Column:
    """The draw of the child at ``path``, which names it from the root on."""
    hashed = F.xxhash64(key, *[F.lit(n) for n in path])
    bits = F.shiftrightunsigned(hashed, 12).cast("double")
    return -F.ln((bits + F.lit(0.5)) / F.lit(_UNIT)) / F.lit(weight)


def _descend(key: Column, shards: Sequence[Shard], path: tuple[int, ...] = ()) -> Column:
    """The shard that ``key`` reaches from the node at ``path``, which has ``shards`` below it."""
    if len(path) == 3:
        return F.lit(shards[0].number)
    below: dict[int, list[Shard]] = {}
    for s in shards:
        below.setdefault((s.region, s.rack, s.number)[len(path)], []).append(s)
    if len(below) == 1:
        return _descend(key, shards, (*path, *below))
    children = [((*path, child), some) for child, some in below.items()]
    draws = [
        F.struct(_draw(key, to, sum(s.weight for s in some)).alias("draw"), F.lit(n).alias("n"))
        for n, (to, some) in enumerate(children)
    ]

    def further(chosen: Column) -> Column:
        way = F.when(chosen == 0, _descend(key, children[0][1], children[0][0]))
        for n, (to, some) in enumerate(children[1:], 1):
            way = way.when(chosen == n, _descend(key, some, to))
        return way

    # Bound to a name, so that the draws are made once; only the way that the row goes is followed.
    least = F.array(F.array_min(F.array(*draws))["n"])
    return F.get(F.transform(least, further), F.lit(0))


def place(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard number that ``key`` descends to."""
    if len({s.number for s in tree}) < len(tree):
        raise ValueError("every shard has a number of its own")
    return _descend(key, tree)


def assign_shards(
    docs: DataFrame,
    tree: Sequence[Shard],
    grown: Sequence[Shard],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each row's size, checksum, shard, slot in the shard, and shard in the grown tree."""
    if any(s.weight <= 0 for s in (*tree, *grown)):
        raise ValueError("weights are above 0")
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("_key"),
    )
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        place(F.col("_key"), tree).alias("shard"),
        place(F.col("_key"), grown).alias("grown_shard"),
    )
    numbered = number_rows(placed, "shard", "shards", "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
