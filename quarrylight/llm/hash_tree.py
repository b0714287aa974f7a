"""Sharding by a hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At each level every child draws ``-ln(u) / weight`` with ``u`` a hash of (key, child) in (0, 1); the smallest draw
wins. A child's share is its weight, and a child whose weight does not change draws what it drew before. So a changed
weight moves rows only into or out of the subtrees on its path. A shard that is added as a region of its own
(:func:`grown`) takes rows only into itself, and no other row moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import let, numbered, salted, staged, text_of

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]


def tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, weight: float = 1.0) -> list[Leaf]:
    """``shards`` leaves of equal weight, filled rack by rack."""
    per_region = racks_per_region * shards_per_rack
    return [(s // per_region, s // shards_per_rack, s, weight) for s in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region: rows move only into it."""
    new = max((x[2] for x in leaves), default=-1) + 1
    region = max((x[0] for x in leaves), default=-1) + 1
    rack = max((x[1] for x in leaves), default=-1) + 1
    return [*leaves, (region, rack, new, weight)]


def _draw(key: Column, children: Column) -> Column:
    """The child with the smallest weighted draw; ``children``: array of (node, weight, salt)."""

    def score(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["salt"]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["node"].alias("node"))

    return F.array_min(F.transform(children, score))["node"]


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of ``key``. Weights of 0 get nothing; a tree without weight is refused."""
    live = [x for x in leaves if x[3] > 0]
    if not live:
        raise ValueError("the tree has no shard with a weight")
    levels: list[dict[int, dict[int, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in live:
        for level, parent, node in ((0, -1, region), (1, region, rack), (2, rack, shard)):
            at = levels[level].setdefault(parent, {})
            at[node] = at.get(node, 0.0) + weight
    at: Column = F.lit(-1)
    for name, level in zip(("region", "rack", "shard"), levels, strict=True):
        pairs: list[Column] = []
        for parent, nodes in sorted(level.items()):
            kids = [F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight"), F.lit(f"{name}/{n}").alias("salt")) for n, w in sorted(nodes.items())]
            pairs += [F.lit(parent), F.array(*kids)]
        children = F.create_map(*pairs)
        at = let(at, lambda parent: _draw(key, F.element_at(children, parent)))  # noqa: B023
    return at.cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """``key``, size, text_crc32, law ('key'), shard, slot and grown_shard for every row.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none); ``slot`` is gapless from 0 in each shard;
    ``grown_shard`` is the shard with one more. Only the key and the tree decide, so equal keys (null is one) share
    a shard and repeated rows get slots of their own. Empty tables give no rows; other columns are ignored. Texts
    are read once and never shuffled: what moves is one narrow row for each document.
    """
    leaves = tree(shards)
    k = F.col(key)
    narrow = docs.select(
        k,
        (F.octet_length(text_of(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(k, leaves).alias("shard"),
        shard_of(k, grown(leaves)).alias("grown_shard"),
    )
    narrow = staged(salted(narrow, "_salt"), "shards")
    return numbered(narrow, ["shard"], [key, "text_crc32", "size", "_salt"], "slot", rows_per_bucket).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
