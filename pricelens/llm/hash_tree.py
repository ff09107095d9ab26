"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards gives each shard a weight; a rack weighs what its shards weigh, a
region what its racks weigh. A key descends from the root: at each node every child draws a number from
the hash of the key and the child's name, exponential with the child's weight as its rate, and the least
draw wins. So each child is chosen in proportion to its weight, and by its own draw alone: when weights
change, no key moves between children whose weights stay, and nothing below a node whose subtree stays
is drawn anew. ``grown`` adds a shard as a region of its own. Only that region's draw is new at the root,
so it takes keys only into itself, from any tree.

Placing is a native expression over a table of the tree's children, which is part of the plan: it grows
with the number of shards, not with the rows. Rows are numbered within their shard without gathering a
shard anywhere: they are sorted by range, and what numbers each range needs is its size in each shard.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import buckets_for, documents, stored

#: Region -> rack -> shard number -> weight.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Where monotonically_increasing_id keeps the row number within its partition.
_ROW_BITS = (1 << 33) - 1


def tree_of(shards: int, per_rack: int = 2, racks: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """A tree of equal weights, filled rack by rack and region by region."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        rack = shard // per_rack
        out.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return out


def grown(tree: Tree, weight: float = 1.0) -> dict[str, Mapping[str, Mapping[int, float]]]:
    """The tree with one more shard, the next number, in a region and rack of its own."""
    shard = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    name = next(n for n in (f"region+{k}" for k in range(len(tree) + 1)) if n not in tree)
    return {**tree, name: {f"rack+{shard}": {shard: weight}}}


def _children(tree: Tree) -> list[list[tuple[str, float, int]]]:
    """For each inner node its children as (name, weight, node number or shard), the root first. Children without
    weight take nothing and are left out."""
    weight = lambda racks: sum(w for shards in racks.values() for w in shards.values())
    flat = [w for racks in tree.values() for shards in racks.values() for w in shards.values()]
    names = [s for racks in tree.values() for shards in racks.values() for s in shards]
    if len(names) != len(set(names)) or any(w < 0 for w in flat) or not any(flat):
        raise ValueError("shards must differ, weights must not be negative, and one must be positive")
    root, regions, racks_of = [], [], []
    alive = [(region, racks) for region, racks in sorted(tree.items()) if weight(racks) > 0]
    for region, racks in alive:
        root.append((region, float(weight(racks)), 1 + len(regions)))
        regions.append([])
        for rack, shards in sorted(racks.items()):
            if sum(shards.values()) > 0:
                regions[-1].append((f"{region}/{rack}", float(sum(shards.values())), 1 + len(alive) + len(racks_of)))
                racks_of.append([(f"{region}/{rack}/{s}", float(w), s) for s, w in sorted(shards.items()) if w > 0])
    return [root, *regions, *racks_of]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a 64-bit integer key. A null key draws by the names alone, so all of them share one shard."""

    def child(name: str, weight: float, to: int) -> Column:
        return F.struct(F.xxhash64(F.lit(name)).alias("name"), F.lit(weight).alias("weight"), F.lit(to).alias("to"))

    table = F.array(*[F.array(*[child(*c) for c in children]) for children in _children(tree)])

    def draw(child: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11) + F.lit(1)) * F.lit(2.0**-53)
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["to"].alias("to"))

    at = F.lit(0)
    for _ in ("region", "rack", "shard"):
        at = F.array_min(F.transform(F.get(table, at), draw))["to"]
    return at


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, their place from 0 without gaps within their ``shard``, in the given order. Rows that are
    equal in it may change places."""
    parts = buckets_for(rows, 64)
    sorted_rows = rows.repartitionByRange(parts, "shard", *order).sortWithinPartitions("shard", *order)
    row = F.monotonically_increasing_id()
    ranged = stored(sorted_rows.withColumns({"part": F.shiftright(row, 33), "row": row.bitwiseAND(F.lit(_ROW_BITS))}), "ranges")
    # One row for each range and each shard in it: as ranges follow each other, no more than both together.
    shares = ranged.groupBy("part", "shard").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("share"))
    before = F.sum("share").over(Window.partitionBy("shard").orderBy("part")) - F.col("share")
    starts = shares.select("part", "shard", (before - F.col("first")).alias("start"))
    return ranged.join(F.broadcast(starts), ["part", "shard"]).withColumn("slot", F.col("row") + F.col("start")).drop("part", "row", "start")


def placed(docs: DataFrame, tree: Tree, after: Tree | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``size`` (bytes of the text and one), ``text_crc32``, ``shard``, ``slot``, and with
    ``after`` the ``grown_shard`` it has in that tree.

    The id alone decides the shard: repeated ids and rows without one (null) stay together. A null text has size 1 and
    the crc32 of no bytes. Slots follow ``doc_id`` (null first), then crc and size. An empty table gives no row;
    other columns are not read.
    """
    own = documents(docs)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = own.select(
        "doc_id",
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        (shard_of(F.col("doc_id"), after) if after else F.lit(None)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("spread"),
    )
    # Written first, so that finding the ranges does not read the texts again, and equal rows can be spread.
    out = numbered(stored(rows, "placed"), ["doc_id", "text_crc32", "size", "spread"])
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def shards_and_growth(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's columns for equal shards, and for one more."""
    tree = tree_of(shards)
    return placed(docs, tree, grown(tree)).withColumn("law", F.lit("key"))
