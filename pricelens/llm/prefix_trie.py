"""The trie of all conversation prefixes, by ROLLUP over positional turn columns.

Turns get a 128-bit id of role and text. A conversation becomes rows of ``WIDTH`` positional columns, one
row for each block of turns, and each row knows the node its block starts from: the exclusive-or of the
ids of all earlier turns, each mixed with its place. ``GROUP BY start, ROLLUP(t1, ..., t8)`` then makes
every prefix that ends in a block at once, and ``grouping_id`` tells its length. A block's nodes hang on
the last node of the block before, so a conversation may have any number of blocks.

What a node says of its whole subtree is a sum over its members as well. Each node belongs to its least
member, so the nodes on a conversation's path that belong to it are the last ones: one number for each
conversation, ``owned_from``, tells which. A first ROLLUP finds the owners, a second one adds up. A
conversation's owned bytes, owned leaf and owned children then count once in every node above them.

No step holds a conversation or a node's members at one place. Turns are numbered over a range
partitioning, so a conversation with a third of all turns is spread; what follows is keyed by stretches
of its blocks. Members are counted in partial sums. The digest of a node's ending conversations, which is
sequential by nature, streams over pieces of the sorted id list.

Rows without ``conv_id`` belong to no conversation and are left out. Turns come in order of ``turn`` (null
first), equal ones in order of role and text, so repeated rows are repeated turns; null role or text is
empty. An empty table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import buckets_for, stored

#: Turns of a block (positional columns), and blocks of a stretch that is handled together.
WIDTH, STRETCH = 8, 512
#: Turns of a numbered chunk, and bytes of a piece of an id list.
CHUNK, PIECE = 64, 1 << 16
#: Most rows of a broadcast: parents with more children than this share of all nodes.
HOT_PARENTS = 1000
#: A conversation takes its first turns from the first conversation of its group of so many ids, fewer than MOST_SHARED + 1.
GROUP, MOST_SHARED = 5, 8

_TURN = "struct<a: long, b: long, bytes: long>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _clean(conversations: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.where("conv_id IS NOT NULL")


def turn_id(role: Column, text: Column) -> Column:
    """The two halves of a turn's id, and the bytes of its text."""
    a, b = F.xxhash64(role, text), F.xxhash64(F.lit(1), text, role)
    return F.struct(a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("bytes"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to rows of at most ``CHUNK`` turns, numbered within the partition's share of the conversation."""
    part, conv, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        edges = np.flatnonzero(np.diff(ids)) + 1
        opens = np.concatenate([[0], edges])
        offset = np.arange(len(ids)) - np.repeat(opens, np.diff(np.append(opens, len(ids))))
        if len(ids) and ids[0] == conv:
            offset[: edges[0] if len(edges) else len(ids)] += seen
        if not len(ids):
            continue
        conv, seen = ids[-1], int(offset[-1]) + 1
        first = np.flatnonzero((offset % CHUNK == 0) | np.isin(np.arange(len(ids)), opens))
        turns = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), batch.column("turn"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), part), pa.int32()), pa.array(ids[first]), pa.array(offset[first].astype(np.int64)), turns],
            ["part", "conv_id", "first", "turns"],
        )


def numbered(conversations: DataFrame) -> DataFrame:
    """Chunks of successive turns: ``conv_id``, ``first`` (place of the chunk's first turn in the share of
    partition ``part``), ``turns``; written, because the places hold for this partitioning only.

    Ranges are cut at ids, turn numbers and the beginnings of role and text, so that the sample that
    bounds them stays small; where those are equal the rows meet in one sort, which spills.
    """
    rows = _clean(conversations)
    short = F.when(F.length("role") <= 32, F.left("text", F.lit(64)))
    ranges = (F.col("conv_id"), F.col("turn"), F.left("role", F.lit(32)), short.asc_nulls_last())
    parts = buckets_for(rows, 32)
    sorted_rows = rows.repartitionByRange(parts, *ranges).sortWithinPartitions("conv_id", "turn", "role", "text")
    flat = sorted_rows.select("conv_id", turn_id(F.col("role"), F.col("text")).alias("turn"))
    return stored(flat.mapInArrow(_chunks, f"part int, conv_id long, first long, turns array<{_TURN}>"), "turns")


def _shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def placed(chunks: DataFrame, rebuild: bool) -> DataFrame:
    """One row for each turn of each conversation: ``conv_id``, ``n`` (turns in all), ``pos`` (from 0), ``turn``;
    a conversation without turns has one row with null ``pos``.

    With ``rebuild`` a conversation ``c`` takes its first ``crc32(c) % 9`` turns from conversation ``c - c % 5``
    (the remainder has the sign of ``c``), all of them if it has fewer, and goes on with its own turns after as many.
    """
    by_conv = Window.partitionBy("conv_id")
    shares = (
        chunks.groupBy("conv_id", "part")
        .agg(F.sum(F.size("turns")).alias("share"))
        .withColumns({"own": F.sum("share").over(by_conv), "before": F.sum("share").over(by_conv.orderBy("part")) - F.col("share")})
    )
    shares = stored(shares, "shares")
    convs = shares.where("before = 0").select("conv_id", "own")
    if rebuild:
        of = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
        convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(of, "base", "left")
        asked = _shared_turns(F.col("conv_id"))
        convs = convs.withColumns({"asked": asked, "taken": F.least(asked, F.coalesce("base_own", F.lit(0)))})
    else:
        convs = convs.withColumns({"base": F.col("conv_id"), "asked": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    convs = stored(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("asked"), F.lit(0))), "convs")

    # A share is at most one partition's, so no key of this join is larger than that.
    known = shares.select("conv_id", "part", "before").join(convs, "conv_id")
    chunks = chunks.join(known, ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("first"))
    turns = chunks.select("conv_id", "n", F.posexplode("turns").alias("i", "turn"), "at", "asked", "taken")
    own = turns.withColumn("place", F.col("at") + F.col("i")).where("place >= asked")
    rows = own.select("conv_id", "n", (F.col("place") - F.col("asked") + F.col("taken")).alias("pos"), "turn")
    if rebuild:
        # The first turns of a base stand in at most MOST_SHARED chunks, and serve the few ids of its group.
        openings = chunks.where((F.col("at") < MOST_SHARED) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), "at", "turns")
        heads = openings.join(convs.where("taken > 0").select("base", "conv_id", "n", "taken"), "base")
        head = heads.select("conv_id", "n", "taken", F.posexplode("turns").alias("i", "turn"), "at").withColumn("pos", F.col("at") + F.col("i"))
        rows = rows.union(head.where("pos < taken").select("conv_id", "n", "pos", "turn"))
    turnless = convs.where("n = 0").select("conv_id", "n", F.lit(None).cast("long"), F.lit(None).cast(_TURN))
    return rows.union(turnless)


def _mixed(turn: Column, pos: Column) -> tuple[Column, Column]:
    """Two numbers for a turn at a place; those of a path's turns are combined by exclusive or."""
    a, b = turn["a"], turn["b"]
    mix = lambda *x: F.when(a.isNotNull(), F.xxhash64(*x)).otherwise(F.lit(0))
    return mix(pos, a, b), mix(b, pos, a)


def _xor(values: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), values)


def paths(turns: DataFrame, width: int = WIDTH, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Blocks and stretches of the conversations.

    A block: ``conv_id``, ``n``, ``stretch``, ``block``, ``t1`` .. (turns by position), ``x1``, ``x2`` (the node it
    starts from) and ``bytes_before``. A stretch of blocks: ``conv_id``, ``stretch``, ``total`` (the conversation's bytes).
    """
    # xxhash64 tells int from long, so every place is a long.
    pos = F.coalesce("pos", F.lit(0)).cast("long")
    rows = turns.withColumns({"block": F.floor(pos / width), "stretch": F.floor(pos / (width * stretch)), "pos": pos, "turn": "turn"})
    m1, m2 = _mixed(F.col("turn"), F.col("pos"))
    keyed = rows.repartition("conv_id", "stretch")  # blocks and stretches are grouped within this
    blocks = keyed.groupBy("conv_id", "stretch", "block").agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("row"),
        F.bit_xor(m1).alias("own1"),
        F.bit_xor(m2).alias("own2"),
        F.coalesce(F.sum("turn.bytes"), F.lit(0)).alias("own_bytes"),
    )
    within = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda agg, name, window: F.coalesce(agg(name).over(window), F.lit(0))
    blocks = blocks.select(
        "conv_id",
        "stretch",
        "block",
        "n",
        *[F.get("row", F.lit(k))["turn"].alias(f"t{k + 1}") for k in range(width)],
        of(F.bit_xor, "own1", within).alias("in1"),
        of(F.bit_xor, "own2", within).alias("in2"),
        of(F.sum, "own_bytes", within).alias("in_bytes"),
    )
    sums = keyed.groupBy("conv_id", "stretch").agg(F.bit_xor(m1).alias("s1"), F.bit_xor(m2).alias("s2"), F.coalesce(F.sum("turn.bytes"), F.lit(0)).alias("s_bytes"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stored(
        sums.select(
            "conv_id",
            "stretch",
            F.sum("s_bytes").over(whole).alias("total"),
            of(F.bit_xor, "s1", before).alias("from1"),
            of(F.bit_xor, "s2", before).alias("from2"),
            of(F.sum, "s_bytes", before).alias("from_bytes"),
        ),
        "stretches",
    )
    started = blocks.join(stretches.drop("total"), ["conv_id", "stretch"]).withColumns(
        {
            "x1": F.col("in1").bitwiseXOR(F.col("from1")),
            "x2": F.col("in2").bitwiseXOR(F.col("from2")),
            "bytes_before": F.col("in_bytes") + F.col("from_bytes"),
        }
    )
    kept = ["conv_id", "n", "stretch", "block", *[f"t{k + 1}" for k in range(width)], "x1", "x2", "bytes_before"]
    return stored(started.select(kept), "blocks"), stretches.select("conv_id", "stretch", "total")


def _rolled_up(blocks: DataFrame, aggregates: dict[str, str], width: int) -> DataFrame:
    """Every prefix that ends in a block, with the aggregates over its members, its ``depth`` and ``level`` in the
    block. A level holds only members with a turn there, and level 0 is the last one of the block before."""
    turns = [f"t{k + 1}" for k in range(width)]
    level = f"{width} - bit_count(grouping_id() & {(1 << width) - 1})"
    wanted = " ".join(f"WHEN {k + 1} THEN t{k + 1} IS NOT NULL" for k in range(width))
    query = f"""
        SELECT *, block * {width} + level AS depth FROM (
            SELECT x1, x2, block, {", ".join(turns)}, {level} AS level, MIN(bytes_before) AS bytes_before,
                   {", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())}
            FROM {{blocks}}
            GROUP BY x1, x2, block, ROLLUP({", ".join(turns)})
        ) WHERE CASE level WHEN 0 THEN block = 0 {wanted} END
    """
    return blocks.sparkSession.sql(query, blocks=blocks)


def _bytes_above(width: int) -> Column:
    """Bytes of the turns on a node's path above its own."""
    lengths = [F.when(F.col("level") > k + 1, F.col(f"t{k + 1}.bytes")).otherwise(F.lit(0)) for k in range(width - 1)]
    return reduce(lambda x, y: x + y, lengths, F.col("bytes_before"))


def owners(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of each conversation that is the least member of a node: ``owned_from`` (depth of the first such node),
    ``above`` (bytes of its path above that node) and ``owns_leaf``."""
    nodes = _rolled_up(blocks, {"conv_id": "MIN(conv_id)", "longest": "MAX(n)"}, width)
    return (
        nodes.withColumn("path_bytes", _bytes_above(width))
        .groupBy("conv_id")
        .agg(F.min("depth").alias("owned_from"), F.min_by("path_bytes", "depth").alias("above"), F.max(F.col("longest") == F.col("depth")).alias("owns_leaf"))
    )


def _sums(blocks: DataFrame, stretches: DataFrame, width: int) -> DataFrame:
    """The nodes with their keys (``k1``, ``k2``), their parents' keys (``p1``, ``p2``) and sums."""
    members = blocks.join(stretches.join(owners(blocks, width), "conv_id", "left"), ["conv_id", "stretch"])
    opens = {f"opens{k}": f"COUNT_IF(owned_from = block * {width} + {k + 1})" for k in range(width + 1)}
    aggregates = {
        "conv_id": "MIN(conv_id)",
        "n_convs": "COUNT(*)",
        "longest": "MAX(n)",
        "own_n": "MIN_BY(n, conv_id)",
        "own_from": "MIN_BY(owned_from, conv_id)",
        "own_above": "MIN_BY(above, conv_id)",
        "member_bytes": "SUM(total)",
        "owned_bytes": "SUM(total - above)",
        "n_leaves": "COUNT_IF(owns_leaf)",
        **opens,
    }
    nodes = _rolled_up(members, aggregates, width)
    mixed = [_mixed(F.col(f"t{k + 1}"), F.col("block") * width + k) for k in range(width)]
    above = [tuple(F.when(F.col("level") > k + 1, x).otherwise(F.lit(0)) for x in m) for k, m in enumerate(mixed)]
    # Members other than the least one own only what lies below the node; the least one owns its path from own_from on.
    path = _bytes_above(width)
    distinct_bytes = F.col("owned_bytes") - (path - F.col("own_above"))
    others = reduce(lambda x, k: F.when(F.col("level") == k, F.col(f"opens{k}")).otherwise(x), range(width), F.col(f"opens{width}"))
    return nodes.select(
        *[_xor([F.col(f"x{i + 1}"), *[m[i] for m in mixed]]).alias(f"k{i + 1}") for i in range(2)],
        *[_xor([F.col(f"x{i + 1}"), *[m[i] for m in above]]).alias(f"p{i + 1}") for i in range(2)],
        F.get(F.array(*[F.col(f"t{k + 1}") for k in range(width)]), F.col("level") - 1).alias("turn"),
        "conv_id",
        "depth",
        "n_convs",
        (others + F.when(F.col("own_n") > F.col("depth"), 1).otherwise(0)).alias("n_children"),
        "n_leaves",
        (F.col("member_bytes") - F.col("n_convs") * path - distinct_bytes).alias("saved_tokens"),
        "longest",
        "own_from",
    )


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``, the parent's least member. It is the node's own, but for the first node that a
    conversation owns. Parents with very many children, of which there are at most ``HOT_PARENTS``, are
    broadcast; no key of the other join holds more than a thousandth of all nodes."""
    limit = max(HOT_PARENTS, nodes.count() // HOT_PARENTS)
    same = F.when(F.col("depth") > 0, F.col("conv_id"))
    plain = nodes.where("depth = 0 OR own_from < depth").withColumn("parent_conv_id", same)
    asking = nodes.where("depth > 0 AND own_from = depth")
    parents = nodes.where("n_convs > 1").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > limit).drop("n_children"))
    cold = parents.where(F.col("n_children") <= limit).drop("n_children")
    first = asking.join(hot, ["p1", "p2"], "left_semi").join(hot, ["p1", "p2"])
    rest = asking.join(hot, ["p1", "p2"], "left_anti").join(cold, ["p1", "p2"])
    columns = [*nodes.columns, "parent_conv_id"]
    return plain.select(columns).union(first.select(columns)).union(rest.select(columns))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) to pieces of comma-joined ids of one node."""
    for batch in batches:
        keys = [batch.column(name).to_numpy() for name in ("k1", "k2")]
        ids = batch.column("conv_id").to_numpy()
        change = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        step = PIECE // 20
        edges = np.unique(np.concatenate([[0], change, np.arange(0, len(ids), step)])) if len(ids) else np.empty(0, int)
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, edges[1:])] if len(ids) else []
        yield pa.RecordBatch.from_arrays([*[pa.array(k[edges]) for k in keys], pa.array(ids[edges]), pa.array(texts, pa.string())], ["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest for each node; a node's pieces are hashed as they pass."""
    key, digest = None, None
    names = ["k1", "k2", "ends_sha256"]
    for batch in batches:
        done: list[tuple] = []
        for a, b, ids in zip(*[batch.column(x).to_pylist() for x in ("k1", "k2", "ids")], strict=True):
            if (a, b) == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], _DIGESTS)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, digest.hexdigest()), strict=True))], _DIGESTS)


_DIGESTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def with_ends(nodes: DataFrame, blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``ends_sha256``, the digest of the ids of the conversations that end in the node, in order. A node with
    one member needs no look-up."""
    last = blocks.where((F.col("n") == 0) | (F.col("block") == F.floor((F.col("n") - 1) / width)))
    mixed = [_mixed(F.col(f"t{k + 1}"), F.col("block") * width + k) for k in range(width)]
    ends = last.select(*[_xor([F.col(f"x{i + 1}"), *[m[i] for m in mixed]]).alias(f"k{i + 1}") for i in range(2)], "conv_id")
    parts = buckets_for(ends, 64)
    pieces = ends.repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "k1 long, k2 long, first long, ids string")
    digests = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    alone = F.when(F.col("longest") == F.col("depth"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY))
    single = nodes.where("n_convs = 1").withColumn("ends_sha256", alone)
    shared = nodes.where("n_convs > 1").join(digests, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    columns = [*nodes.columns, "ends_sha256"]
    return single.select(columns).union(shared.select(columns))


def trie(conversations: DataFrame, rebuild: bool = False, width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """The nodes of the trie: ``k1``, ``k2`` (the node's key) and ``p1``, ``p2`` (its parent's), ``turn`` (id and bytes
    of its last turn, see ``turn_texts``), ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that sharing saves in its subtree) and ``ends_sha256``.

    ``rebuild`` first replaces the beginnings of the conversations, as ``placed`` says.
    """
    blocks, stretches = paths(placed(numbered(conversations), rebuild), width, stretch)
    nodes = stored(_sums(blocks, stretches, width), "nodes")
    return with_ends(with_parents(nodes), blocks, width).drop("longest", "own_from")


def turn_texts(conversations: DataFrame) -> DataFrame:
    """Role and text of each turn id, to read the nodes of ``trie`` by."""
    rows = _clean(conversations)
    return rows.select(turn_id(F.col("role"), F.col("text")).alias("turn"), "role", "text").groupBy("turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))


def rebuilt_nodes(conversations: DataFrame) -> DataFrame:
    """The contract's columns for the nodes of the rebuilt conversations."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return trie(conversations, rebuild=True).select(*[F.col(c).cast("long").alias(c) for c in columns], "ends_sha256")
