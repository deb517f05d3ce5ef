"""The trie of conversation prefixes by vertical bitmaps: what conversations share from their first turn on.

A node is a sequence of first turns (role, text); the root has none. Conversations are cut by id into shards. A shard
keeps for every (position, turn) the bitset of its conversations; intersecting a node's bitset with the postings of
the next position, depth first, gives its children, their bits the number of members and the conversations that end there. Nodes
of all shards are added up by the digest of their turns.

Members of a node's child are members of the node, so the nodes with one smallest member lie one below the other: a chain.
Sums over subtrees run along chains and over the tree of chains, whose ancestors are found by doubling.

Null roles and texts count as empty. Equal turn numbers go by role, then text, nulls first, and repeated rows are turns like any other.
Rows without a conversation id take no part. An empty table gives no nodes, not even the root. Columns but the named ones are not
read. One conversation's turns, as digests of 16 bytes, lie in one task; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import settle

SHARD, ENDS = 2048, 512
LOCAL = "key binary, parent binary, depth long, conv_id long, n long, size long, ends binary"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn: of the role's length, the role and the text."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def numbered(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, turn, size): each conversation's turns, numbered from 1, as digests and UTF-8 bytes of their text."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    source = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(order).alias("at"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    by = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    placed = source.withColumn("pos", F.row_number().over(by).cast("long"))
    return placed.select("conv_id", "pos", turn_digest(F.col("role"), F.col("text")).alias("turn"), F.octet_length("text").cast("long").alias("size"))


def branched(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin like another one: for id c the first h turns of conversation c - c % family, then c's own after its h-th.

    h is the checksum of c's digits modulo ``heads``. A conversation left without turns keeps a row with null ``pos``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    sizes = settle(turns.groupBy("conv_id").agg(F.max("pos").alias("own")))
    convs = sizes.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "turn", "size")
    head = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", "pos", "turn", "size")
    tail = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "size")
    bare = convs.where("taken = 0 AND own <= h").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("long").alias("size"))
    return head.unionByName(tail).unionByName(bare)


def shard_nodes(conversations: list[tuple[int, list[bytes], list[int]]]):
    """Nodes of some conversations (id, turns, sizes), ids ascending: (key, parent, depth, least id, members, size, ids that end there)."""
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for i, (_, turns, _) in enumerate(conversations):
        for depth, turn in enumerate(turns, 1):
            postings[depth, turn] = postings.get((depth, turn), 0) | (1 << i)
        ending[len(turns)] = ending.get(len(turns), 0) | (1 << i)
    stack = [((1 << len(conversations)) - 1, 0, bytes(16), None, 0)] if conversations else []
    while stack:
        members, depth, key, parent, size = stack.pop()
        over = members & ending.get(depth, 0)
        least = (members & -members).bit_length() - 1
        yield key, parent, depth, conversations[least][0], members.bit_count(), size, [conversations[i][0] for i in _bits(over)]
        rest = members & ~over
        while rest:
            i = (rest & -rest).bit_length() - 1
            turn = conversations[i][1][depth]
            child = members & postings[depth + 1, turn]
            rest &= ~child
            below = hashlib.blake2b(key + turn, digest_size=16).digest()
            stack.append((child, depth + 1, below, key, conversations[i][2][depth]))


def _bits(bits: int):
    while bits:
        yield (bits & -bits).bit_length() - 1
        bits &= bits - 1


def local_nodes(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows of ``LOCAL``: the nodes of every shard, and with null depth the ids that end at them, ascending, at most ``ENDS`` a row."""

    def batches_of(nodes):
        lines = []
        for key, parent, depth, conv, n, size, ends in nodes:
            lines.append((key, parent, depth, conv, n, size, None))
            for at in range(0, len(ends), ENDS):
                part = ends[at : at + ENDS]
                lines.append((key, None, None, part[0], None, None, ",".join(map(str, part)).encode()))
            if len(lines) >= 4096:
                yield lines
                lines = []
        if lines:
            yield lines

    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "parent", "depth", "conv_id", "n", "size", "ends"]

    def run(batches):
        held: list[tuple[int, list[bytes], list[int]]] = []

        def flush():
            for lines in batches_of(shard_nodes(held)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in lines], kind) for i, kind in enumerate(kinds)], names=names)
            held.clear()

        for batch in batches:
            for conv, turn, size in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "size")]):
                if not held or held[-1][0] != conv:
                    if len(held) == shard:
                        yield from flush()
                    held.append((conv, [], []))
                if turn is not None:
                    held[-1][1].append(turn)
                    held[-1][2].append(size)
        yield from flush()

    return turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, LOCAL)


def ends_digest(chunks: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the comma-joined ids, whose chunks (key, conv_id, ends) are hashed one after the other."""

    def run(batches):
        key, digest = None, None
        for batch in chain(batches, [None]):
            done = []
            for own, ends in [] if batch is None else zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if own != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ends)
                else:
                    digest.update(b"," + ends)
            if batch is None and key is not None:
                done.append((key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])

    return chunks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) summed over each chain and all chains below it, for chains (conv_id, up, leaves, saved).

    After round r a chain holds the sums of the chains less than 2^r below it, and knows its 2^r-th ancestor.
    """
    held = settle(chains)
    while held.where("up IS NOT NULL").limit(1).count():
        below = held.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = held.select(F.col("conv_id").alias("up"), F.col("up").alias("far"))
        step = held.join(below, "conv_id", "left").join(above, "up", "left")
        added = [(F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))]
        held = settle(step.select("conv_id", F.col("far").alias("up"), *added))
    return held.select("conv_id", "leaves", "saved")


def prefix_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos, turn, size; null ``pos`` for a conversation without turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, bytes of
    each node's last text times members but one), ends_sha256.
    """
    local = settle(local_nodes(turns, shard))
    known = local.where("depth IS NOT NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("size").alias("size")
    )
    children = local.where("parent IS NOT NULL").groupBy("parent", "key").agg(F.lit(1).alias("one"))
    children = children.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = ends_digest(local.where("ends IS NOT NULL").select("key", "conv_id", "ends"))
    nodes = settle(known.join(children, "key", "left").join(ends, "key", "left"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    shown = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    leaf = F.col("n_children").isNull().cast("long").alias("leaf")
    nodes = settle(nodes.join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), own, leaf, shown))

    # A chain hangs below the chain of its top node's parent, at the parent's depth.
    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    chains = nodes.groupBy("conv_id").agg(
        F.max(F.when(top, F.col("parent_conv_id"))).alias("up"), (F.min("depth") - 1).alias("at"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")
    )
    chains = settle(chains)
    totals = chain_totals(chains.select("conv_id", "up", "leaves", "saved"))
    hung = totals.join(chains.select("conv_id", "up", "at"), "conv_id").where("up IS NOT NULL")
    hung = hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))

    def over_subtree(own, hanging):
        return F.sum(F.col(own) + F.coalesce(F.col(hanging), F.lit(0))).over(below)

    joined = nodes.join(hung, ["conv_id", "depth"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", over_subtree("leaf", "l").alias("n_leaves"), over_subtree("saved", "s").alias("saved_tokens"), "ends_sha256"
    )
