"""Prefix trie of conversations by hashes of fixed-length blocks of turns.

Conversations are first grouped by the digests of successive blocks of ``BLOCK`` turns. Where all conversations that go on
from a block boundary share the next block, its inner nodes follow from that one group. Only blocks in which siblings
diverge are refined turn by turn, and there one row stands for all conversations with the same block.

A node's id is the sum of 128-bit digests of the blocks before it and of its turns inside its block, each digest with its
place. Sums need no chain over the turns, so a conversation of any length is cut like any running total. All nodes
with the same smallest member form one path of the trie, a chain that hangs below a node of another chain; subtree sums are
suffix sums along chains, after the sums of whole chains were added up by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.materialize import written_table
from gaugeflow.operators.ordered import running_totals

BLOCK = 4
#: Conversation ids are joined in runs of ids that agree above this many bits: at most 4,096 ids to a string.
RUN_BITS = 12
_ID = "decimal(38,0)"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, points): turns numbered from 1 by turn, nulls first, ties by the digest of role and text."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )
    placed = running_totals(turns, ["conv_id"], ["turn", "digest"], {"place": F.lit(1).cast("long")})
    return placed.select("conv_id", "place", "digest", "points")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv_id, length) of conversations rebuilt so that each begins as the first of its hundred does.

    Conversation c takes its first h turns from c - c % 100, h = crc32(decimal c) % 6, and goes on with its own turns
    after its first h. ``%`` has the sign of c. A hundred conversations share at most five turns of their first one.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("total"))
    plan = sizes.select("conv_id", "total", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), head.alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    taken = F.least("h", F.coalesce("base_total", F.lit(0)))
    plan = (
        plan.join(base, "base", "left")
        .withColumn("taken", taken)
        .withColumn("length", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "h", "taken", "length")
    )
    firsts = turns.where("place <= 5").withColumnRenamed("conv_id", "base")
    heads = plan.join(firsts, "base").where("place <= h").select("conv_id", "place", "digest", "points", "length")
    rest = turns.join(plan, "conv_id").where("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "points", "length")
    return heads.unionByName(rest), plan.select("conv_id", "length")


def _halves(block: Column, turns: Column, prefix: Column) -> list[Column]:
    """The two halves, as numbers, of a digest of a prefix of a block together with its place."""
    digest = F.md5(F.concat_ws(":", block.cast("string"), turns.cast("string"), prefix))
    return [F.conv(F.substring(digest, begin, 16), 16, 10).cast("decimal(20,0)") for begin in (1, 17)]


def _prefix(digests: Column, turns: Column) -> Column:
    return F.md5(F.array_join(F.slice(digests, 1, turns), ""))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block, with the sums of the digests of the blocks before (b1, b2)."""
    gathered = (
        turns.groupBy("conv_id", F.expr(f"(place - 1) div {block}").alias("block"))
        # At most `block` turns to a row: places are distinct.
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "points"))).alias("turns"), F.max("length").alias("length"))
        .select("conv_id", "block", "length", F.col("turns.digest").alias("digests"), F.col("turns.points").alias("points"))
        .withColumn("prefix", _prefix(F.col("digests"), F.size("digests")))
    )
    one, two = _halves(F.col("block"), F.size("digests"), F.col("prefix"))
    hashed = written_table(gathered.withColumns({"own1": one, "own2": two}), "trie-blocks")
    summed = running_totals(hashed, ["conv_id"], ["block"], {"sum1": F.col("own1"), "sum2": F.col("own2")})
    before = {f"b{k}": (F.col(f"sum{k}") - F.col(f"own{k}")).cast(_ID) for k in (1, 2)}
    return summed.withColumns(before).drop("own1", "own2")


def _inner_nodes(groups: DataFrame, block: int) -> DataFrame:
    """A row for every turn of every block group: its id, its parent's id, depth, smallest member, members and points."""
    each = groups.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("digests"))))
    at, number, digests = F.col("at"), F.col("block"), F.col("digests")
    own = _halves(number, at, _prefix(digests, at))
    above = _halves(number, at - 1, _prefix(digests, at - 1))
    return each.select(
        *[(F.col(f"b{k}") + own[k - 1]).cast(_ID).alias(f"id{k}") for k in (1, 2)],
        *[(F.col(f"b{k}") + F.when(at > 1, above[k - 1]).otherwise(F.lit(0))).cast(_ID).alias(f"up{k}") for k in (1, 2)],
        (number * block + at).cast("long").alias("depth"),
        "conv_id",
        "n_convs",
        F.element_at("points", at).alias("points"),
    )


def _nodes(blocks: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """(id1, id2, up1, up2, depth, conv_id, n_convs, points) of every node."""
    place = ["block", "b1", "b2"]
    groups = written_table(
        blocks.groupBy(*place, "prefix").agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.first("digests").alias("digests"),
            F.first("points").alias("points"),
        ),
        "trie-groups",
    )
    diverging = groups.groupBy(*place).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(*place)
    whole = _inner_nodes(groups.join(diverging, place, "left_anti"), block)
    refined = (
        _inner_nodes(groups.join(diverging, place, "left_semi"), block)
        .groupBy("id1", "id2", "up1", "up2", "depth", "points")
        .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    )
    zero, none = F.lit(0).cast(_ID), F.lit(None).cast(_ID)
    root = (
        lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        .where("n_convs > 0")
        .select(
            zero.alias("id1"), zero.alias("id2"), none.alias("up1"), none.alias("up2"), F.lit(0).cast("long").alias("depth"),
            "conv_id", "n_convs", F.lit(0).cast("long").alias("points"),
        )
    )
    return written_table(whole.unionByName(refined).unionByName(root), "trie-nodes")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, saved, leaves) of each chain with all chains below it, by pointer doubling: one round per bit of the height.

    ``chains`` has conv_id, the chain ``up`` it hangs from (null for the root's), and its own sums.
    """
    state = written_table(chains, "trie-chains")
    while True:
        hanging = state.where("up is not null")
        if hanging.isEmpty():
            return state.drop("up")
        root = state.where("up is null").select(F.col("conv_id").alias("up"), F.lit(True).alias("over"))
        below = hanging.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        # Pointers to a chain without a pointer end here; the join sees the others only.
        going = hanging.join(root, "up", "left_anti").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up")
        ended = hanging.join(root, "up", "left_semi").withColumn("next", F.lit(None).cast("long"))
        moved = going.unionByName(ended).unionByName(state.where("up is null").withColumn("next", F.lit(None).cast("long")))
        state = written_table(
            moved.join(below, "conv_id", "left").select(
                "conv_id",
                F.col("next").alias("up"),
                (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            ),
            "trie-chains",
        )


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, whose runs come in order; holds one batch at a time."""
    key, state = None, None
    for batch in batches:
        found = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != key:
                if key is not None:
                    found.append((key, state.hexdigest()))
                key, state = node, sha256(ids.encode())
            else:
                state.update(b",")
                state.update(ids.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["node", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def _node_key() -> Column:
    return F.concat_ws(":", F.col("id1").cast("string"), F.col("id2").cast("string")).alias("node")


def _ends(blocks: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end.

    A hash runs through its ids one after the other. Ids are joined in strings of up to 4,096 first, side by side; one task
    then reads a node's strings as a stream.
    """
    last = blocks.where(F.col("block") * block + F.size("digests") == F.col("length"))
    ended = last.select(F.col("sum1").cast(_ID).alias("id1"), F.col("sum2").cast(_ID).alias("id2"), "conv_id")
    silent = lengths.where("length = 0").select(F.lit(0).cast(_ID).alias("id1"), F.lit(0).cast(_ID).alias("id2"), "conv_id")
    runs = (
        ended.unionByName(silent)
        .groupBy(_node_key(), F.shiftright("conv_id", RUN_BITS).alias("run"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )
    return runs.repartition("node").sortWithinPartitions("node", "run").mapInArrow(_hashed_runs, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, place, digest, points, length)``.

    Places count from 1 without gaps; ``lengths(conv_id, length)`` also has conversations without a turn, which end at the
    root. Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; a node is named by conv_id and depth. Without conversations there is no root and no row.
    """
    lengths = written_table(lengths, "trie-lengths")
    blocks = written_table(_blocks(turns, block), "trie-sums")
    nodes = _nodes(blocks, lengths, block)
    named = nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("up"))
    chains = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "up1", "up2")).alias("top")).select("conv_id", "top.*")
    chains = written_table(
        chains.join(named, ["up1", "up2"], "left").select("conv_id", F.col("depth").alias("top"), "up"), "trie-chain-tops"
    )
    parent = F.when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("conv_id"))
    linked = nodes.join(chains, "conv_id").select("id1", "id2", "depth", "conv_id", "n_convs", "points", parent.alias("parent_conv_id"))
    children = (
        linked.where("parent_conv_id is not null")
        .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    counted = written_table(
        linked.join(children, ["conv_id", "depth"], "left").select(
            _node_key(), "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
            F.col("n_children").isNull().cast("long").alias("leaves"),
        ),
        "trie-linked",
    )
    own = counted.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    totals = _chain_totals(own.join(chains, "conv_id").select("conv_id", "up", "saved", "leaves"))
    hung = (
        chains.where("up is not null")
        .join(totals, "conv_id")
        .groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth"))
        .agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    )
    weighed = counted.join(hung, ["conv_id", "depth"], "left").withColumns(
        {
            "saved": F.col("saved") + F.coalesce("hung_saved", F.lit(0)),
            "leaves": F.col("leaves") + F.coalesce("hung_leaves", F.lit(0)),
            "upward": -F.col("depth"),
        }
    )
    weighed = written_table(weighed.drop("hung_saved", "hung_leaves"), "trie-weighed")
    summed = running_totals(
        weighed, ["conv_id"], ["upward"], {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")}
    )
    return summed.join(_ends(blocks, lengths, block), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text, ...)``.

    Null roles and texts are empty. Turns without a number come first; ties are ordered by a digest of role and text, and
    repeated rows are repeated turns. Rows without a conv_id belong to no conversation. An empty table gives an
    empty result; other columns are ignored.
    """
    turns = written_table(ordered_turns(conversations), "trie-turns")
    return prefix_trie(*with_shared_heads(turns), block)
