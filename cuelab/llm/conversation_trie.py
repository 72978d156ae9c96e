"""Conversations as a trie of shared prefixes, in tables of perfect-hash slots.

A prefix of turns is named by a digest, the sum of the digests of its turns at their places, so that all
prefixes of a conversation come from running sums, however long it is. Equal conversations are one with a
count. Distinct digests are the nodes. A node of a single distinct conversation and all below it are one
slot (a tail: what holds for its nodes follows from running sums); nodes shared by more than a bounded
number of them form the trunk; all others hang below the trunk in subtrees, dealt out to shards.

A shard is read from its deepest nodes upwards in blocks of whole levels. The digests of a block get slots
by a minimal perfect hash, checked against the stored digest; counts are scattered into flat arrays and
accumulated through the array of parent slots, level by level. What has its parent in no block of the shard
goes to the trunk, which is folded the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .perfect_hash import PerfectHash, digests
from .running import running
from .shared import col, text_of

#: Nodes of a shard, of a block in memory (and the rest of its last level), and of the trunk, about.
SHARD_NODES, BLOCK_NODES, TRUNK_NODES = 1 << 16, 1 << 17, 1 << 20
#: A node with more distinct conversations than this, and than rows / TRUNK_NODES, is in the trunk.
HEAVY = 1 << 14
#: Ids of a list that are joined at once.
CHUNK = 4096
SUMS = ("d0", "d1", "d2", "d3", "n_bytes")


def _digest(depth: Column, parts: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, *parts)))


ROOT = hashlib.md5(b"0:0:0:0:0").digest()


def turn_keys(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, what orders equal turn numbers, ``said`` (digest of role and text) and ``n_bytes`` of the text.

    Null roles and texts are empty; rows without a conversation are left out; so are other columns.
    """
    r, t = text_of(role), text_of(text)
    return turns.where(col(conv).isNotNull()).select(
        col(conv).cast("bigint").alias("conv_id"), col(turn).alias("turn"), r.alias("role"), F.substring(t, 1, 64).alias("head"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("said"), F.octet_length(t).cast("bigint").alias("n_bytes"),
    )


def numbered(keys: DataFrame) -> DataFrame:
    """``turn_keys`` with ``place`` (from 1) and ``size`` of each conversation, written.

    Turns go by their number, null first; turns that share it by role, then by text (its first 64 letters,
    then its digest). Repeated rows are turns of their own.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("said")]
    return materialise(running(keys, "conv_id", order, label="turns").select("conv_id", "place", "size", "said", "n_bytes"), "numbered-turns")


def with_lent_heads(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another: ``conv_id``, ``depth``, ``said``, ``n_bytes``; and the conversations.

    The first h turns are those of conversation c - c % ``every`` (fewer if it has fewer, none if there is no
    such one), then follow the own turns after the first h; h is crc32 of the decimal id, modulo ``most`` + 1.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string")) % (most + 1)
    firsts = turns.where("place = 1").select("conv_id", "size", h.alias("h"), (c - c % every).alias("lender"))
    lender = c % every == 0
    lent = turns.where("place = 1").where(lender).select(c.alias("lender"), F.least("size", F.lit(most)).alias("has"))
    lead = F.least("h", F.coalesce("has", F.lit(0)))
    convs = firsts.join(lent.hint("merge"), "lender", "left").select("conv_id", "lender", "h", lead.alias("lead"), F.greatest(F.col("size") - F.col("h"), F.lit(0)).alias("own"))
    convs = materialise(convs, "conversations")
    heads = turns.where(lender & (F.col("place") <= most)).select(c.alias("lender"), "place", "said", "n_bytes")
    asked = convs.where("lead > 0").select("conv_id", "lender", F.explode(F.sequence(F.lit(1).cast("bigint"), "lead")).alias("place"))
    given = asked.join(heads.hint("merge"), ["lender", "place"]).select("conv_id", F.col("place").alias("depth"), "said", "n_bytes")
    own = turns.where(F.col("place") > h).join(convs.select("conv_id", "h", "lead").hint("merge"), "conv_id")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("depth"), "said", "n_bytes")
    return given.unionByName(own), convs.select("conv_id", (F.col("lead") + F.col("own")).alias("length"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the ``digest`` of the conversation up to it, of its ``parent``, the bytes ``before`` it and in ``all``; written."""
    own = F.md5(F.concat_ws(":", "depth", "said"))
    parts = [F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"d{i}") for i in range(4)]
    summed = running(turns.select("conv_id", "depth", "n_bytes", *parts), "conv_id", [F.col("depth")], SUMS, "turn-digests")
    upto = [F.col(f"upto_d{i}") for i in range(4)]
    return materialise(
        summed.select(
            "conv_id", "depth", "size", "n_bytes", (F.col("upto_n_bytes") - F.col("n_bytes")).alias("bytes_before"), F.col("all_n_bytes").alias("bytes_all"),
            _digest(F.col("depth"), upto).alias("digest"), _digest(F.col("depth") - 1, [u - F.col(f"d{i}") for i, u in enumerate(upto)]).alias("parent"),
            F.concat_ws(":", *[f"d{i}" for i in range(4)]).alias("said"),
        ),
        "prefixes",
    )


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per digest the SHA-256 of its chunks, which come one after another; no list is held whole."""
    now, state = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([x for _, x in out])], names=["digest", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends"])


def _id_lists(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ids that end at each digest. ``ends``: ``digest``, ``conv_id``, ``place``."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("digest", F.floor((F.col("place") - 1) / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    dealt = chunks.repartition("digest").sortWithinPartitions("digest", "chunk").select("digest", "ids")
    return dealt.mapInArrow(_hash_lists, "digest binary, ends string")


class _Shard:
    """Folds the blocks of one shard, deepest levels first."""

    def __init__(self):
        self.up = np.empty((0, 2), np.uint64), np.empty((0, 3), np.int64)  # parents that no block has had so far

    def fold(self, depth: np.ndarray, node: np.ndarray, parent: np.ndarray, own: np.ndarray):
        """Totals of the nodes of a block, and what is known now to belong above the shard."""
        table = PerfectHash(node)
        slot, above = table.slots, table.find(parent)
        total = np.empty_like(own)
        total[slot] = own
        waiting = table.find(self.up[0])
        np.add.at(total, waiting[waiting >= 0], self.up[1][waiting >= 0])
        over = self.up[0][waiting < 0], self.up[1][waiting < 0]
        edges = np.flatnonzero(np.diff(depth)) + 1
        for start, end in zip([0, *edges], [*edges, len(depth)]):  # a level, below all that follow
            to, of = above[start:end], total[slot[start:end]]
            inside = to >= 0
            # two sums are passed on and the child counts as one
            np.add.at(total, to[inside], np.column_stack([of[inside, :2], np.ones(inside.sum(), np.int64)]))
        outside = above < 0
        sums = total[slot]
        self.up = parent[outside], np.column_stack([sums[outside, :2], np.ones(outside.sum(), np.int64)])
        return sums, over


def _rows(node: np.ndarray, sums: np.ndarray, above: bool) -> Iterator[pa.RecordBatch]:
    if len(node):
        raw = np.ascontiguousarray(node).tobytes()
        names = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
        yield pa.RecordBatch.from_arrays([names, *[pa.array(sums[:, i]) for i in range(3)], pa.array([above] * len(node))], names=["digest", "saved", "leaves", "children", "above"])


def _fold_shards(block_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, then from the deepest level upwards. Out: a row per node, and one for each that has its parent above."""
        shard, now, held = _Shard(), None, []

        def joined(parts):
            return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))

        def fold(parts):
            depth, node, parent, own = joined(parts)
            sums, over = shard.fold(depth, node, parent, own)
            yield from _rows(node, sums, False)
            yield from _rows(*over, True)

        for batch in batches:
            of = batch.column(0).to_numpy()
            whole = (
                batch.column(1).to_numpy(), digests(batch.column(2).to_pylist()), digests(batch.column(3).to_pylist()),
                np.column_stack([batch.column(i).to_numpy() for i in (4, 5, 6)]),
            )
            edges = np.flatnonzero(np.diff(of)) + 1
            for start, end in zip([0, *edges], [*edges, len(of)]):
                if now != of[start]:
                    if held:
                        yield from fold(held)
                    yield from _rows(*shard.up, True)
                    shard, now, held = _Shard(), of[start], []
                held.append(tuple(x[start:end] for x in whole))
            if sum(len(p[0]) for p in held) >= block_nodes:
                parts = joined(held)
                cut = np.searchsorted(-parts[0], -parts[0][-1])  # the last level may go on
                if cut:
                    yield from fold([tuple(x[:cut] for x in parts)])
                    held = [tuple(x[cut:] for x in parts)]
        if held:
            yield from fold(held)
        yield from _rows(*shard.up, True)

    return run


FOLDED = "digest binary, saved bigint, leaves bigint, children bigint, above boolean"


def _folded(nodes: DataFrame, tasks: int, label: str) -> DataFrame:
    """Totals of ``nodes`` (``shard``, ``depth``, ``digest``, ``parent``, ``saved``, ``leaves``, ``children``); written."""
    dealt = nodes.repartition(tasks, "shard").sortWithinPartitions(F.col("shard"), F.col("depth").desc())
    ordered = dealt.select("shard", "depth", "digest", "parent", "saved", "leaves", "children")
    return materialise(ordered.mapInArrow(_fold_shards(BLOCK_NODES), FOLDED), label)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``turns`` (``conv_id``, ``depth`` from 1 without gaps, ``said``, ``n_bytes``) of ``conversations`` (``conv_id``, ``length``).

    Per node, the textless root included: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256`` of the members that end
    there. No conversations, no nodes; without turns all are members of the root alone.
    """
    rows = _prefixes(turns)
    ended = rows.where("depth = size").select("conv_id", "digest")
    ended = ended.unionByName(conversations.where("length = 0").select("conv_id", F.lit(ROOT).alias("digest")))
    ended = materialise(running(ended, "digest", [F.col("conv_id")], label="ends"), "ended")
    ends = materialise(_id_lists(ended), "id-lists")
    # of equal conversations only the first goes on
    kept = ended.where("place = 1").select("conv_id", F.col("size").alias("copies"))
    rows = materialise(rows.join(kept.hint("merge"), "conv_id"), "distinct-prefixes")
    same = lambda x: F.min(x).eqNullSafe(F.max(x))
    shared = rows.groupBy("digest").agg(
        F.count("*").alias("n_distinct"), F.sum("copies").alias("n_convs"), F.min("conv_id").alias("first"),
        (same(F.xxhash64("parent")) & same(F.xxhash64("said")) & same("depth")).alias("one"),
    )
    sound = F.when(F.col("one"), F.col("digest")).otherwise(F.raise_error(F.lit("two prefixes have one digest")))
    shared = materialise(shared.where("n_distinct > 1").withColumn("digest", sound).drop("one"), "shared-nodes")
    rows = materialise(rows.join(shared.hint("merge"), "digest", "left"), "marked-prefixes")
    heavy = max(HEAVY, rows.count() // TRUNK_NODES)
    tail, light = F.col("n_distinct").isNull(), F.coalesce(F.col("n_distinct") <= heavy, F.lit(True))
    below = F.col("bytes_all") - F.col("bytes_before")
    chain = F.struct("depth", "digest", "parent", ((F.col("copies") - 1) * below).alias("saved"))
    per = rows.groupBy("conv_id").agg(F.min(F.when(tail, chain)).alias("tail"), F.min(F.when(light, F.struct("depth", "digest"))).alias("top"))
    per = materialise(per.where("top is not null"), "tops")
    top = F.xxhash64("top.digest")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    owned = rows.where(F.col("first") == F.col("conv_id")).withColumn("saved", saved)
    inner = owned.where(light).select("conv_id", "depth", "digest", "parent", "saved").join(per.select("conv_id", "top").hint("merge"), "conv_id")
    inner = inner.select(top.alias("top"), "depth", "digest", "parent", "saved", F.lit(0).cast("bigint").alias("leaves"))
    tails = per.where("tail is not null").select(top.alias("top"), "tail.*", F.lit(1).cast("bigint").alias("leaves"))
    hung = materialise(inner.unionByName(tails).withColumn("children", F.lit(0).cast("bigint")), "hung-nodes")
    shards = max(1, hung.count() // SHARD_NODES)
    low = _folded(hung.withColumn("shard", F.pmod("top", F.lit(shards))), shards, "folded-shards")
    passed = low.where("above").groupBy("digest").agg(*[F.sum(x).alias(x) for x in ("saved", "leaves", "children")])
    zero = F.lit(0).cast("bigint")
    trunk = owned.where(~light).select("depth", "digest", "parent", "saved")
    root = conversations.limit(1).select(zero.alias("depth"), F.lit(ROOT).alias("digest"), F.lit(bytes(16)).alias("parent"), zero.alias("saved"))
    trunk = trunk.unionByName(root).join(passed.withColumnRenamed("saved", "more").hint("merge"), "digest", "left").select(
        F.lit(0).cast("bigint").alias("shard"), "depth", "digest", "parent", (F.col("saved") + F.coalesce("more", zero)).alias("saved"),
        F.coalesce("leaves", zero).alias("leaves"), F.coalesce("children", zero).alias("children"),
    )
    high = _folded(trunk, 1, "folded-trunk")
    sums = low.where(~F.col("above")).unionByName(high.where(~F.col("above"))).drop("above")
    # every node once: those of the first member, and tails
    nodes = rows.where(tail | (F.col("first") == F.col("conv_id"))).select(
        "conv_id", "depth", "digest", tail.alias("tail"), F.coalesce("n_convs", "copies").alias("n_convs"), ((F.col("copies") - 1) * below).alias("tail_saved"),
        (F.col("depth") < F.col("size")).cast("bigint").alias("tail_children"),
    )
    owners = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.coalesce("first", "conv_id").alias("parent_conv_id"))
    nodes = nodes.join(owners.hint("merge"), ["conv_id", "depth"], "left")
    every = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    n_all, first = every.first()
    null = F.lit(None).cast("bigint")
    top_node = conversations.limit(1).select(
        F.lit(first).cast("bigint").alias("conv_id"), zero.alias("depth"), F.lit(ROOT).alias("digest"), F.lit(False).alias("tail"),
        F.lit(n_all).cast("bigint").alias("n_convs"), null.alias("tail_saved"), null.alias("tail_children"), null.alias("parent_conv_id"),
    )
    over = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", F.lit(first).cast("bigint")))
    found = nodes.unionByName(top_node).join(sums.hint("merge"), "digest", "left").join(ends.hint("merge"), "digest", "left")
    of = lambda shared, own: F.when(F.col("tail"), own).otherwise(shared)
    leaves = F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves"))
    return found.select(
        "conv_id", "depth", over.alias("parent_conv_id"), "n_convs", of(F.col("children"), F.col("tail_children")).alias("n_children"),
        of(leaves, F.lit(1)).cast("bigint").alias("n_leaves"), of(F.col("saved"), F.col("tail_saved")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; see ``trie``."""
    placed = numbered(turn_keys(turns, conv, turn, role, text))
    convs = placed.where("place = 1").select("conv_id", F.col("size").alias("length"))
    return trie(placed.select("conv_id", F.col("place").alias("depth"), "said", "n_bytes"), convs)
