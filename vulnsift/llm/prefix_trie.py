"""Prefix trie of conversations by truncation peeling.

A node is a sequence of first ``d`` turns; two conversations meet in it when these turns are equal. One aggregation finds
all nodes with their members, since a prefix is told by sums of position-dependent hashes of its turns (128 bits), which a window
adds up turn by turn: texts never travel.

What a node sums over its subtree comes by peeling, from the deepest turns upward. Every node belongs to the longest of its
members (ties: smallest id), so that a conversation owns the nodes from its end up to the one where a longer
conversation goes on. In each round the conversations that nothing hangs on any more have ended: they are
truncated up to the node they share with a survivor, regrouped there, and their sums are merged into it. A run of turns that nobody
else enters is stripped at once, so the number of rounds is that of merges on the way from a leaf to the root,
not that of turns; the survivors of a round are written to the shared checkpoint folder.

Skew: a common first turn or a group of copies is a few rows per task (partial sums). The id lists for the digests are
made in sorted blocks of ids and hashed as a stream, one block at a time. A single conversation is one key of a window and spills when it
is long.

Defined cases: rows without ``conv_id`` belong to no conversation; null turns come first, equal turns go by role, then by
hash of the text; null role or text is empty; repeated rows are turns of their own; a conversation without turns is a
member of the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm.common import cut, written

GROUP = 100
FORKS = 6
ID_BLOCK = 1 << 16
_LOW = (1 << 32) - 1
_NODE = ["depth", "k1", "k2"]


def turn_marks(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, idx, mark, size``: turns numbered from 1, each as a hash of role and text and its code points."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"),
        F.sha2(F.concat_ws(":", F.length(r), r, t), 256).alias("mark"), F.length(t).cast("bigint").alias("size"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "mark")
    return rows.select("conv_id", F.row_number().over(w).cast("bigint").alias("idx"), "mark", "size")


def members_of(marks: DataFrame) -> DataFrame:
    return marks.where("idx = 1").select("conv_id")


def forked(marks: DataFrame, group: int = GROUP, forks: int = FORKS) -> DataFrame:
    """Every conversation rebuilt as a fork of the first one of its ``group`` ids: its first h turns come from there, the
    rest are its own, where h is the crc32 of its id modulo ``forks``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % forks
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = marks.where((F.col("conv_id") % group == 0) & (F.col("idx") < forks)).withColumnRenamed("conv_id", "base")
    taken = members_of(marks).select("conv_id", base.alias("base"), h.alias("h")).join(heads, "base").where("idx <= h") \
        .select("conv_id", F.lit(0).alias("own"), "idx", "mark", "size")
    own = marks.where(F.col("idx") > h).select("conv_id", F.lit(1).alias("own"), "idx", "mark", "size")
    w = Window.partitionBy("conv_id").orderBy("own", "idx")
    return taken.unionByName(own).select("conv_id", F.row_number().over(w).cast("bigint").alias("idx"), "mark", "size")


def _key(sums: list[Column]) -> list[Column]:
    half = lambda a, b: F.shiftleft(a.bitwiseAND(_LOW), 32).bitwiseOR(b.bitwiseAND(_LOW))
    return [half(sums[0], sums[1]), half(sums[2], sums[3])]


def _prefixes(marks: DataFrame, members: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, size, length``: each prefix of each conversation, the empty one included."""
    words = [F.xxhash64(F.lit(j), "idx", "mark") for j in (0, 1)]
    rows = marks.select("conv_id", "idx", "size", *[x.alias(f"h{2 * j + i}") for j, w in enumerate(words)
                                                    for i, x in enumerate((F.shiftrightunsigned(w, 32), w.bitwiseAND(_LOW)))])
    one = Window.partitionBy("conv_id")
    upto = one.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("conv_id", F.col("idx").alias("depth"), "size", *[f"h{i}" for i in range(4)],
                       *[F.sum(f"h{i}").over(upto).alias(f"s{i}") for i in range(4)], F.max("idx").over(one).alias("length"))
    k1, k2 = _key([F.col(f"s{i}") for i in range(4)])
    p1, p2 = _key([F.col(f"s{i}") - F.col(f"h{i}") for i in range(4)])
    deep = sums.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "size", "length")
    zero = F.lit(0).cast("bigint")
    lengths = deep.where("depth = 1").select("conv_id", "length")
    top = members.join(lengths, "conv_id", "left").select(
        "conv_id", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "size")], F.coalesce("length", zero).alias("length"))
    return deep.unionByName(top)


def _digests(prefixes: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end in a node, ascending: sorted blocks of ids, hashed as a stream."""
    ends = prefixes.where("depth = length").select(*_NODE, "conv_id", F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    blocks = ends.groupBy(*_NODE, "block").agg(F.array_sort(F.collect_list("conv_id")).alias("ids")) \
        .select(*_NODE, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            for depth, k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (depth, k1, k2) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (depth, k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            yield _rows(done)
        if node is not None:
            yield _rows([(*node, digest.hexdigest())])

    return blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ids") \
        .mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*done)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_NODE, "ends_sha256"])


def _peel(paths: DataFrame) -> DataFrame:
    """``owner, depth, leaves, saved``: what the peeled conversations hand over to the node where they join ``owner``.

    ``paths(owner, at_owner, at_depth, saved)``: each conversation's own run, and where it joins another."""
    hung = paths.where("at_owner IS NOT NULL").groupBy(F.col("at_owner").alias("owner")).agg(F.count(F.lit(1)).alias("hung"))
    alive = cut(paths.join(hung, "owner", "left").select("owner", "at_owner", "at_depth", F.lit(1).cast("bigint").alias("leaves"), "saved",
                                                         F.coalesce("hung", F.lit(0)).alias("hung")))
    handed = None
    while True:
        ended = alive.where("hung = 0 AND at_owner IS NOT NULL")
        met = cut(ended.groupBy(F.col("at_owner").alias("owner"), F.col("at_depth").alias("depth")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("came")))
        if met.isEmpty():
            return met.drop("came") if handed is None else handed
        handed = met.drop("came") if handed is None else handed.unionByName(met.drop("came"))
        gain = met.groupBy("owner").agg(*[F.sum(c).alias(f"more_{c}") for c in ("leaves", "saved", "came")])
        zero = F.lit(0)
        alive = cut(alive.where("hung > 0").join(gain, "owner", "left").select(
            "owner", "at_owner", "at_depth", *[(F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in ("leaves", "saved")],
            (F.col("hung") - F.coalesce("more_came", zero)).alias("hung")))


def prefix_trie(marks: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``marks(conv_id, idx, mark, size)`` over all ``members(conv_id)``."""
    prefixes = written(_prefixes(marks, members), "trie-prefixes")
    # the longest member owns the node, the smallest id among equals: one number that hashes and adds up like any other
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    rank = (F.col("length").cast("decimal(17,0)") * span).cast("decimal(38,0)") - F.col("conv_id")
    nodes = prefixes.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("size").alias("size"), F.first("p1").alias("p1"),
        F.first("p2").alias("p2"), F.max("length").alias("longest"), F.max(rank).alias("rank"))
    nodes = written(nodes.withColumn("owner", (F.col("longest").cast("decimal(17,0)") * span - F.col("rank")).cast("bigint")).drop("longest", "rank"), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("at_owner"))
    tree = written(nodes.where("depth > 0").join(above, ["depth", "p1", "p2"]).unionByName(
        nodes.where("depth = 0"), allowMissingColumns=True), "trie-tree")
    own = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    tops = tree.where("at_owner IS NULL OR at_owner <> owner").select("owner", "at_owner", (F.col("depth") - 1).alias("at_depth"))
    paths = tops.join(tree.groupBy("owner").agg(F.sum(own).alias("saved")), "owner")
    handed = _peel(paths)
    below = Window.partitionBy("owner").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    one = tree.select("owner", *_NODE, "conv_id", "parent_conv_id", "n_convs", F.lit(0).cast("bigint").alias("leaves"), own)
    summed = one.unionByName(handed, allowMissingColumns=True).select(
        *_NODE, "conv_id", "parent_conv_id", "n_convs", (F.sum("leaves").over(below) + 1).alias("n_leaves"),
        F.sum("saved").over(below).alias("saved_tokens")).where("conv_id IS NOT NULL")
    kids = tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    return summed.join(kids, _NODE, "left").join(_digests(prefixes), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
