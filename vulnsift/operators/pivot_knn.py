"""Exact cosine top-k with pruning (J1, V6): pivot cells, distance bounds, no pair of blocks that cannot hold a neighbour.

On vectors of length 1 the cosine order is the order of Euclidean distance, which obeys the triangle inequality. The
distinct corpus vectors are dealt to the cells of their nearest pivots (a bounded k-means on a sample); of a cell its
least and greatest distance from the pivot are kept, and neighbouring cells of up to ``block_bytes`` form a block. Then

1. every distinct query is compared with its nearest cells, until these hold some more than ``k`` vectors; its k-th best distance is a bound;
2. it is sent to the blocks that have a cell which the bound can't rule out, and compared with these cells only; of their scores only
   those that reach the bound are looked at.

The result is that of ``exact_knn``. Vectors that occur often are compared once: of the ids of one vector only the ``k + 1``
smallest can be among the ``k`` nearest, and equal queries share their answer. A block is met by slices of
``query_rows`` queries at most, so a hot cell is a grid of groups of bounded size; a cell beyond a block is cut into several. On data
without clusters nothing is ruled out and the work is that of the blocked exact search.

A zero vector has similarity 0 to all: zero corpus vectors are a cell of their own that is ruled out by similarity, and
zero queries take the smallest ids. Null vectors are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.operators.ivf import _lloyd, _nearest, _seeds, _split
from vulnsift.operators.knn import RANK_DECIMALS, _unit_rows, _vectors, rank_key
from vulnsift.session import ship_package

SAMPLE_BYTES = 8 << 20
MAX_CELLS = 2048
BLOCK_BYTES = 4 << 20           # of a block, or a BLOCKS-th of all vectors, up to MOST_BLOCK_BYTES: each query is copied to the blocks it may need
MOST_BLOCK_BYTES = 32 << 20
BLOCKS = 48
QUERY_ROWS = 32768
SLACK = 1e-5                    # distances of almost equal vectors are exact to about 1e-6
_CHUNK = 1 << 22
_QUERIES = 1 << 12              # queries of a group that are scored at once
_MASK = 1 << 20                 # query and cell pairs whose distances a task holds at once
_SENT_BYTES = 4 << 20           # query vectors in one batch to the blocks


class _Cells:
    """What every task knows: pivots, and for each cell its distances from the pivot, its rows and its blocks."""

    def __init__(self, pivots, low, high, rows, first, blocks):
        self.pivots, self.low, self.high, self.rows = pivots, low, high, rows
        self.first, self.blocks = first, blocks         # a cell lies in blocks first .. first + blocks - 1

    def distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 1 + (self.pivots ** 2).sum(1) - 2 * q @ self.pivots.T))

    def near(self, d: np.ndarray, k: int) -> np.ndarray:
        """Round 1: the nearest cells that hold ``2 k`` rows or more."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < 2 * k, axis=1)
        return out & (self.rows > 0)

    def open(self, d: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Round 2: the other cells that may hold a vector within ``bound``."""
        least = np.maximum(d - self.high, self.low - d)
        return (least <= bound[:, None] + SLACK) & (self.rows > 0) & ~self.near(d, k)

    def goes(self, q: np.ndarray, bound: np.ndarray, k: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
        """The cells each query is compared with, and the blocks that hold them."""
        d = self.distances(q)
        mask = self.open(d, bound, k) if second else self.near(d, k)
        goes = np.zeros((len(q), int((self.first + self.blocks).max())), bool)
        for c in np.flatnonzero(mask.any(0)):
            goes[:, self.first[c]:self.first[c] + self.blocks[c]] |= mask[:, c:c + 1]
        return mask, goes


def _is_zero(vec: str):
    return ~F.exists(vec, lambda x: x != 0)


def _distinct_corpus(corpus: DataFrame, k: int) -> DataFrame:
    """Each distinct vector with its ``k + 1`` smallest ids."""
    w = Window.partitionBy("vec").orderBy("cid")
    few = corpus.where("vec IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("cid")).alias("ids"))         # at most k + 1


def _pivots(corpus: DataFrame, n: int, dim: int, cells: int | None, seed: int) -> np.ndarray:
    limit = SAMPLE_BYTES // (8 * dim)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec"), 11) / F.lit(float(1 << 53))
    got = corpus.where(u < F.lit(limit / n if n > limit else 1.0)).select("vec").toArrow()          # about ``SAMPLE_BYTES``
    x = _unit_rows(_vectors(got.column("vec"), dim)) if got.num_rows else np.zeros((1, dim))
    x = x[np.lexsort(x.T)]
    count = max(1, min(cells or min(MAX_CELLS, round(2 * math.sqrt(n))), len(x)))
    rng = np.random.default_rng(seed)
    c = _split(x, _lloyd(x, _seeds(x, max(1, count // 2), rng), 4), count, rng)
    return _lloyd(x, c, 2)


def _celled(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Distinct corpus vectors with their smallest id, their cell and the distance from its pivot."""
    held = corpus.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit_rows(_vectors(b.column(0), p.shape[1]))
            near = _nearest(x, p)
            d = np.sqrt(np.maximum(0, ((x - p[near]) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d)], ["vec", "least", "cell", "d"])

    kind = corpus.schema["vec"].dataType.simpleString()
    return corpus.select("vec", F.col("ids")[0].alias("least")).mapInArrow(run, f"vec {kind}, least bigint, cell int, d double")


def _cells(celled: DataFrame, pivots: np.ndarray, rows_per_block: int) -> _Cells:
    low, high, rows = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in celled.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).collect():
        low[r.cell], high[r.cell], rows[r.cell] = r.low, r.high, r.n                        # at most a row a cell
    # neighbouring cells share blocks: a walk from pivot to nearest pivot not yet seen, cut where a block is full
    left, order = np.ones(len(pivots), bool), []
    at = 0
    while left.any():
        order.append(at)
        left[at] = False
        if left.any():
            rest = np.flatnonzero(left)
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(1).argmin()])
    first, blocks = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    block, held = 0, 0
    for c in order:
        if rows[c] > rows_per_block:
            block += held > 0
            first[c], blocks[c] = block, -(-rows[c] // rows_per_block)
            block, held = block + int(blocks[c]), 0
            continue
        if held + rows[c] > rows_per_block:
            block, held = block + 1, 0
        first[c] = block
        held += rows[c]
    return _Cells(pivots, low, high, rows, first, blocks)


def _counter(held, k: int, second: bool):
    """How many queries of a task go to each block."""
    def run(batches):
        cells = held.value
        total = np.zeros(int((cells.first + cells.blocks).max()), np.int64)
        step = max(1, _MASK // (len(cells.pivots) + len(total)))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                total += cells.goes(_unit_rows(_vectors(part.column(2), cells.pivots.shape[1])), part.column(3).to_numpy(), k, second)[1].sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["block", "n"])
    return run


def _sender(held, k: int, second: bool):
    """Each query once for every block that has a cell to compare, with the number of vectors in these cells."""
    def run(batches):
        cells = held.value
        top = int((cells.first + cells.blocks).max())
        step = max(1, _MASK // (len(cells.pivots) + top))
        sent = max(1, _SENT_BYTES // (8 * cells.pivots.shape[1]))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                mask, goes = cells.goes(_unit_rows(_vectors(part.column(2), cells.pivots.shape[1])), part.column(3).to_numpy(), k, second)
                row, block = np.nonzero(goes)
                pairs, first = (mask * cells.rows).sum(1), np.r_[True, row[1:] != row[:-1]]
                work = np.where(first, pairs[row], 0) if len(row) else pairs[:0]
                for j in range(0, len(row), sent):                      # a query may go to every block: few copies are held at once
                    some = slice(j, j + sent)
                    take = pa.array(row[some])
                    cols = [part.column(c).take(take) for c in range(4)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(block[some].astype(np.int32)), pa.array(work[some])],
                                                     ["q1", "q2", "qvec", "bound", "block", "pairs"])
    return run


def _scorer(held, k: int, second: bool):
    names, kinds = ["q1", "q2", "vkey", "score"], (pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def run(key, q, c):
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        cells = held.value
        dim = cells.pivots.shape[1]
        qm = _unit_rows(_vectors(q.column("qvec"), dim))
        bound, cell = q.column("bound").to_numpy(), c.column("cell").to_numpy()
        here = np.unique(cell)                                          # of the mask, only this block's cells are kept
        if second:
            # all cells that may hold a vector within the bound; those of round 1 may be met again, which is cheaper than ordering all cells
            low, high = cells.low[here], cells.high[here]
            mask = np.zeros((len(qm), len(here)), bool)
            step = max(1, _MASK // len(here))
            for i in range(0, len(qm), step):
                d = _Cells(cells.pivots[here], low, high, None, None, None).distances(qm[i:i + step])
                mask[i:i + step] = np.maximum(d - high, low - d) <= bound[i:i + step, None] + SLACK
            # a vector within the bound scores as much; the bound is that of the k + 1st distinct one
            reach = rank_key(1 - (bound + SLACK) ** 2 / 2)
        else:
            mask = np.zeros((len(qm), len(here)), bool)
            step = max(1, _MASK // len(cells.pivots))
            for i in range(0, len(qm), step):
                mask[i:i + step] = cells.near(cells.distances(qm[i:i + step]), k)[:, here]
            reach = np.full(len(qm), -np.inf)
        order = np.argsort(cell, kind="stable")
        cm, tie, vkey = _unit_rows(_vectors(c.column("cvec"), dim))[order], c.column("least").to_numpy()[order], c.column("vkey").to_numpy()[order]
        cell = cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        starts = np.r_[starts, len(cell)]
        asked = [mask[:, np.searchsorted(here, cell[s])] for s in starts[:-1]]
        out = []
        for lo in range(0, len(qm), _QUERIES):                          # few queries, so that what is kept of them is merged in little time
            some = slice(lo, lo + _QUERIES)
            qs, floor = qm[some], reach[some].copy()
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            for s, e, m in zip(starts[:-1], starts[1:], asked):
                asks = np.flatnonzero(m[some])
                step = max(1, _CHUNK // (e - s))
                for i in range(0, len(asks), step):
                    rows = asks[i:i + step]
                    score = qs[rows] @ cm[s:e].T
                    hit = score >= floor[rows, None] - 10.0 ** -RANK_DECIMALS          # all that round to the floor or above
                    if score.shape[1] > k + 1 and np.count_nonzero(hit) > 2 * (k + 1) * len(rows):
                        hit &= score >= -np.partition(-score, k, axis=1)[:, k, None] - 2 * 10.0 ** -RANK_DECIMALS
                    r, col = np.nonzero(hit)
                    if not len(r):
                        continue
                    got = (np.r_[best[0], rows[r]], np.r_[best[1], score[r, col]], np.r_[best[2], col + s])
                    rank = np.lexsort((tie[got[2]], -rank_key(got[1]), got[0]))
                    got = tuple(x[rank] for x in got)
                    runs = np.flatnonzero(np.r_[True, got[0][1:] != got[0][:-1]])
                    place = np.arange(len(got[0])) - np.repeat(runs, np.diff(np.r_[runs, len(got[0])]))
                    best = tuple(x[place <= k] for x in got)
                    last = place[place <= k] == k
                    floor[best[0][last]] = np.maximum(floor[best[0][last]], rank_key(best[1][last]))
            out.append((best[0] + lo, best[1], best[2]))
        best = tuple(np.concatenate(x) for x in zip(*out))
        q1, q2 = q.column("q1").to_numpy(), q.column("q2").to_numpy()
        return pa.table([pa.array(q1[best[0]]), pa.array(q2[best[0]]), pa.array(vkey[best[2]]), pa.array(best[1])], names=names)
    return run


def pruned_knn(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str, query_vec: str, corpus_id: str, corpus_vec: str,
               exclude_self: bool = False, out_query_id: str = "query_id", out_corpus_id: str | None = None, decimals: int | None = 6,
               cells: int | None = None, block_bytes: int | None = None, query_rows: int = QUERY_ROWS, with_work: bool = False,
               seed: int = 23) -> DataFrame:
    """The rows of ``exact_knn``; with ``with_work`` also ``scored_share``, the share of distinct corpus vectors that a
    query was compared with, and ``copies``, the blocks it was sent to. Ids must be integers."""
    spark = queries.sparkSession
    ship_package(spark)
    out_corpus_id = out_corpus_id or corpus_id
    from vulnsift.session import checkpoint_dir
    checkpoint_dir(spark)
    keys = [F.xxhash64("qvec").alias("q1"), F.xxhash64(F.lit(1), "qvec").alias("q2")]
    q_rows = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("qvec")).where("qvec IS NOT NULL").distinct() \
        .select("qid", "qvec", *keys)
    kept = _distinct_corpus(corpus.select(F.col(corpus_id).cast("bigint").alias("cid"), F.col(corpus_vec).alias("vec")), k).checkpoint()
    body = kept.where(~_is_zero("vec"))
    n, dim = body.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    shape = "q1 bigint, q2 bigint, vkey bigint, score double"
    asked = q_rows.where(~_is_zero("qvec")).select("q1", "q2", "qvec").distinct()
    ids = kept.select(F.xxhash64("vec").alias("vkey"), "vec", "ids")
    if n:
        pivots = _pivots(body, n, dim, cells, seed)
        celled = _celled(body, pivots).withColumn("vkey", F.xxhash64("vec")).checkpoint()
        block_bytes = block_bytes or min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, 8 * dim * n // BLOCKS))
        held = spark.sparkContext.broadcast(_cells(celled, pivots, max(k + 1, block_bytes // (8 * dim))))
        cell_of = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(held.value.first, held.value.blocks))],
                                        "cell int, first int, blocks int")                       # at most MAX_CELLS rows
        rows = celled.join(F.broadcast(cell_of), "cell").select(
            (F.col("first") + F.pmod("vkey", F.col("blocks")).cast("int")).alias("in_block"), "cell", "least", "vkey", F.col("vec").alias("cvec"))
        vec_type = asked.schema["qvec"].dataType.simpleString()

        def met(qs: DataFrame, second: bool) -> tuple[DataFrame, DataFrame]:
            # the blocks of each query are found twice, so that they can be counted before a vector is copied
            counted = qs.mapInArrow(_counter(held, k, second), "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect()    # a row a block
            slices = spark.createDataFrame([(r.block, -(-r.n // query_rows)) for r in counted], "block int, slices int")
            sent = qs.mapInArrow(_sender(held, k, second), f"q1 bigint, q2 bigint, qvec {vec_type}, bound double, block int, pairs bigint")
            left = sent.join(F.broadcast(slices), "block").select("block", F.pmod("q2", F.col("slices")).cast("int").alias("slice"), "q1", "q2", "qvec", "bound")
            many = slices.select(F.col("block").alias("c_block"), F.col("slices").alias("c_slices"))
            right = rows.join(F.broadcast(many), F.col("in_block") == F.col("c_block")).select(
                "c_block", F.explode(F.sequence(F.lit(0), F.col("c_slices") - 1)).alias("c_slice"), "cell", "least", "vkey", "cvec")
            got = left.groupBy("block", "slice").cogroup(right.groupBy("c_block", "c_slice")).applyInArrow(_scorer(held, k, second), shape)
            return got, sent.groupBy("q1", "q2").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("copies"))

        one, work1 = met(asked.withColumn("bound", F.lit(0.0)), False)
        one = one.checkpoint()
        worst = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
        # the score of the k+1st distinct vector, as a distance; fewer than that bound nothing
        bound = one.withColumn("place", F.row_number().over(worst)).where(F.col("place") == k + 1) \
            .select("q1", "q2", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("bound"))
        bounded = asked.join(bound, ["q1", "q2"], "left").select("q1", "q2", "qvec", F.coalesce("bound", F.lit(2.0)).alias("bound")).checkpoint()
        two, work2 = met(bounded, True)
        cand = one.unionByName(two).groupBy("q1", "q2", "vkey").agg(F.max("score").alias("score"))
        work = work1.unionByName(work2).groupBy("q1", "q2").agg(F.sum("pairs").alias("pairs"), F.sum("copies").alias("copies"))
    else:
        cand, work = spark.createDataFrame([], shape), spark.createDataFrame([], "q1 bigint, q2 bigint, pairs bigint, copies bigint")
    best = Window.partitionBy("q1", "q2").orderBy(F.desc(F.round("score", RANK_DECIMALS)), "least")
    near = cand.join(ids.select("vkey", "ids", F.col("ids")[0].alias("least")), "vkey").withColumn("place", F.row_number().over(best)) \
        .where(F.col("place") <= k + 1).select("q1", "q2", "score", F.explode("ids").alias("cid"))

    def smallest(rows: DataFrame):
        """The ``k + 1`` smallest ids, as a column of their own rows with a score of 0."""
        got = [r.cid for r in rows.select(F.explode("ids").alias("cid")).orderBy("cid").limit(k + 1).collect()]
        return F.explode(F.array(*[F.lit(x) for x in got]).cast("array<bigint>")).alias("cid")

    zero = F.lit(0.0).alias("score")
    near = near.unionByName(asked.select("q1", "q2", zero, smallest(kept.where(_is_zero("vec")))))
    hits = q_rows.join(near, ["q1", "q2"])
    hits = hits.unionByName(q_rows.where(_is_zero("qvec")).select("q1", "q2", "qid", "qvec", zero, smallest(kept)))
    if exclude_self:
        hits = hits.where("cid <> qid")
    w = Window.partitionBy("qid", "q1", "q2").orderBy(F.desc(F.round("score", RANK_DECIMALS)), "cid")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if with_work:
        top = top.join(work, ["q1", "q2"], "left")
    shown = (lambda x: x) if decimals is None else (lambda x: F.round(x, decimals))
    extra = [F.round(F.coalesce("pairs", F.lit(0)) / max(n or 1, 1), 6).alias("scored_share"), F.coalesce("copies", F.lit(0)).alias("copies")]
    return top.select(F.col("qid").alias(out_query_id), F.col("rank").cast("bigint").alias("rank"), F.col("cid").alias(out_corpus_id),
                      shown(F.col("score")).alias("similarity"), shown(1.0 - F.col("score")).alias("distance"), *(extra if with_work else []))
