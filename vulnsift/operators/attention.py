"""Multi-head scaled dot-product attention over token-vector sequences.

Intended semantics (the reference kernels take a square root of the score and add instead of weighting
values; here it is ``softmax(q·k / sqrt(16)) · v``):

* A1 projection: one matrix product per Arrow batch, no shuffle. A stored weight slice (dim x 16 floats) is read
  row by row as a 16 x dim matrix, ``W[j, 16h+i]``. The weights are measured, then sent to the tasks once.
* ``sequence_attention``: sequences of bounded length, one group each, one shuffle.
* ``attention``: sequences of any length. Queries and keys are cut into blocks of ``block`` tokens; every (query
  block, key block) pair is one cogroup, scored into online-softmax partials that a log-sum-exp rescale merges.
  Work is the inherent O(L^2), memory per task O(block^2).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.operators.knn import _vectors
from vulnsift.session import ship_package

HEAD_DIM = 16
WEIGHT_BYTES = 64 << 20
_WIDE = "q array<double>, k array<double>, v array<double>"


def _list(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=np.float64)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1)))


def project_qkv(tokens: DataFrame, weights: DataFrame, vec: str = "vec", head_dim: int = HEAD_DIM) -> DataFrame:
    """A1: ``q[t, 16h+j] = Σ_i x[t, 16h+i] · W[j, 16h+i]`` for every head, k and v alike.

    ``tokens``: (seq_id, pos, vec array); ``weights``: (r, wq, wk, wv), one row per input dimension.
    Result: (seq_id, pos, q, k, v), each as wide as the vector."""
    spark = tokens.sparkSession
    ship_package(spark)
    size = weights.agg(F.sum(F.size("wq") + F.size("wk") + F.size("wv"))).first()[0] or 0
    if 8 * size > WEIGHT_BYTES:
        raise ValueError(f"weights of {8 * size} bytes are more than the {WEIGHT_BYTES} that are sent to every task")
    w = weights.orderBy("r").toArrow()
    dim = w.num_rows
    held = spark.sparkContext.broadcast([_vectors(w.column(m), head_dim).reshape(head_dim, dim) for m in ("wq", "wk", "wv")])

    def run(batches):
        for b in batches:
            x = _vectors(b.column(2), dim).reshape(b.num_rows, -1, head_dim)                  # token, head, i
            out = [np.einsum("nhi,jhi->nhj", x, m.reshape(head_dim, -1, head_dim)).reshape(b.num_rows, dim) for m in held.value]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(_list, out)], ["seq_id", "pos", "q", "k", "v"])

    return tokens.select("seq_id", F.col("pos").cast("bigint").alias("pos"), vec).mapInArrow(
        run, f"seq_id {tokens.schema['seq_id'].dataType.simpleString()}, pos bigint, {_WIDE}")


def sequence_attention(proj: DataFrame, head_dim: int = HEAD_DIM) -> DataFrame:
    """A2-A5 for sequences of bounded length: (seq_id, pos, attn) with the heads side by side."""
    kind = proj.schema["seq_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        wide = len(t.column("q")[0])
        q, k, v = (_vectors(t.column(m), wide).reshape(t.num_rows, -1, head_dim) for m in "qkv")
        s = np.einsum("thd,uhd->htu", q, k) / math.sqrt(head_dim)
        e = np.exp(s - s.max(axis=2, keepdims=True))
        o = np.einsum("htu,uhd->thd", e / e.sum(axis=2, keepdims=True), v)
        return pa.table([t.column("seq_id"), t.column("pos"), _list(o.reshape(t.num_rows, wide))], ["seq_id", "pos", "attn"])

    return proj.groupBy("seq_id").applyInArrow(run, f"seq_id {kind}, pos bigint, attn array<double>")


def by_head(proj: DataFrame, head_dim: int = HEAD_DIM) -> DataFrame:
    """One row per token and head: (seq_id, pos, head, q, k, v)."""
    heads = F.sequence(F.lit(0), (F.size("q") / head_dim).cast("int") - 1)
    part = lambda c: F.slice(c, F.col("head") * head_dim + 1, F.lit(head_dim)).alias(c)
    return proj.withColumn("head", F.explode(heads)).select("seq_id", "pos", "head", part("q"), part("k"), part("v"))


def _partials(scale: float):
    def run(qdf: pd.DataFrame, kdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or kdf.empty:
            return pd.DataFrame({"seq_id": [], "head": [], "pos": [], "m": [], "l": [], "o": []})
        q = np.stack(qdf["q"].to_numpy()).astype(np.float64)
        k = np.stack(kdf["k"].to_numpy()).astype(np.float64)
        v = np.stack(kdf["v"].to_numpy()).astype(np.float64)
        s = (q @ k.T) * scale
        m = s.max(axis=1)
        e = np.exp(s - m[:, None])
        return pd.DataFrame({"seq_id": qdf["seq_id"].to_numpy(), "head": qdf["head"].to_numpy(),
                             "pos": qdf["pos"].to_numpy(), "m": m, "l": e.sum(axis=1), "o": list(e @ v)})
    return run


def attention(proj: DataFrame, block: int = 128, head_dim: int = HEAD_DIM) -> DataFrame:
    """A2-A5: per token and head, ``Σ_u softmax_u(q_t·k_u / sqrt(d)) v_u`` within its sequence.
    Result: (seq_id, pos, head, out array<double>(16))."""
    ship_package(proj.sparkSession)
    scale = 1.0 / math.sqrt(head_dim)
    nblk = proj.groupBy("seq_id").agg(
        (F.floor(F.max("pos") / block) + 1).cast("int").alias("nb"))
    p = proj.withColumn("blk", F.floor(F.col("pos") / block).cast("int")).join(nblk, "seq_id")
    qside = p.select("seq_id", "head", F.col("blk").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("kb"),
                     "pos", "q")
    kside = p.select(F.col("seq_id").alias("k_seq_id"), F.col("head").alias("k_head"), F.col("blk").alias("k_kb"),
                     F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k_qb"), F.col("pos").alias("k_pos"),
                     "k", "v")
    keys = ["seq_id", "head", "qb", "kb"]
    parts = qside.groupBy(*keys).cogroup(kside.groupBy("k_seq_id", "k_head", "k_qb", "k_kb")).applyInPandas(
        _partials(scale), "seq_id long, head int, pos long, m double, l double, o array<double>")
    w = Window.partitionBy("seq_id", "head", "pos")
    r = parts.withColumn("mx", F.max("m").over(w)).withColumn("f", F.exp(F.col("m") - F.col("mx")))
    agg = r.groupBy("seq_id", "head", "pos").agg(
        F.sum(F.col("l") * F.col("f")).alias("l"),
        *[F.sum(F.col("o")[i] * F.col("f")).alias(f"o{i}") for i in range(head_dim)])
    return agg.select("seq_id", "pos", "head",
                      F.array(*[F.col(f"o{i}") / F.col("l") for i in range(head_dim)]).alias("out"))


def concat_heads(out: DataFrame) -> DataFrame:
    """A5: one row per token with the head outputs concatenated in head order (bounded by the
    number of heads)."""
    g = out.groupBy("seq_id", "pos").agg(F.array_sort(F.collect_list(F.struct("head", "out"))).alias("hs"))
    return g.select("seq_id", "pos", F.flatten(F.transform("hs", lambda s: s["out"])).alias("attn"))
