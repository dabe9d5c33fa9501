"""Attention pooling and vector algebra queries over ``embeddings``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vulnsift.functions.vectors import flatten_matrix, vadd, vmul, vslice
from vulnsift.operators.attention import HEAD_DIM, attention, by_head, concat_heads, project_qkv, sequence_attention
from vulnsift.operators.sequence import group_row_index, row_index
from vulnsift.plans.registry import query
from vulnsift.session import checkpoint_dir
from vulnsift.sources.tables import table
from vulnsift.sources.weights import random_weights, split_qkv, uniform_cell_sql

SEED = 7
SEQ_LEN = 64         # tokens of a sequence: stretches of a label's vectors


def _tokens(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("label"), "vec_id",
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _dim(spark, sf_dir) -> int:
    return table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0]


ATTN_SQL = f"""
WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding FROM embeddings),
t AS (SELECT label, i // {SEQ_LEN} AS seg, i % {SEQ_LEN} AS pos, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM n),
xe AS (SELECT label, seg, pos, unnest(range(len(x))) AS c, unnest(x) AS x FROM t),
dm AS (SELECT max(len(embedding)) AS dim FROM embeddings),
w AS (SELECT m, j, c, {uniform_cell_sql(SEED, '((j * dim + c) // 16)', '((j * dim + c) % 16 + 16 * m)')} AS w
      FROM dm, range(0, 3) a(m), range(0, 16) b(j), range(0, (SELECT dim FROM dm)) d(c)),
p AS (SELECT label, seg, pos, c // 16 AS head, m, j, sum(x * w) AS val FROM xe JOIN w USING (c) GROUP BY ALL),
s AS (SELECT q.label, q.seg, q.head, q.pos AS t, k.pos AS u, sum(q.val * k.val) / 4.0 AS s
      FROM p q JOIN p k ON q.label = k.label AND q.seg = k.seg AND q.head = k.head AND q.j = k.j
      WHERE q.m = 0 AND k.m = 1 GROUP BY ALL),
pr AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, seg, head, t)) AS e FROM s),
pn AS (SELECT label, seg, head, t, u, e / sum(e) OVER (PARTITION BY label, seg, head, t) AS p FROM pr),
o AS (SELECT pn.label, pn.seg, pn.t AS pos, pn.head, v.j, sum(pn.p * v.val) AS o FROM pn JOIN p v
      ON v.m = 2 AND v.label = pn.label AND v.seg = pn.seg AND v.head = pn.head AND v.pos = pn.u GROUP BY ALL)
SELECT CAST(o.label AS BIGINT) AS label, CAST(o.seg AS BIGINT) AS segment, CAST(o.pos AS BIGINT) AS pos, t.vec_id,
       list(round(o, 6) ORDER BY head, j) AS attn
FROM o JOIN t ON t.label = o.label AND t.seg = o.seg AND t.pos = o.pos GROUP BY o.label, o.seg, o.pos, t.vec_id"""


@query("attention_pool", ops=("A1", "A2", "A3", "A4", "A5", "J9", "G11", "X14", "S9", "S10", "D16", "D17"),
       sql=ATTN_SQL)
def attention_pool(spark, sf_dir):
    """Multi-head attention (heads of 16) over stretches of ``SEQ_LEN`` vectors of a label, by id; weights from the
    seeded generator, stored as a Parquet matrix and read back (dimension x 48: q, k, v slices)."""
    from vulnsift.sources.weights import read_weights, write_weights
    dim = _dim(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/weights-{uuid.uuid4().hex}"
    write_weights(random_weights(spark, dim, 3 * HEAD_DIM, SEED), path)
    w = split_qkv(read_weights(spark, path), HEAD_DIM)
    t = group_row_index(_tokens(spark, sf_dir), ["label"], ["vec_id"], out="i")
    t = t.withColumn("seq_id", F.struct("label", F.floor(F.col("i") / SEQ_LEN).alias("segment"))) \
        .withColumn("pos", F.col("i") % SEQ_LEN)
    flat = t.select(F.concat_ws(":", "label", "seq_id.segment").alias("seq_id"), "pos", "vec")
    out = sequence_attention(project_qkv(flat, w))
    key = t.select(F.concat_ws(":", "label", "seq_id.segment").alias("seq_id"), "pos", "label", "seq_id.segment", "vec_id")
    return out.join(key, ["seq_id", "pos"]).select(
        "label", "segment", "pos", "vec_id", F.transform("attn", lambda x: F.round(x, 6)).alias("attn"))


@query("attention_whole", ops=("A1", "A2", "A3", "A4", "A5", "J9", "G11"), sql=ATTN_SQL.replace(
    f"i // {SEQ_LEN} AS seg, i % {SEQ_LEN} AS pos", "0 AS seg, i AS pos").replace("CAST(o.seg AS BIGINT) AS segment, ", ""))
def attention_whole(spark, sf_dir):
    """The same attention over all vectors of a label as one sequence, however long: blocks of queries and keys, merged by
    log-sum-exp, so no task holds a sequence."""
    dim = _dim(spark, sf_dir)
    w = split_qkv(random_weights(spark, dim, 3 * HEAD_DIM, SEED), HEAD_DIM)
    t = group_row_index(_tokens(spark, sf_dir), ["label"], ["vec_id"], out="pos").withColumnRenamed("label", "seq_id")
    out = concat_heads(attention(by_head(project_qkv(t, w))))
    return out.join(t.select("seq_id", "pos", "vec_id"), ["seq_id", "pos"]).select(
        F.col("seq_id").alias("label"), "pos", "vec_id", F.transform("attn", lambda x: F.round(x, 6)).alias("attn"))


@query("vector_algebra", ops=("X15", "X16", "X17", "P17", "G10"), sql="""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = (SELECT min(vec_id) FROM e WHERE vec_id > x.vec_id))
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] + z[2])), 6) AS sum_add,
       round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 6) AS dot,
       round(list_sum(a[1:16]), 6) AS head0_sum, len(flatten([a, b])) AS flat_len
FROM p""")
def vector_algebra(spark, sf_dir):
    """Element-wise add and multiply of each vector with the next one (by id), the first
    16-wide slice, and the row-major flatten of the pair."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    ordered = row_index(e, ["vec_id"], out="rn")
    p = ordered.alias("x").join(ordered.alias("y"), F.col("y.rn") == F.col("x.rn") + 1) \
        .select(F.col("x.vec_id").alias("vec_id"), F.col("x.a").alias("a"), F.col("y.a").alias("b"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    return p.select("vec_id", F.round(total(vadd("a", "b")), 6).alias("sum_add"),
                    F.round(total(vmul("a", "b")), 6).alias("dot"),
                    F.round(total(vslice("a", 0, 16)), 6).alias("head0_sum"),
                    F.size(flatten_matrix(F.array("a", "b"))).cast("bigint").alias("flat_len"))
