"""MinHash near-dedup with DartMinHash signatures.

1. One pass over the texts gives each a content hash, its number of shingles (five words: runs of
   letters and digits, lower case) and ``BANDS`` band keys of its DartMinHash signature (see ``dart``).
   Equal texts are one node from here on, however many copies there are.
2. A band key that several nodes share is a bucket. Buckets are never expanded into pairs: every
   member is compared with the bucket's pivot (the member with the most copies). Comparing is
   exact: Jaccard similarity of the two shingle sets, ``THRESHOLD`` or more is a link.
3. Links give components. Buckets whose members now are all in one component are done. For the others, the
   rest is exact too: two members of different components are compared unless a bound proves that they
   are no link. The bounds: set sizes; the distances of both to the pivot (Jaccard distance obeys the triangle
   inequality); and the shingles of each that no other candidate has. A pair is met only in the first band
   that it shares.
4. Components of all links give the class of every row: the smallest ``doc_id`` in it.

With six rows a band and 24 bands, two texts of similarity 0.8 meet with probability 0.9993, of
0.9 with 1 - 1e-8.

Weights: a shingle's region has the weight 1 (``weighting="set"``, the similarity of shingle sets) or its
number of occurrences (``"count"``: candidates by weighted similarity, links by the set similarity all the same).

Defined cases: null text is the empty text; texts of one to four words have one shingle; texts without
words are near no other text, but equal texts are always one class; repeated rows and null ids are classed
like others (a class of null ids only has the class null); ties cannot arise (a class is a minimum); an empty table
gives no rows; other columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm import dart
from vulnsift.llm.common import cut, id_text, written
from vulnsift.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 24
BATCH_CHARS = 1_000_000
_WORD = re.compile(r"\w+")


class _WordHash(dict):
    """Word -> 64-bit hash, remembered; emptied between batches when it is large."""

    def __missing__(self, w):
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode())
        return h


_HASHES = _WordHash()


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle hash, count): the distinct shingles of every text, ordered by both."""
    if len(_HASHES) > 200_000:
        _HASHES.clear()
    flat: list[int] = []
    lens = []
    for t in texts:
        w = _WORD.findall(t.lower())
        lens.append(len(w))
        flat += map(_HASHES.__getitem__, w)
        if 0 < len(w) < SHINGLE:                    # a short text is one shingle
            flat += [0] * (SHINGLE - len(w))
            lens[-1] = SHINGLE
    n = np.array(lens, dtype=np.int64)
    h = np.array(flat, dtype=np.uint64)
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), np.maximum(n - SHINGLE + 1, 0))
    if not len(owner):
        return owner, np.zeros(0, dtype=np.uint64), np.zeros(0)
    m = np.maximum(n - SHINGLE + 1, 0)
    first = start[owner] + np.arange(len(owner)) - (np.cumsum(m) - m)[owner]
    s = np.zeros(len(owner), dtype=np.uint64)
    for i in range(SHINGLE):
        s = dart.mix(s * np.uint64(0x9E3779B97F4A7C15) + h[first + i])
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    return owner[new], s[new], np.diff(np.r_[new, len(s)]).astype(float)


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in batches of bounded length."""
    at, chars, texts = 0, 0, []
    for i in range(len(column)):
        t = column[i].as_py()
        texts.append(t)
        chars += len(t)
        if chars > BATCH_CHARS:
            yield at, texts
            at, chars, texts = i + 1, 0, []
    if texts:
        yield at, texts


def _sign(weighting: str):
    def run(batches):
        for b in batches:
            for at, texts in _batches(b.column(1)):
                owner, s, count = shingle_sets(texts)
                sig = dart.signatures(owner, s, count if weighting == "count" else np.ones(len(s)), len(texts), ROWS * BANDS)
                key = np.zeros((len(texts), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    key = dart.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                n = np.bincount(owner, minlength=len(texts))
                has = n > 0
                offsets = np.r_[0, np.cumsum(np.where(has, BANDS, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(texts)),
                    pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary()),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[has].reshape(-1).view(np.int64)))],
                    ["doc_id", "h", "n", "bands"])
    return run


def content_hash(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def signed(docs: DataFrame, weighting: str = "set", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, h, n, bands`` of every row."""
    src = id_text(docs, text, id_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_sign(weighting), f"doc_id {kind}, h binary, n int, bands array<bigint>")


def _shingles(batches):
    for b in batches:
        for at, texts in _batches(b.column(1)):
            owner, s, _ = shingle_sets(texts)
            offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(s.view(np.int64)))], ["h", "s"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, j``: exact Jaccard similarity of every pair."""
    left = sets.select(F.col("h").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("h").alias("b"), F.col("s").alias("sb"))
    met = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("j"))


def classes(table: DataFrame, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``h, comp``: the component of every node that has a link. ``table`` is a stored ``signed(docs)``."""
    nodes = table.where("n > 0").groupBy("h").agg(F.first("n").alias("n"), F.first("bands").alias("bands"),
                                                  F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"))
    # rank of a node as a pivot: most copies first, then by hash; one number, so that it aggregates by hash
    rank = F.least("copies", F.lit(1 << 20)) * F.lit(1 << 42) + F.shiftrightunsigned(F.xxhash64("h"), 22)
    rows = written(nodes.select("h", "n", rank.alias("rank"), "bands", "low"), "nodes")
    spread = rows.select("h", "rank", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.max("rank").alias("top")) \
        .where("members > 1").drop("members")
    members = written(spread.join(buckets, ["band", "key"]), "members")
    pivots = members.where("rank = top").select("band", "key", F.col("h").alias("b"))
    star = members.join(pivots, ["band", "key"]).where("h <> b").select(F.col("h").alias("a"), "b").distinct()

    # shingle sets of the nodes that share a bucket
    # one copy of each: the one with the lowest id, so that copies of a text are not dealt to one task
    near = rows.join(members.select("h").distinct(), "h", "left_semi").select(F.col("low").alias("k"), "h")
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("h", content_hash(F.col("text")))
    wanted = texts.join(near, texts["k"].eqNullSafe(near["k"]) & (texts["h"] == near["h"]), "left_semi").select("h", "text")
    sets = written(wanted.dropDuplicates(["h"]).mapInArrow(_shingles, "h binary, s array<bigint>"), "shingles")

    compared = cut(_similar(star, sets))
    links = compared.where(F.col("j") >= THRESHOLD).select("a", "b")
    comp = components(links)

    # members of buckets that still hold several components
    placed = members.join(comp.withColumnRenamed("node", "h"), "h", "left") \
        .select("band", "key", "h", F.coalesce("comp", "h").alias("comp"))
    open_buckets = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where("lo <> hi").select("band", "key")
    left = cut(placed.join(open_buckets, ["band", "key"]))
    # shingles of a node that no other candidate node has: they cannot be in any intersection
    open_nodes = left.select("h").distinct()
    open_sets = sets.join(open_nodes, "h")
    occur = open_sets.select("h", F.explode("s").alias("x")).groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).where("n = 1")
    own = occur.groupBy("h").agg(F.count(F.lit(1)).alias("own"))
    facts = rows.join(open_nodes, "h", "left_semi").join(own, "h", "left") \
        .select("h", "n", "bands", F.coalesce("own", F.lit(0)).alias("own")).where(F.col("own") <= (1 - THRESHOLD) * F.col("n") + 1e-9)
    at_pivot = compared.select(F.col("a").alias("h"), F.col("b").alias("pivot"), (1 - F.col("j")).alias("d"))
    side = left.join(pivots.withColumnRenamed("b", "pivot"), ["band", "key"]).join(at_pivot, ["h", "pivot"], "left") \
        .join(facts, "h").select("band", "key", "h", "comp", "n", "own", "bands", F.coalesce("d", F.lit(0.0)).alias("d"))
    side = cut(side)
    x, y = side.alias("x"), side.alias("y")
    shared = F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own"))
    together = F.greatest(F.col("x.n") + F.col("y.own"), F.col("y.n") + F.col("x.own"), F.col("x.n") + F.col("y.n") - shared)
    earlier = F.exists(F.zip_with(F.slice("x.bands", F.lit(1), F.col("x.band")), F.slice("y.bands", F.lit(1), F.col("y.band")),
                                  lambda p, q: p == q), lambda e: e)
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
                  & (F.col("x.h") < F.col("y.h")) & (F.col("x.comp") != F.col("y.comp"))
                  & (shared >= THRESHOLD * together - 1e-9)
                  & (F.abs(F.col("x.d") - F.col("y.d")) <= 1 - THRESHOLD + 1e-9) & ~earlier) \
        .select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
    more = _similar(rest, sets).where(F.col("j") >= THRESHOLD).select("a", "b")
    joined = comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)
    return components(joined).withColumnRenamed("node", "h")


def near_duplicates(docs: DataFrame, weighting: str = "set", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, class_id`` of every row."""
    return _classed(docs, weighting, text, id_col).select("doc_id", "class_id")


def _classed(docs: DataFrame, weighting: str, text: str, id_col: str) -> DataFrame:
    table = written(signed(docs, weighting, text, id_col), "signed")
    comp = classes(table, docs, text, id_col)
    rows = table.select("doc_id", "h")
    # the smallest id per text first (copies collapse map-side), then per component
    per_text = rows.groupBy("h").agg(F.min("doc_id").alias("low")).join(comp, "h", "left") \
        .select("h", F.coalesce("comp", "h").alias("comp"), "low")
    per_text = cut(per_text)
    per_class = per_text.groupBy("comp").agg(F.min("low").alias("class_id"))
    named = per_text.join(per_class, "comp").select("h", "class_id")
    return rows.join(named, "h")


def deduplicate(docs: DataFrame, weighting: str = "set", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of every class, with all its columns: that of the smallest id (of the smallest content hash, should
    that id have several texts); of rows with equal id and text one stays. Classes of null ids keep one row each."""
    classed = _classed(docs, weighting, text, id_col)
    best = classed.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("class_id", "h").distinct()
    first = best.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min("h").alias("h")) \
        .unionByName(best.where("class_id IS NULL"))
    keep = first.select(F.col("class_id").alias("_dd_id"), F.col("h").alias("_dd_h"))
    keyed = docs.withColumn("_dd_hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    kept = keyed.join(keep, F.col(id_col).eqNullSafe(F.col("_dd_id")) & (F.col("_dd_hash") == F.col("_dd_h")), "left_semi")
    # the join has already dealt and sorted the rows by id and hash, so this adds no shuffle
    each = Window.partitionBy(id_col, "_dd_hash").orderBy(id_col, "_dd_hash")
    return kept.withColumn("_dd_row", F.row_number().over(each)).where("_dd_row = 1") \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
