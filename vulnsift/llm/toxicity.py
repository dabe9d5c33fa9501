"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

* A word (a lower-cased run of ASCII letters and digits and of all other non-ASCII characters) is embedded as the sum of the rows
  of three hash buckets: the word, its first four and its first five characters; so words of one stem are alike.
* Filters of ``WIDTHS`` words slide over the whole text; each keeps its greatest positive answer, and a logistic unit
  weighs these answers. A text without words has answers of 0.
* Training reads every labelled text outside the held-out fold, whole. Texts are dealt by a hash of their id into shards of about
  ``SHARD_BYTES``, a task each. The first coordinate of a bucket starts at its log odds in all toxic texts, the rest at random; then, epoch
  by epoch, each shard takes its gradient steps from the same network, and the networks are averaged (a bucket over the shards that
  moved it). Gradients flow through the places of the maxima into filters and embeddings. What meets at the driver is one network of
  fixed size; a corpus of one shard is trained in one go.
* ``CALIBRATE`` in a hundred of the labelled texts are kept out of training. On all of these a threshold is chosen for each language (the best F1; the
  common one for languages with fewer than ``FEW`` texts of either class) and reported with its verdict, ``flagged``. The language
  chooses the threshold only and is no input of the score; ``predicted`` uses the fixed ``THRESHOLD`` for all.

Scoring is one narrow scan: slabs of whole texts or overlapping windows of very long ones, and a broadcast model of fixed size.

Defined cases: null text is empty and gets a score like any other; without labels every score is 0.5, with labels
of one class it is the smoothed prior; null labels and labels other than 0 and 1 are skipped, contradictory ones both count; a null
id counts as the empty id; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm import rolling
from vulnsift.llm.common import cut, written
from vulnsift.llm.wordruns import Words, byte_classes, slabs
from vulnsift.session import ship_package

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
SHARD_BYTES = 8 << 20
FEW_IDS = 1_000_000
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.5, 7
CALIBRATE = 20
FEW = 5
SLAB = 1 << 20
BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)
KINDS = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()), b"")


# -- words to buckets -------------------------------------------------------------------------------

def word_buckets(vocab: np.ndarray, cuts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word and of its first characters; bucket 0 stands for a prefix that the word is too short for."""
    n = len(cuts) - 1
    out = np.zeros((n, 1 + len(PREFIXES)), np.int64)
    if not n:
        return out
    out[:, 0] = _bucket(rolling.word_hashes(vocab, cuts, 1)[0], 0, buckets)
    opens = (vocab & 0xC0) != 0x80                                  # first byte of a character
    before = np.r_[0, np.cumsum(opens)]
    of = np.repeat(np.arange(n), np.diff(cuts))
    nth = before[1:] - before[cuts[of]]                             # which character of its word a byte belongs to
    chars = before[cuts[1:]] - before[cuts[:-1]]
    for j, k in enumerate(PREFIXES, 1):
        part = nth <= k
        sizes = np.bincount(of[part], minlength=n)
        h = rolling.word_hashes(vocab[part], np.r_[0, np.cumsum(sizes)], 1)[0]
        out[:, j] = np.where(chars >= k, _bucket(h, j, buckets), 0)
    return out


def _bucket(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    mixed = (h.astype(np.uint64) + np.uint64(salt * 0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
    return 1 + ((mixed >> np.uint64(33)) % np.uint64(buckets - 1)).astype(np.int64)


# -- the network ----------------------------------------------------------------------------------------

def _product(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """``x @ f`` with every row summed in one order: a matrix product may round a row differently by the rows around it, and the score
    of a text must not depend on the batch it came in."""
    out = x[:, :1] * f[0]
    for i in range(1, len(f)):
        out += x[:, i:i + 1] * f[i]
    return out


@dataclass
class Network:
    embed: np.ndarray                   # buckets x DIM, row 0 is zero
    filters: list[np.ndarray]           # for each width: width x DIM x FILTERS
    offset: list[np.ndarray]            # for each width: FILTERS
    weights: np.ndarray                 # len(WIDTHS) * FILTERS
    bias: float

    def answers(self, w: Words) -> np.ndarray:
        """For every word the answer of every filter that ends there; words before the text count as zero."""
        vectors = self.embed[word_buckets(w.vocab, w.cuts, len(self.embed))].sum(1)
        return self.slide(vectors, w.ids, w.row)

    def slide(self, vectors: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), len(self.weights)), np.float32)
        for k, (width, f, b) in enumerate(zip(WIDTHS, self.filters, self.offset)):
            part = out[:, k * FILTERS:(k + 1) * FILTERS]
            part[:] = b
            for back in range(width):
                answer = _product(vectors, f[width - 1 - back])
                if not back:
                    part += answer[ids]
                else:
                    here = np.flatnonzero(row[back:] == row[:-back]) + back
                    part[here] += answer[ids[here - back]]
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip((pooled.astype(np.float64) * self.weights).sum(1) + self.bias, -500, 500)))

    def score(self, texts: pa.Array) -> np.ndarray:
        pooled = np.zeros((len(texts), len(self.weights)), np.float32)
        for w in slabs(texts, KINDS, max(WIDTHS) - 1, limit=SLAB):
            if len(w.ids):
                a = self.answers(w)
                a[~w.fresh] = 0
                starts = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
                rows = w.row[starts]
                pooled[rows] = np.maximum(pooled[rows], np.maximum.reduceat(a, starts, axis=0))
        return self.probability(pooled)


def start(buckets_of_docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, buckets: int = BUCKETS) -> Network:
    """The network before training: log odds of each bucket in the first coordinate, small random numbers elsewhere."""
    return _from_counts(_seen(buckets_of_docs, y, buckets), float(y.sum()), len(y), rng)


def _seen(buckets_of_docs: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    seen = np.zeros((2, buckets))
    for b, label in zip(buckets_of_docs, y):
        seen[int(label), b] += 1
    return seen


def _from_counts(seen: np.ndarray, n1: float, n: int, rng: np.random.Generator) -> Network:
    buckets = seen.shape[1]
    share = n1 / n
    odds = np.log((seen[1] + 2.0) / (seen.sum(0) * share + 2.0)) - np.log((seen[0] + 2.0) / (seen.sum(0) * (1 - share) + 2.0))
    embed = rng.standard_normal((buckets, DIM), np.float32) * np.float32(0.02)
    embed[:, 0] = np.clip(odds, -4, 4)
    embed[0] = 0
    filters, offset = [], []
    for width in WIDTHS:
        f = rng.normal(0, 0.1, (width, DIM, FILTERS)).astype(np.float32)
        f[:, 0] = np.abs(rng.normal(1 / width, 0.2 / width, (width, FILTERS)))
        filters.append(f)
        offset.append(np.full(FILTERS, -0.5, np.float32))
    size = len(WIDTHS) * FILTERS
    return Network(embed, filters, offset, np.full(size, 2.0 / size), -1.0)


def step(net: Network, vectors, words, ids, bounds, y, rate: float) -> float:
    """One gradient step on a batch of texts: ``ids[bounds[i]:bounds[i + 1]]`` are the words of text i, as places in ``words``
    (buckets of each distinct word). Returns the mean loss."""
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = net.slide(vectors, ids, row)
    at = np.zeros((n, out.shape[1]), np.int64)
    pooled = np.zeros((n, out.shape[1]))
    for i in np.flatnonzero(np.diff(bounds)):
        part = out[bounds[i]:bounds[i + 1]]
        best = part.argmax(0)
        at[i] = best + bounds[i]
        pooled[i] = part[best, np.arange(part.shape[1])]
    pooled = np.maximum(pooled, 0)
    p = net.probability(pooled)
    loss = -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-12))
    d = (p - y) / n
    back = d[:, None] * net.weights * (pooled > 0)
    net.weights = net.weights - rate * (d @ pooled)
    net.bias -= rate * d.sum()
    moved = np.zeros_like(vectors)
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g, pos = back[:, cols], at[:, cols]
        old = net.filters[k].copy()
        net.offset[k] -= (rate * g.sum(0)).astype(np.float32)
        for b in range(width):
            there = pos - b
            ok = (there >= bounds[:-1, None]) & (g != 0)
            doc, f = np.nonzero(ok)
            if not len(doc):
                continue
            word, strength = ids[there[doc, f]], g[doc, f][:, None]
            change = np.zeros((FILTERS, vectors.shape[1]))
            np.add.at(change, f, strength * vectors[word])
            net.filters[k][width - 1 - b] -= (rate * change.T).astype(np.float32)
            np.add.at(moved, word, strength * old[width - 1 - b].T[f])
    touched = np.flatnonzero(moved.any(1))
    for j in range(words.shape[1]):
        np.add.at(net.embed, words[touched, j], (-rate * moved[touched]).astype(np.float32))
    net.embed[0] = 0
    return float(loss)


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, code = np.unique(values, return_index=True, return_inverse=True)
    return code, first


def _constant(n1: float, n: int) -> Network:
    """Without texts of both classes: the smoothed prior for all."""
    return Network(np.zeros((2, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros(len(WIDTHS) * FILTERS), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))


def _prepared(texts: pa.Array, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of each distinct word, and the words of every text as places in that table."""
    tables, docs, known = [], [[] for _ in range(len(texts))], 0
    for w in slabs(texts, KINDS, 0, limit=SLAB):
        starts = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]]) if len(w.ids) else np.zeros(0, np.int64)
        ids = (w.ids + known).astype(np.int32)
        for s, e in zip(starts, np.r_[starts[1:], len(ids)]):
            docs[w.row[s]].append(ids[s:e])
        tables.append(word_buckets(w.vocab, w.cuts, buckets).astype(np.int32))
        known += len(tables[-1])
    words = np.concatenate(tables) if tables else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    same, first = _codes(words.astype(np.int64) @ (buckets ** np.arange(words.shape[1])))       # words of many slabs
    return words[first], [same[np.concatenate(d)] if d else np.zeros(0, np.int64) for d in docs]


def _epoch(net: Network, words: np.ndarray, ids_of: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, batch: int, rate: float) -> None:
    n = len(y)
    for part in np.array_split(rng.permutation(n), max(1, n // batch)):
        bounds = np.r_[0, np.cumsum([len(ids_of[i]) for i in part])]
        used, ids = np.unique(np.concatenate([ids_of[i] for i in part]), return_inverse=True)
        buckets_used = words[used]
        step(net, net.embed[buckets_used].sum(1), buckets_used, ids, bounds, y[part], rate)


def _doc_buckets(words: np.ndarray, ids_of: list[np.ndarray]) -> list[np.ndarray]:
    return [np.unique(words[np.unique(d)]) for d in ids_of]


def train(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED,
          buckets: int = BUCKETS) -> Network:
    """Fit the network to labelled texts that one task holds."""
    rng = np.random.default_rng(seed)
    n, n1 = len(y), float(y.sum())
    if not 0 < n1 < n:
        return _constant(n1, n)
    words, ids_of = _prepared(texts, buckets)
    net = start(_doc_buckets(words, ids_of), y, rng, buckets)
    for epoch in range(epochs):
        _epoch(net, words, ids_of, y, rng, batch, rate / (1 + epoch))
    return net


# -- training by shards -----------------------------------------------------------------------------------

def _packed(net: Network) -> np.ndarray:
    """All parameters as rows of ``DIM`` numbers: the buckets first, then the others."""
    rest = np.concatenate([*[f.ravel() for f in net.filters], *net.offset, net.weights, [net.bias]]).astype(np.float64)
    return np.concatenate([net.embed.astype(np.float64), np.r_[rest, np.zeros(-len(rest) % DIM)].reshape(-1, DIM)])


def _unpacked(rows: np.ndarray, buckets: int) -> Network:
    rest, at = rows[buckets:].ravel(), 0
    parts = []
    for shape in [*[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (len(WIDTHS) * FILTERS,), (1,)]:
        size = int(np.prod(shape))
        parts.append(rest[at:at + size].reshape(shape))
        at += size
    k = len(WIDTHS)
    return Network(rows[:buckets].astype(np.float32), [f.astype(np.float32) for f in parts[:k]], [o.astype(np.float32) for o in parts[k:2 * k]],
                   parts[2 * k].copy(), float(parts[2 * k + 1][0]))


_ROW = "place int, " + ", ".join(f"v{i} double" for i in range(DIM))


def _shard(t: pa.Table) -> tuple[pa.Array, np.ndarray, int]:
    t = t.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return t.column("text").combine_chunks(), t.column("y").to_numpy().astype(np.float64), t.column("shard")[0].as_py()


def _each_shard(work):
    """``work`` on one shard after the other of a partition that is sorted by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for b in batches:
            ids = b.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for s, e in zip(starts, np.r_[starts[1:], len(ids)]):
                if held and of != ids[s]:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                of = ids[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()
    return run


def _rows_of(places: np.ndarray, values: np.ndarray) -> pa.Table:
    return pa.table([pa.array(places.astype(np.int32)), *[pa.array(np.ascontiguousarray(c, np.float64)) for c in values.T]],
                    names=["place", *[f"v{i}" for i in range(values.shape[1])]])


def train_shards(t: DataFrame, shards: int, n: int, n1: float, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED,
                 buckets: int = BUCKETS) -> Network:
    """Fit the network to ``shard, doc_id, text, y`` of any number of shards; every text takes part in every epoch."""
    if not 0 < n1 < n:
        return _constant(n1, n)
    if shards == 1:
        def whole(part: pa.Table) -> pa.Table:
            texts, y, _ = _shard(part)
            rows = _packed(train(texts, y, epochs, batch, rate, seed, buckets))
            return _rows_of(np.arange(len(rows)), rows)
        got = t.groupBy("shard").applyInArrow(whole, _ROW).toArrow().sort_by("place")
        return _unpacked(np.stack([got.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1), buckets)

    def seen(part: pa.Table) -> pa.Table:
        texts, y, _ = _shard(part)
        counts = _seen(_doc_buckets(*_prepared(texts, buckets)), y, buckets)
        places = np.flatnonzero(counts.any(0))
        return _rows_of(places, counts[:, places].T)

    # dealt and stored once: a partition holds whole shards, which every round finds in place
    dealt = cut(t.repartition(shards, "shard").sortWithinPartitions("shard"))
    got = dealt.mapInArrow(_each_shard(seen), "place int, v0 double, v1 double").groupBy("place").agg(F.sum("v0").alias("v0"), F.sum("v1").alias("v1")).toArrow()
    counts = np.zeros((2, buckets))
    counts[:, got.column("place").to_numpy()] = got.column("v0").to_numpy(), got.column("v1").to_numpy()
    net = _from_counts(counts, n1, n, np.random.default_rng(seed))
    sc = t.sparkSession.sparkContext
    for epoch in range(epochs):
        held = sc.broadcast(_packed(net))                           # read by this epoch's job only, which ends below

        def moved(part: pa.Table) -> pa.Table:
            texts, y, shard = _shard(part)
            own = _unpacked(held.value, buckets)
            _epoch(own, *_prepared(texts, buckets), y, np.random.default_rng([seed, epoch, shard]), batch, rate / (1 + epoch))
            change = _packed(own) - held.value
            places = np.r_[np.flatnonzero(change[:buckets].any(1)), np.arange(buckets, len(change))]
            return _rows_of(places, change[places])

        mean = dealt.mapInArrow(_each_shard(moved), _ROW).groupBy("place").agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toArrow()
        rows = _packed(net)
        rows[mean.column("place").to_numpy()] += np.stack([mean.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1)
        net = _unpacked(rows, buckets)
        held.unpersist()
    return net


# -- the operator -------------------------------------------------------------------------------------------

def held_out(id_col: str = "doc_id"):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``doc_id, text, lang, y, kept_out`` of every labelled text. Few ids (counted) are broadcast, so that texts need no shuffle."""
    known = cut(labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
                .select("doc_id", F.col("toxic").cast("int").alias("y")).distinct())
    t = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"),
                    (F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")).alias("lang"))
    met = t.join(F.broadcast(known) if known.count() <= FEW_IDS else known, "doc_id")
    return met.select("doc_id", "text", "lang", "y", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(100)) < CALIBRATE).alias("kept_out"))


def best_threshold(p: np.ndarray, y: np.ndarray, fallback: float) -> float:
    """The threshold of the best F1, in the middle of its gap; ``fallback`` if either class has fewer than ``FEW`` texts."""
    if y.sum() < FEW or len(y) - y.sum() < FEW:
        return fallback
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1                                   # equal scores are not parted
    k = int(f1.argmax())
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


def best_thresholds(scored: DataFrame, fallback: float) -> tuple[dict[str, float], float]:
    """:func:`best_threshold` of ``lang, y, p`` by language, and the common one, without a group in one task: equal scores are one row, rows
    are sorted by range, and each partition's running sums start at the sums of those before it."""
    every = scored.select(F.lit(None).cast("string").alias("lang"), "y", "p").unionByName(scored.where("lang IS NOT NULL"))
    equal = every.groupBy("lang", "p").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))
    rows = cut(equal.repartitionByRange("lang", F.desc("p")).sortWithinPartitions("lang", F.desc("p")).withColumn("at", F.spark_partition_id()))
    of = rows.groupBy("lang", "at").agg(F.sum("hits").alias("part_hits"), F.sum("n").alias("part_n"))
    before = Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang")
    sums = of.select("lang", "at", F.coalesce(F.sum("part_hits").over(before), F.lit(0)).alias("hits0"), F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("n0"),
                     F.sum("part_hits").over(whole).alias("all_hits"), F.sum("part_n").over(whole).alias("all_n")).withColumnRenamed("lang", "of").withColumnRenamed("at", "part")
    so_far = Window.partitionBy("lang", "at").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("lang", "at", "p", F.sum("hits").over(so_far).alias("hits"), F.sum("n").over(so_far).alias("n")) \
        .join(F.broadcast(sums), F.col("lang").eqNullSafe(F.col("of")) & (F.col("at") == F.col("part")))
    f1 = 2 * (F.col("hits") + F.col("hits0")) / (F.col("n") + F.col("n0") + F.col("all_hits"))
    best = run.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "p"))["p"].alias("best"), F.first("all_hits").alias("hits"), F.first("all_n").alias("n"))
    found = {r.lang: r for r in best.collect()}                     # a row for each language
    if not found:
        return {}, fallback
    top = F.broadcast(best.select(F.col("lang").alias("of"), "best"))
    lower = {r.lang: r.p for r in rows.join(top, F.col("lang").eqNullSafe(F.col("of")) & (F.col("p") < F.col("best"))).groupBy("lang").agg(F.max("p").alias("p")).collect()}

    def limit(x, other: float) -> float:
        r = found[x]
        if r.hits < FEW or r.n - r.hits < FEW:
            return other
        return (r.best + lower[x]) / 2 if x in lower else r.best

    common = limit(None, fallback)
    return {x: limit(x, common) for x in found if x is not None}, common


def fit(docs: DataFrame, labels: DataFrame, **kw) -> tuple[Network, dict[str, float], float]:
    """The network, the thresholds of the languages and the common one, all from every labelled text outside the held-out fold."""
    ship_package(docs.sparkSession)
    got = written(labelled_texts(docs, labels, **kw), "toxicity-labelled")
    size, n, n1 = got.where(~F.col("kept_out")).agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.sum("y")).first()
    n1, shards = float(n1 or 0), max(1, -(-(size or 0) // SHARD_BYTES))
    t = got.where(~F.col("kept_out")).select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    net = train_shards(t, shards, n, n1)
    known = labels.where(~held_out()).groupBy("toxic").count().where("toxic IN (0, 1)").collect()
    counts = {r.toxic: r["count"] for r in known}
    if 0 < n1 < n:                                                  # labels of texts that are not there count for the share of the classes
        net.bias += float(np.log(counts[1] / counts[0]) - np.log(n1 / n / (1 - n1 / n)))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.score(b.column(2)))], ["lang", "y", "p"])

    scored = cut(got.where("kept_out").select("lang", "y", "text").mapInArrow(run, "lang string, y int, p double"))
    return net, *best_thresholds(scored, THRESHOLD)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, score, predicted, lang_threshold, flagged`` of every document."""
    net, by_lang, common = fit(docs, labels, text=text, id_col=id_col, lang=lang)
    model = docs.sparkSession.sparkContext.broadcast((net, by_lang, common))
    lang_of = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), lang_of.alias("lang"),
                      F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, by_lang, common = model.value
        for b in batches:
            p = net.score(b.column(3))
            limit = np.array([by_lang.get(x, common) for x in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(limit), pa.array(p >= limit)],
                ["doc_id", "held_out", "score", "predicted", "lang_threshold", "flagged"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, lang_threshold double, flagged boolean")
