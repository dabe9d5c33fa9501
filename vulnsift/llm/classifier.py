"""Quality classifier: histogram gradient-boosted trees over document statistics.

1. ``statistics``: one narrow pass turns every whole text into ``FEATURES`` numbers (counts and
   ratios of characters, words and lines; nothing of id, language or source).
2. The trees are fitted on about ``SAMPLE_ROWS`` labelled rows (all, if fewer), those with the smallest hash of their id; the
   bound is what makes it safe to fit on the driver (``SAMPLE_ROWS`` x 20 numbers). Rows whose
   ``crc32(doc_id as text) mod 5`` is 0 are held out and never fitted on.
3. The trees are flattened into arrays (feature, threshold, children, value of every node), broadcast
   (their size is fixed by the parameters) and walked for whole Arrow batches at once: one
   numpy step per tree level for all rows and trees.

The statistics are checkpointed (a few numbers per document), so texts are read once.

Defined cases: null text is the empty text, whose statistics are all 0 and which gets a score like any
other; without any label every score is 0.5, with labels of one class it is the smoothed prior; null labels
are skipped, contradictory ones both count; a null id counts as the empty id (held out); repeated rows get equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import cut, hash_share, id_text

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
FEATURES = ("chars", "words", "word_length", "longest_word", "upper_words", "upper_chars", "digits", "symbols",
            "punctuation", "exclaims", "pipes", "distinct_words", "distinct_pairs", "same_neighbours", "commonest_word",
            "lines", "line_words", "dup_lines", "sentence_ends", "other_ends")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_PUNCT = np.frombuffer(b".,;:!?\"'()[]{}-_/\\@^~`=+", dtype=np.uint8)


def text_statistics(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(FEATURES) - 1)
    n = len(words)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size = max(int(raw.sum()), 1)
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ends = Counter(w[-1] for w in words)
    letters_end = sum(c for ch, c in ends.items() if ch.isalnum())
    stops = ends["."] + ends["?"] + ends["!"]
    return [
        np.log1p(len(text)), np.log1p(n), sum(lengths) / n, np.log1p(max(lengths)),
        sum(map(str.isupper, words)) / n, raw[65:91].sum() / size, raw[48:58].sum() / size, raw[_SYMBOLS].sum() / size,
        raw[_PUNCT].sum() / size, raw[33] / size, counts["|"] / n, len(counts) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1), sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values()) / n, np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        stops / n, (n - letters_end - stops - ends[","]) / n]


def _statistics_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    k = len(FEATURES)
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            x = np.array([text_statistics(t) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(-1)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x))],
                                             ["doc_id", "stats"])


def statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    src = id_text(docs, text, id_col)
    return src.mapInArrow(_statistics_batches,
                          f"doc_id {src.schema['doc_id'].dataType.simpleString()}, stats array<double>")


# -- trees -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays; a leaf has itself as both children."""
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of ``x``."""
        margin = np.full(len(x), self.base)
        if len(x) and len(self.roots):
            rows = np.arange(len(x))[:, None]
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                below = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            margin = margin + self.value[node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        min_rows: int = 10, l2: float = 1.0) -> Forest:
    """Boosted trees for the log loss; splits are sought over per-feature histograms of gradients."""
    n, k = x.shape if x.ndim == 2 else (0, len(FEATURES))
    positive = float(y.sum()) if n else 0.0
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if n and 0 < positive < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
        flat = binned + np.arange(k) * bins                  # one histogram row for all features
        margin = np.full(n, base)

        def leaf(g, h):
            feature.append(0), threshold.append(0.0), value.append(-rate * g / (h + l2))
            left.append(len(value) - 1), right.append(len(value) - 1)
            return len(value) - 1

        def grow(rows, g, h, level):
            gs, hs = float(g[rows].sum()), float(h[rows].sum())
            if level < depth and len(rows) >= 2 * min_rows:
                at = flat[rows].ravel()
                size = k * bins
                hg = np.bincount(at, np.repeat(g[rows], k), size).reshape(k, bins).cumsum(1)[:, :-1]
                hh = np.bincount(at, np.repeat(h[rows], k), size).reshape(k, bins).cumsum(1)[:, :-1]
                hn = np.bincount(at, minlength=size).reshape(k, bins).cumsum(1)[:, :-1]
                gain = hg ** 2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2) - gs ** 2 / (hs + l2)
                gain[(hn < min_rows) | (len(rows) - hn < min_rows)] = 0
                j, b = divmod(int(gain.argmax()), bins - 1)
                if gain[j, b] > 1e-6:
                    me = leaf(gs, hs)
                    feature[me], threshold[me] = j, float(cuts[j][b])
                    go = binned[rows, j] <= b
                    left[me] = grow(rows[go], g, h, level + 1)
                    right[me] = grow(rows[~go], g, h, level + 1)
                    return me
            me = leaf(gs, hs)
            margin[rows] += value[me]
            return me

        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0))
    return Forest(base, np.array(roots, dtype=np.int32), np.array(feature, dtype=np.int32), np.array(threshold),
                  np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), np.array(value), depth)


# -- the operator --------------------------------------------------------------------------------

def held_out(id_col: str = "doc_id"):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def training_rows(stats: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """About ``limit`` labelled rows outside the held-out fold, by hash of the id; one for each id and label."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1)).distinct()
    rows = cut(stats.where(~held_out()).join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("stats").alias("stats")))
    return rows.where(hash_share("doc_id", limit, rows.count()))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark = docs.sparkSession
    stats = cut(statistics(docs, text, id_col))
    got = training_rows(stats, labels).toPandas().sort_values(["doc_id", "y"])
    x = np.array(got["stats"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    forest = spark.sparkContext.broadcast(fit(x, got["y"].to_numpy(dtype=np.float64)))

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = np.concatenate([forest.value.predict(x[i:i + 4096]) for i in range(0, len(x), 4096)]) \
                if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", held_out().alias("held_out"), "stats").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
