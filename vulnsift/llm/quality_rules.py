"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over ``BUCKETS`` hashed n-grams (tokens and pairs of neighbouring
tokens; a token is a run of letters, digits and ``_`` or a run of other visible characters): one of
the trusted documents, one of the whole raw corpus, both with additive smoothing. A document's score is
the mean of ``log p_target - log p_raw`` over its n-grams, so length does not matter, and every document is judged
against one fixed threshold.

Only built-in functions run. Counting explodes n-grams and aggregates them map-side to
at most ``BUCKETS`` rows a task (the shuffle does not grow with the texts); the model is then an array
of ``BUCKETS`` numbers inside the plan, and scoring and the base counts are a narrow projection:
no join, no shuffle, so copies and hot sources do not matter.

Counts of the raw corpus cover all documents. The trusted multinomial is fitted on about ``TRUSTED_ROWS``
documents (all, if fewer), those with the smallest hash of their id; that bound keeps the id list small enough to
broadcast, so that texts need not be shuffled to meet their labels.

Defined cases: null text counts as empty: no words, ``base_failed``, score 0; without trusted rows
the ratio is 0 everywhere and only the base rules decide; repeated rows are judged alike and each counted;
null ids are kept (and never trusted); empty tables give no rows; other columns are kept by ``keep`` whatever
their names and ignored by ``report``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import cut, hash_share, id_text, let

BUCKETS = 16_384          # a power of two
SMOOTHING = 1.0
THRESHOLD = -0.4
TRUSTED_ROWS = 100_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SPACE = " \t\n\x0b\x0c\r"
_TOKEN = r"[\p{L}\p{M}\p{N}_]++|[^\p{L}\p{M}\p{N}_\s]++"


# -- base counts ----------------------------------------------------------------------------------

def _windows(w: Column) -> Column:
    """Hash of every 3-word window."""
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


_PLACE_BITS = 20


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur at least twice: equal windows meet by sorting numbers of 44 bits of hash and 20 bits of
    place. Where windows agree in these 44 bits but not in all, or a text has more places, pairs of hash and place are sorted."""
    mask = (1 << _PLACE_BITS) - 1

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftrightunsigned(a.bitwiseXOR(b), _PLACE_BITS) == 0, F.lit(False))

    def place(e: Column) -> Column:
        return e.bitwiseAND(mask).cast("int")

    def spans(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda v, j: F.coalesce(F.least(F.lit(3), v - F.get(p, j - 1)), F.lit(3))), F.lit(0), lambda a, v: a + v)

    def count(twice: Column) -> Column:
        unlike = F.filter(twice, lambda e, k: same(e, F.get(twice, k - 1))
                          & (F.get(hashes, place(e)) != F.get(hashes, place(F.get(twice, k - 1)))))
        return F.when(F.size(unlike) > 0, _covered_by_pairs(hashes)).otherwise(let(F.sort_array(F.transform(twice, place)), spans))

    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, _PLACE_BITS).bitwiseOR(i.cast("bigint"))))
    quick = let(packed, lambda s: let(F.filter(s, lambda e, k: same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1))), count))
    return F.when(F.size(hashes) <= mask, quick).otherwise(_covered_by_pairs(hashes))


def _covered_by_pairs(hashes: Column) -> Column:
    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(places, lambda s: let(
        F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(
            F.get(s, k + 1)["h"] == e["h"], F.lit(False))),
        lambda twice: F.size(F.array_distinct(F.flatten(F.transform(
            twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))))


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def _repeats(hashes: Column) -> Column:
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes)).cast("bigint")


def with_word_counts(df: DataFrame, text: Column) -> DataFrame:
    """Add ``n_words``, ``word_chars`` and ``n_repeat_words``. The windows are a column between, so that the test whether any
    repeats runs compiled. The words are bound inside one expression and never a column: should a filter be pushed
    below the projection, a lambda over a column would split the text anew for every word."""
    facts = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.concat_ws("", w)).alias("c"), _windows(w).alias("h")))
    return df.withColumn("_qr", facts).withColumns({"n_words": F.col("_qr.n").cast("bigint"), "word_chars": F.col("_qr.c").cast("bigint"),
                                                    "n_repeat_words": _repeats(F.col("_qr.h"))}).drop("_qr")


def base_counts(text: str) -> list[Column]:
    """The other base counts of a text column."""
    t = F.col(text)
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return [F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            lines.cast("bigint").alias("n_dup_lines")]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


# -- the likelihood ratio ---------------------------------------------------------------------------

def _token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda x: F.hash(x))


def _pair_buckets(hashes: Column) -> Column:
    """Bucket of every pair of neighbouring tokens; each token is hashed once, a pair from the two hashes."""
    return F.transform(F.slice(hashes, 2, F.size(hashes)), lambda x, i: F.hash(F.get(hashes, i), x).bitwiseAND(BUCKETS - 1))


def ngram_buckets(text: Column) -> Column:
    """Bucket of every token and of every pair of neighbouring tokens."""
    return let(_token_hashes(text), lambda hs: F.concat(
        F.transform(hs, lambda x: x.bitwiseAND(BUCKETS - 1)),
        F.when(F.size(hs) > 1, _pair_buckets(hs)).otherwise(F.array().cast("array<int>"))))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """About ``limit`` distinct ids of documents labelled good (all, if fewer), by hash of the id."""
    ids = cut(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    return ids.where(hash_share("doc_id", limit, ids.count()))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id",
        smoothing: float = SMOOTHING) -> list[float]:
    """The log ratio of every bucket."""
    ids = trusted_ids(labels).withColumn("trusted", F.lit(1))
    base = id_text(docs, text, id_col).join(F.broadcast(ids), "doc_id", "left")
    grams = base.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(ngram_buckets(F.col("text"))).alias("b"))
    counts = cut(grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target")))
    rows = counts.collect()                 # at most BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r.b], target[r.b] = r.raw, r.target
    if not sum(target):
        return [0.0] * BUCKETS
    norm = math.log(sum(raw) + smoothing * BUCKETS) - math.log(sum(target) + smoothing * BUCKETS)
    return [math.log(t + smoothing) - math.log(n + smoothing) + norm for n, t in zip(raw, target)]


def ratio_score(text: Column, model: list[float]) -> Column:
    """Mean log ratio over a text's n-grams, 0 for a text without any."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")     # folded to one constant

    def mean(hashes: Column) -> Column:
        singles = F.aggregate(hashes, F.lit(0.0), lambda a, x: a + F.get(table, x.bitwiseAND(BUCKETS - 1)))
        both = F.aggregate(_pair_buckets(hashes), singles, lambda a, x: a + F.get(table, x))
        n = F.size(hashes)
        return F.when(n > 1, both / (2 * n - 1)).when(n == 1, singles).otherwise(F.lit(0.0))

    return let(_token_hashes(text), mean)


def report(docs: DataFrame, model: list[float], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Base counts, score and verdict of every document."""
    base = with_word_counts(id_text(docs, text, id_col), F.col("text"))
    counted = base.select("doc_id", "n_words", "word_chars", *base_counts("text"), "n_repeat_words", ratio_score(F.col("text"), model).alias("llr"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return counted.withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD)) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def keep(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    passed = let(words_of(t), lambda w: let(_windows(w), lambda h: ~base_failed(F.size(w), _repeats(h))))
    return docs.where(passed).where(ratio_score(t, model) >= THRESHOLD)
