"""Base counts and the likelihood ratio against plain Python, verdicts against the labels, edge cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vulnsift.llm import quality_rules as Q


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat),
            len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_counts(spark):
    rng = random.Random(9)
    bits = ["a", "b", "a b a", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r", " ", "#", "$%", "😀", "é", "x\ny", "a\n"]
    texts = [None, "", " \n ", "a a a", "a a a a", "\n", "x" * 5000, "a b " * 20000, "😀 " * 60] + \
        ["".join(rng.choices(bits, k=rng.randint(0, 200))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in Q.report(df, [0.0] * Q.BUCKETS).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert counts(got[i]) == brute_base(t), repr(t)
        assert got[i].kept == (not got[i].base_failed) and got[i].llr == 0


def test_ratio_equals_plain_counting(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", Q.ngram_buckets(F.col("text")).alias("b"), "text").collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for r in rows:
        tokens = re.findall(r"\w+|[^\w\s]+", r.text)
        assert len(r.b) == max(2 * len(tokens) - 1, 0)
        raw.update(r.b)
        target.update(r.b if r.doc_id in good else [])
    nr, nt = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    want = [math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr) for b in range(Q.BUCKETS)]
    model = Q.fit(docs, labels)
    assert model == pytest.approx(want, abs=1e-9)
    got = {r.doc_id: r for r in Q.report(docs, model).collect()}
    for r in rows:
        llr = sum(want[b] for b in r.b) / len(r.b) if r.b else 0
        assert got[r.doc_id].llr == pytest.approx(llr, abs=1e-9)
        assert counts(got[r.doc_id]) == brute_base(r.text)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and llr >= Q.THRESHOLD)
    for r in labels.collect():                  # clean documents stay, junk goes
        if not got[r.doc_id].base_failed:
            assert got[r.doc_id].kept == (r.quality == 1)
    assert Q.report(docs, model).where("kept").count() == sum(r.kept for r in got.values())     # a pushed filter
    kept = Q.keep(docs.withColumn("w", F.lit(1)).withColumn("llr", F.lit("x")), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert kept.columns == docs.columns + ["w", "llr"]


def test_edge_cases(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (None, None, 2), (2, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(df, no_labels) == [0.0] * Q.BUCKETS
    some = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (2, 0)], "doc_id long, quality int")
    model = Q.fit(df, some)
    assert Q.report(df, model).count() == 4 and Q.keep(df, model).count() == 0
    empty = df.where(F.lit(False))
    assert Q.fit(empty, some) == [0.0] * Q.BUCKETS
    assert Q.report(empty, model).count() == 0


def test_repeat_count_for_any_hashes(spark):
    """Equal windows, windows that share 44 bits only, and windows in between, against a plain count."""
    import random
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        pool = [rnd.getrandbits(64) - 2**63 for _ in range(rnd.randrange(1, 40))]
        pool += [((p + 2**63) ^ (rnd.randrange(1, 2**20) << 44)) - 2**63 for p in pool[:3]]
        rows.append((i, [rnd.choice(pool) for _ in range(rnd.randrange(0, 60))]))
    df = spark.createDataFrame(rows, "i int, h array<bigint>")
    for r in df.select("i", "h", Q._repeats(F.col("h")).alias("n")).collect():
        covered = {p + j for p, h in enumerate(r.h) if r.h.count(h) > 1 for j in range(3)}
        assert r.n == len(covered)
