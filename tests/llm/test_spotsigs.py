"""Signatures against a walk over the words, neighbours against a plain sort, pairs against all pairs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vulnsift.llm import spotsigs as S


def walk(text):
    """The chains of a text, word by word."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    common, out = set(S.COMMON), set()
    for i, a in enumerate(w):
        chain, gap, j = [], 0, i + 1
        while a in common and j < len(w) and len(chain) < S.CHAIN:
            if w[j] in common:
                gap += 1
                if gap > S.GAP:
                    break
            else:
                chain.append(w[j])
                gap = 0
            j += 1
        if len(chain) == S.CHAIN:
            out.add((a, *chain))
    if out:
        return out
    if len(w) >= S.CHAIN + 1:
        return {("p", *w[i:i + S.CHAIN + 1]) for i in range(len(w) - S.CHAIN)}
    return {("w", *w)} if w else {("t", text or "")}


def like(a, b):
    return len(a & b) / len(a | b)


def edited(text, nxt):
    q = len(text) // 4
    return text[:len(text) - q] + nxt[:q]


def texts():
    rng = random.Random(8)
    words = ["the", "of", "la", "und", "is", "alpha", "beta", "gamma", "delta", "x1", "été", "Straße", ".", "!", "\n", "😀"]
    out = ["", None, "the", "the the the", "the a of " * 500, "one two", "one two three four five", "the house, the tree", "!!!", "???",
           "THE House of the rising sun", "the " * 9 + "x y", "the " * 10 + "x y"]
    return out + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)]


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = edited(t, nxt)
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(walk(t), walk(e)), 9),
                     round(like(walk(t), walk(nxt)), 9), len(walk(t))))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9),
             r.fingerprint.count(".") + 1) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40, 400])
def test_against_next(spark, ranges):
    rng = random.Random(ranges)
    rows = [(k, t) for k, t in zip(rng.sample(range(10 ** 12), 400), texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, S.against_next(df, ranges=ranges).collect())


def test_repeated_and_null_ids(spark):
    rows = [(5, "b"), (5, "b"), (5, "a the b c d"), (None, "n1"), (None, None), (9, "z"), (-3, "y")] + [(7, f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.lit(1)).withColumn("sigs", F.lit("x"))
    for ranges in (1, 3, 20):
        check(rows, S.against_next(df, ranges=ranges).collect())
    one = df.where("doc_id = 9")
    check([(9, "z")], S.against_next(one).collect())
    assert S.against_next(df.where(F.lit(False))).count() == 0


def test_given_table_and_equal_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = S.against_next(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    by_text = {}
    prints = {r.doc_id: r.fingerprint for r in got}
    for r in docs.collect():
        by_text.setdefault(r.text, set()).add(prints[r.doc_id])
    assert all(len(p) == 1 for p in by_text.values())


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices(["the", "of", "is"] + [f"w{i}" for i in range(80)], k=rng.randint(30, 120))) for _ in range(20)]
    rows = []
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(80)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, ""), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tau in (0.5, 0.8):
        pairs, members = S.similar_pairs(df, tau)
        texts_of = {}
        ids = dict(rows)
        for r in members.collect():
            texts_of.setdefault(r.f, ids[r.doc_id])
        got = {frozenset((r.a, r.b)): r.likeness for r in pairs.collect()}
        sets = {f: walk(t) for f, t in texts_of.items()}
        fs = sorted(sets)
        want = {frozenset((a, b)): like(sets[a], sets[b]) for i, a in enumerate(fs) for b in fs[:i] if like(sets[a], sets[b]) >= tau}
        assert got == pytest.approx(want) and want
