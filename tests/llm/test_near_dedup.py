"""Classes against brute-force Jaccard components, signatures against weighted Jaccard, edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vulnsift.llm import dart, near_dedup
from vulnsift.llm.components import components


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_classes(rows):
    """(id, text) rows -> {text: class}: components of similarity 0.8 or equality, smallest id."""
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    texts = list(ids)
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    low = {}
    for k, t in enumerate(texts):
        for i in ids[t]:
            if i is not None:
                low[find(k)] = min(low.get(find(k), i), i)
    return {t: low.get(find(k)) for k, t in enumerate(texts)}


def family(rng, words, size, rate, first):
    """Copies of one text, each with its own share of changed words."""
    base = [rng.choice(words) for _ in range(rng.randint(60, 150))]
    out = []
    for k in range(size):
        p = rng.random() * rate
        out.append((first + k, " ".join(rng.choice(words) if rng.random() < p else w for w in base)))
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for f in range(12):
        rows += family(rng, words, rng.choice([2, 5, 40]), 0.06, len(rows))
    for _ in range(150):                        # different texts around one long common passage
        own = " ".join(rng.choice(words) for _ in range(rng.randint(10, 60)))
        rows.append((len(rows), f"{shared} {own}"))
    rows += [(len(rows) + k, rows[k % 50][1]) for k in range(100)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, "another text of the same id, with enough words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_classes(rows)
    got = near_dedup.near_duplicates(df.withColumn("class_id", F.lit("x"))).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.class_id)
    expect = {}
    for i, t in rows:
        expect.setdefault(i, []).append(want[t])
    assert {k: sorted(v, key=str) for k, v in by_id.items()} == {k: sorted(v, key=str) for k, v in expect.items()}
    assert len(set(want.values())) < len(want)


def test_the_rest_step_finds_links_that_pivots_miss(spark, monkeypatch):
    """A chain whose middle members are never pivots of the common bucket: one band of one row makes a
    bucket of everything that shares its earliest shingle."""
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    monkeypatch.setattr(near_dedup, "BANDS", 6)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for _ in range(6):
        text = [rng.choice(words) for _ in range(100)]
        for _ in range(30):
            text = list(text)
            text[rng.randrange(100)] = rng.choice(words)
            text[rng.randrange(100)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == {i: want[t] for i, t in rows}


def test_a_tie_at_the_threshold_between_two_members_that_are_no_pivot(spark, monkeypatch):
    """y is x cut to 80 of its 100 shingles; the pivot is a third text, of three copies, that is near neither."""
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    monkeypatch.setattr(near_dedup, "BANDS", 1)
    rows = []
    for g in range(12):
        x = [f"g{g}w{i}" for i in range(104)]
        z = x[:74] + [f"g{g}z{i}" for i in range(40)]
        rows += [(10 * g + i, " ".join(t)) for i, t in enumerate([x, x[:84], z, z, z])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.doc_id: list(r.bands) for r in near_dedup.signed(df).collect()}
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    met = [g for g in range(12) if keys[10 * g] == keys[10 * g + 1] == keys[10 * g + 2]]
    assert met
    for g in met:
        assert got[10 * g] == got[10 * g + 1] == 10 * g and got[10 * g + 2] == 10 * g + 2


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_given_table(spark, weighting):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, weighting).collect()} == {i: want[t] for i, t in rows}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(4):
        a, b = rng.random(200) * 3 + 0.05, rng.random(200) * 3 + 0.05
        b[60:] = a[60:]
        e = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        s = dart.signatures(np.repeat([0, 1], 200), np.r_[e, e], np.r_[a, b], 2, 4096)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 50, 2000, 0, 7]
    owner = np.repeat(np.arange(6), sizes)
    e = rng.integers(0, 2 ** 63, sum(sizes)).astype(np.uint64)
    w = rng.integers(1, 4, sum(sizes)).astype(float)
    whole = dart.signatures(owner, e, w, 6, 144)
    for i in range(6):
        m = owner == i
        assert (dart.signatures(np.zeros(m.sum(), dtype=int), e[m], w[m], 1, 144)[0] == whole[i]).all()
    assert (whole[4] == dart.EMPTY).all() and (whole[[0, 1, 2, 3, 5]] != dart.EMPTY).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + \
        [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        comp[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in comp if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_and_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(5, "", "a", 1), (4, None, "b", 2), (6, "!!!", "c", 3), (7, "???", "d", 4), (8, "one two", "e", 5),
            (9, "One, two.", "f", 6), (1, long, "g", 7), (2, long + " end", "h", 8), (1, long, "i", 9),
            (None, "text of a row without id", "j", 10), (None, "text of a row without id", "k", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, n int")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 8)]
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    none = df.where(F.lit(False))
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.deduplicate(none).count() == 0


def test_rounds_of_few_links_take_no_shuffle_and_many_agree(spark, monkeypatch):
    from vulnsift.llm import components as C
    rng = random.Random(4)
    frame = spark.createDataFrame([(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, n) for n in range(201, 260)], "a long, b long")
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sc.setJobGroup("few-links", "")
        got = {r.node: r.comp for r in components(frame).collect()}
        status = sc.statusTracker()
        tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("few-links") for s in status.getJobInfo(j).stageIds
                 if status.getStageInfo(s)]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(n >= 40 for n in tasks) <= 4                         # the links are dealt once, before they are counted
    monkeypatch.setattr(C, "FEW_LINKS", 0)
    assert got == {r.node: r.comp for r in components(frame).collect()}
