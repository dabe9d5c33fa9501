"""Raking and chances against plain loops, expected and drawn tokens, edge cases."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vulnsift.llm import mixing as M
from vulnsift.llm import pii


def topic(t):
    t = t or ""
    return "notice" if re.search("(?i)licen[sc]e|copyright", t) else "table" if " | " in t else \
        "contact" if re.search(r"[\w.%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|\+[0-9][ ().0-9-]+[0-9]|\[(EMAIL|PHONE)\]", t) else "prose"


def plain(rows, targets, temper, keep):
    """(cell -> chance), tokens per cell; rows are (source, lang, topic, tokens)."""
    cells = defaultdict(float)
    for s, l, t, n in rows:
        cells[s or "", l or "", t or ""] += n
    total = sum(cells.values())
    goal = []
    for i, m in enumerate(M.MARGINALS):
        own = defaultdict(float)
        for c, n in cells.items():
            own[c[i]] += n
        if m in targets:
            raw = {k: targets[m][k] for k, n in own.items() if n > 0 and targets[m].get(k, 0) > 0}
        else:
            raw = {k: n ** temper for k, n in own.items() if n > 0}
        goal.append({k: v / sum(raw.values()) for k, v in raw.items()})
    w = dict(cells)
    for done in range(1, 1000):
        worst = 0
        for i in range(3):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[i]] += x
            f = {k: goal[i].get(k, 0) * total / h if h else 0 for k, h in have.items()}
            worst = max([worst, *(abs(f[c[i]] - 1) for c, x in w.items() if x * f[c[i]] > 0)])
            w = {c: x * f[c[i]] for c, x in w.items()}
        if worst < M.TOLERANCE and done % M.ROUNDS_A_PLAN == 0:
            break
    ratio = {c: w[c] / n if n else 0 for c, n in cells.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1, mid * ratio[c]) * n for c, n in cells.items()) < keep * total else (lo, mid)
    return {c: min(1.0, hi * r) for c, r in ratio.items()}, w, goal, total


@pytest.mark.parametrize("targets,keep", [
    ({}, 0.7), ({"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.7, "table": 0.1, "notice": 0.2}}, 0.3)])
def test_chances_equal_plain_raking(spark, targets, keep):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = [(r.source, r.lang, topic(r.text), len(r.text.split())) for r in docs.collect()]
    want, w, goal, total = plain(rows, targets, M.TEMPER, keep)
    got = M.report(docs, targets, keep).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.chance == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6, abs=1e-9)
    # marginals hold, and the draw is near its expectation
    have = defaultdict(float)
    for c, x in w.items():
        have[c[1]] += x
    assert all(abs(have[k] / total - g) < 2e-3 for k, g in goal[1].items())
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    drawn = sum(tokens[r.doc_id] for r in got if r.kept)
    assert drawn == pytest.approx(sum(tokens[r.doc_id] * r.chance for r in got), rel=0.1)
    kept = M.sample(docs.withColumn("topic", F.lit("x")).withColumn("chance", F.lit(1)), targets, keep)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert kept.columns == docs.columns + ["topic", "chance"]


def test_tokens_and_topics(spark):
    texts = ["", None, " a  b\n", "x", "License", "a | b", "m@n", "+1", "plain", "m@n.de", "x +49 30 123456.",
             "[EMAIL]", "[PHONE]", "[LOCAL_PHONE]", "copyright@law.org"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(M.tokens_of(F.col("text")), M.topic_of(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [
        (len((t or "").split()), "contact" if t == "copyright@law.org" else topic(t)) for t in texts]


def test_masking_changes_no_topic(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    more = spark.createDataFrame([(t,) for t in ("mail license@law.org", "call +1 212 555 0100", "phone 212-555-0100", "a | b 10.0.0.1")],
                                 "text string")
    docs = docs.select("text").unionByName(more).withColumn("was", M.topic_of(F.col("text")))
    masked = pii.mask(docs)
    assert masked.where(F.col("text").rlike(r"\[(EMAIL|PHONE)\]")).count() > 2
    assert masked.where(M.topic_of(F.col("text")) != F.col("was")).count() == 0


def test_edge_cases(spark):
    rows = [(1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (2, None, "en", "s", 0), (None, "x y", "en", "s", 3),
            (3, "z " * 20000, "de", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = M.report(df).collect()
    assert len(got) == 5 and all(0 <= r.chance <= 1 for r in got)
    assert len({r.kept for r in got if r.doc_id == 1}) == 1
    assert all(r.kept for r in M.report(df, keep=1.0).collect())
    assert not any(r.kept for r in M.report(df, keep=0.0).collect())
    assert all(r.chance == 0 for r in M.report(df, {"lang": {"xx": 1.0}}).collect())
    empty = df.where(F.lit(False))
    assert M.report(empty).count() == 0 and M.sample(empty).count() == 0
    assert M.sample(df).columns == df.columns


def test_many_cells_give_the_same_chances(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), "en" if i % 3 else "de", "hot" if i % 20 else "rare") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r.doc_id: r.chance for r in M.report(docs).collect()}
    monkeypatch.setattr(M, "FEW_CELLS", 0)
    assert {r.doc_id: r.chance for r in M.report(docs).collect()} == pytest.approx(want, rel=1e-9)


def shares(rows, name):
    return {(r.marginal, r.category): r[name] for r in rows}


def plain_bounded(cells, temper, keep):
    """cell -> chance of the default draw: water filling of each marginal, then raking under the bounds, by bisection."""
    total = sum(cells.values())
    draw, goal = keep * total, []
    for i in range(3):
        own = defaultdict(float)
        for c, n in cells.items():
            own[c[i]] += n
        lo, hi = 0.0, 1e12
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(n, mid * n ** temper) for n in own.values()) < draw else (lo, mid)
        goal.append({k: min(n, hi * n ** temper) for k, n in own.items()})
    w = {c: n * keep for c, n in cells.items()}
    for _ in range(300):
        for i in range(3):
            for k, g in goal[i].items():
                mine = [c for c in cells if c[i] == k]
                lo, hi = 0.0, 1e6
                for _ in range(80):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sum(min(cells[c], mid * w[c]) for c in mine) < g * (1 - 1e-12) else (lo, mid)
                for c in mine:
                    w[c] = min(w[c] * hi, cells[c] * 1e3)
    return {c: min(1.0, w[c] / n) for c, n in cells.items()}


def test_the_default_draw_equals_a_plain_one(spark):
    """Topics of 2 to 4 % that must more than double: they give all they have, and the rest goes to the others."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text", "lang", F.expr("doc_id % 3").alias("source"))
    got = M.report(docs).collect()
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    cells = defaultdict(float)
    for r in got:
        cells[r.source, r.lang, r.topic] += tokens[r.doc_id]
    want = plain_bounded(cells, M.TEMPER, M.KEEP)
    for r in got:
        assert r.chance == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-2)
    assert sum(r.chance * tokens[r.doc_id] for r in got) == pytest.approx(M.KEEP * sum(tokens.values()), rel=2e-3)
    rows = M.marginals(docs).collect()
    target, reachable, expected, drawn = (shares(rows, c) for c in ("target", "reachable", "expected", "drawn"))
    assert sum(target.values()) == pytest.approx(3) and sum(drawn.values()) == pytest.approx(3)
    assert expected == pytest.approx(reachable, rel=5e-3)
    assert drawn == pytest.approx(reachable, abs=0.06)      # a few texts have a large share of these tokens
    assert any(reachable[k] < 0.9 * target[k] for k in target)


def test_one_stray_document_leaves_the_draw_alone(spark):
    rows = [(i, "w " * (5 + i % 11), "en" if i % 4 else "de", f"s{i % 5}") for i in range(4000)]
    schema = "doc_id long, text string, lang string, source string"
    before = M.report(spark.createDataFrame(rows, schema)).where("kept").count()
    after = M.report(spark.createDataFrame(rows + [(9999, "a b c", "xx", "s1")], schema)).collect()
    assert [r.chance for r in after if r.doc_id == 9999] == [1.0]
    assert sum(r.kept for r in after) == pytest.approx(before, rel=0.01) and before > 0.6 * 4000


def test_targets_that_cells_cannot_meet_end_in_a_smaller_or_plainer_draw(spark):
    """Every source has its own language, so that no weights fit both tempered marginals and a given one."""
    rows = [(i, "w " * 8, "en" if i % 10 else "de", "big" if i % 10 else "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = shares(M.marginals(df, {"lang": {"en": 0.3, "de": 0.7}}).collect(), "expected")
    assert got["lang", "de"] == pytest.approx(0.7, rel=5e-3) and got["source", "small"] == pytest.approx(0.7, rel=5e-3)


def test_a_hot_source_and_a_cell_of_one_document_keep_the_targets(spark):
    rows = [(i, "w " * 10, "en", "hot" if i % 20 else "rare", "a" if i % 7 else "b") for i in range(4000)]
    rows.append((5000, "w", "de", "rare", "b"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    given = {"source": {"hot": 0.5, "rare": 0.5}, "topic": {"a": 0.5, "b": 0.5}, "lang": {"en": 1.0, "de": 1e-4}}
    got = M.marginals(df, given, topic=F.col("topic")).collect()
    assert shares(got, "expected") == pytest.approx(shares(got, "target"), rel=5e-3)
    assert M.sample(df, given, topic=F.col("topic")).count() > 300
