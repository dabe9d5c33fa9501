import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vulnsift.llm import prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string"


def turns_of(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda r, t: hashlib.sha256(f"{len(r)}:{r}:{t}".encode()).hexdigest()
    return {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2], sha(x[2], x[3])))] for c, v in by.items()}


def fork(by):
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = by.get(base, [])[:h] + own[h:]
    return out


def brute(by):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(spark, rows, forks=True):
    marks = P.turn_marks(spark.createDataFrame(rows, SCHEMA).repartition(4)).cache()
    df = P.prefix_trie(P.forked(marks) if forks else marks, P.members_of(marks))
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, n=60):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "éé"])) for c in rnd.sample(range(-150, 320), n)
            for t in range(rnd.randrange(1, 8))]


def check(spark, rows, forks=True):
    by = turns_of(rows)
    want = brute(fork(by) if forks else by)
    assert got(spark, rows, forks) == want
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    want = check(spark, random_rows(seed))
    assert any(r[3] > 3 and r[4] > 1 for r in want)


def test_nulls_ties_repeats_absent_bases_and_turnless(spark):
    rows = [(5, None, None, None), (5, None, "user", "x"), (5, 1, "user", None), (5, 1, "user", None), (5, 1, None, "z"),
            (None, 1, "user", "nobody"), (701, 1, "user", "only"), (702, 1, "user", "only"), (900, 0, "user", "root"), (901, 3, "user", "x"),
            (-7, 1, "", ""), (-100, 1, "user", "n"), (-103, 1, "user", "m"), (-103, 2, "user", "m")]
    want = check(spark, rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)       # some have no turns left
    check(spark, rows, forks=False)


def test_copies_and_long_conversations(spark):
    long = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(300)] + [(2, 300, "user", "end"), (1, 300, "user", "other")]
    copies = [(c, t, "user", "same") for c in range(1000, 1120) for t in range(3)]
    want = check(spark, long + copies, forks=False)
    assert max(r[1] for r in want) == 301


def test_snapshots_of_one_growing_conversation(spark, monkeypatch):
    """Each conversation is the one before plus a turn: one path, so nothing has to be peeled."""
    rounds = []
    cut = P.cut
    monkeypatch.setattr(P, "cut", lambda df: rounds.append(1) or cut(df))
    check(spark, [(c, t, "user", str(t)) for c in range(40) for t in range(c + 1)], forks=False)
    assert len(rounds) <= 2


def test_id_blocks_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(P, "ID_BLOCK", 3)
    check(spark, [(c, 0, "user", "same") for c in range(-8, 25)], forks=False)


def test_empty_table_and_other_columns(spark):
    assert got(spark, []) == []
    rows = random_rows(4, 12)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", depth int, idx int, mark string")
    marks = P.turn_marks(df)
    assert sorted(tuple(r) for r in P.prefix_trie(marks, P.members_of(marks)).collect()) == brute(turns_of(rows))
