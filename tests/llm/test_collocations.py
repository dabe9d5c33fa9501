import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vulnsift.llm import collocations as C
from vulnsift.llm import rolling
from vulnsift.llm.wordruns import slabs

SCHEMA = "doc_id long, text string, lang string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words=3, min_count=10, top=2000, absorb=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            inside = any(len(q) > len(p) and 100 * b >= absorb * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in cand.items())
            if not inside:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def corpus(seed=3, docs=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Élan", "ÉLAN", "Word", "the", "THE", "a\x00b", "naïve"]
    glue = [" ", "  ", "\t", ". ", ", ", "\n", "? ", ":", " \x0b "]
    rows = []
    for i in range(docs):
        text = "".join(rnd.choice(words) + rnd.choice(glue[:2] * 4 + glue) for _ in range(rnd.randrange(0, 150)))
        rows.append((i, text, rnd.choice(["en", "de", None])))
    return rows


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def test_equals_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert len(want) > 20
    assert got(spark, rows) == want


def test_nulls_repeats_ties_and_extra_columns(spark):
    rows = corpus(5, 30)
    rows += [rows[3]] * 20 + [(None, "null id here now", None)] * 12 + [(None, None, "en"), (99, "", "en"), (99, " .\t", None)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", n long, a long, phrase string")
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == brute(rows)


def test_top_and_longer_phrases(spark):
    rows = corpus(7, 40)
    assert got(spark, rows, top=5) == brute(rows, top=5)
    assert got(spark, rows, max_words=5, min_count=4) == brute(rows, max_words=5, min_count=4)
    assert got(spark, rows, max_words=2) == brute(rows, max_words=2)


def test_full_bitmap_loses_nothing(spark):
    """A bitmap of so few bits that nearly every one is set prunes nothing and changes nothing."""
    rows = corpus(9, 30)
    assert got(spark, rows, bits=1 << 6) == brute(rows)


@pytest.mark.parametrize("mask", [0, 7, 255])
def test_collisions_are_recounted_by_text(spark, mask):
    rows = corpus(11, 25)
    assert got(spark, rows, mask=mask) == brute(rows)


def test_places_in_a_text_over_one_mebibyte(spark):
    rnd = random.Random(1)
    words = [f"q{i}" for i in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(330_000))
    assert len(long) > C._PLACES
    rows = [(1, long + " only late pair" * 12 + ".", "en"), (2, "only late", "en")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert C.collocations(spark.createDataFrame([], SCHEMA)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    q = spark.sql(f"SELECT (CAST(1000000 AS DECIMAL(7, 0)) * CAST({big}L AS DECIMAL(19, 0)) * CAST({big}L AS DECIMAL(19, 0))) div "
                  f"(CAST({big + 1}L AS DECIMAL(19, 0)) * CAST({big + 7}L AS DECIMAL(19, 0))) AS s").first().s
    assert q == 10**6 * big * big // ((big + 1) * (big + 7))


@pytest.mark.parametrize("limit", [1, 7, 40, 300])
def test_windows_of_a_long_text_show_each_run_once(limit):
    rnd = random.Random(limit)
    text = "".join(rnd.choice(["ab", "c", "defghij", "Ä", "x" * 50]) + rnd.choice([" ", "  ", ". ", ".", "\n"]) for _ in range(200))
    for overlap in (0, 1, 2):
        runs = Counter()
        for w in slabs(pa.array([None, text, "", "one two"]).fill_null(""), C.KINDS, overlap, limit=limit):
            words = [w.vocab[a:b].tobytes() for a, b in zip(w.cuts[:-1], w.cuts[1:])]
            for e in range(overlap, len(w.ids)):
                if w.fresh[e] and w.piece[e] == w.piece[e - overlap]:
                    s = e - overlap
                    runs[tuple(words[w.ids[i]] for i in range(s, e + 1)), int(w.row[s]), int(w.start[s]), int(w.end[e])] += 1
        want = Counter()
        for row, t in ((1, text), (3, "one two")):
            raw = t.encode()
            for m in re.finditer(rb"[^.,;:!?\n-\r]+", raw):
                ws = list(re.finditer(rb"[^ \t]+", m.group()))
                for i in range(len(ws) - overlap):
                    part = ws[i:i + overlap + 1]
                    want[tuple(x.group().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in part), row,
                         m.start() + part[0].start(), m.start() + part[-1].end()] += 1
        assert runs == want


def test_fingerprints_of_runs_are_those_of_their_bytes():
    words = [b"a", b"\x00", b"\x00\x00", "zürich".encode(), b"x" * 70_000, b"end"]
    cuts = np.r_[0, np.cumsum([len(w) for w in words])]
    h = rolling.word_hashes(np.frombuffer(b"".join(words), np.uint8), cuts)
    fp, chk = rolling.packed(h)
    assert [(int(a), int(b)) for a, b in zip(fp, chk)] == [rolling.fingerprint([w]) for w in words]
    two = rolling.append([x[:-1] for x in h], [x[1:] for x in h], np.diff(cuts)[1:])
    assert [tuple(map(int, x)) for x in zip(*rolling.packed(two))] == [rolling.fingerprint(words[i:i + 2]) for i in range(len(words) - 1)]
