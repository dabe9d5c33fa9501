"""The base spans against the plain contract patterns run by Python's ``re``; added kinds by hand."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vulnsift.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for kind, pat in PLAIN.items():
        for m in re.finditer(pat, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def cases():
    rng = random.Random(7)
    texts = ["", None, "4111 1111 1111 1111", "4111-1111-1111-1111 5", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255",
             "a@b.c_d@e.f", "a@b.c@d.e", ".@a-.b..c", "+1 (017) 555-7713.", "+1 2   ", "é😀 x@y.zz 10.0.0.1 é",
             "1" * 40 + " " + "9" * 16, "5 4111111111111111", "x" * 5000 + "@", "@" * 50, "1." * 3000 + "x",
             "a@" + "b." * 3000 + "c", "+1" + " " * 4000 + "2", "4 " * 4000]
    for _ in range(1500):
        texts.append("".join(rng.choice("0123456789  --..@+()ab_%é😀\n:") for _ in range(rng.randint(1, 60))))
    for _ in range(300):                        # digit chains around the length limits
        texts.append("".join(rng.choice("0123456789") + rng.choice(["", "", "", " ", "-", "  "]) for _ in range(rng.randint(14, 24))))
    return texts


def test_base_spans_equal_plain_patterns(spark):
    texts = cases()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(texts)
    seen = set()
    for i, t in enumerate(texts):
        want = brute(t or "")
        digest = hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert got[i].base_sha256 == digest, (t, want, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == \
            [sum(s[0] == k for s in want) for k in PLAIN]
        seen |= {s[0] for s in want}
    assert seen == set(PLAIN)


def test_many_matches_keep_exact_offsets(spark):
    text = "é 10.0.0.1, " * 1000
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in row["ip"]] == [(2 + 12 * i, 10 + 12 * i) for i in range(1000)]


@pytest.mark.parametrize("text,kind,n", [
    ("pay to GB82 WEST 1234 5698 7654 32 now", "iban", 1),
    ("pay to GB82 WEST 1234 5698 7654 33 now", "iban", 0),
    ("DE89370400440532013000", "iban", 1),
    ("my ssn is 123-45-6789", "national_id", 1),
    ("part 123-45-6789 of the series", "national_id", 0),
    ("call (212) 555-0100 today", "local_phone", 1),
    ("call +1 (212) 555-0100 today", "local_phone", 0),
    ("code 212-555-0100 today", "local_phone", 0),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret", 1),
    ('commit 04dbebab91ab85687d33eeaaf9ac699e1188f962', "secret", 0),
])
def test_checksums_and_context(spark, text, kind, n):
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row[kind]) == n
    for s in row[kind]:
        assert text[s["start"]:s["end"]] == s["match"] and s["score"] >= pii.THRESHOLD


def test_mask_and_edge_cases(spark):
    rows = [(1, "mail a@b.co or 10.0.0.1, card 4111111111111111", 3, "x"), (1, None, None, None), (None, "", 0, "y"),
            (2, "999.1.1.1 stays", 15, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, email string")
    got = [tuple(r) for r in pii.mask(df).collect()]
    assert got[0][1] == "mail [EMAIL] or [IP], card [CARD]" and got[0][2] == len(got[0][1])
    assert got[1][:2] == (1, None) and got[2] == (None, "", 0, "y") and got[3] == rows[3]
    assert pii.report(df.where(F.lit(False))).count() == 0
    assert pii.report(df).count() == 4


@pytest.mark.parametrize("text,kind,n", [
    ("SSN: 111-22-3333, 444-55-6666, 777-88-9999, 111-22-4444", "national_id", 3),      # the last is 44 code points on
    ("phone 212-555-0100, 212-555-0101", "local_phone", 2),
    ("list " + "a1" * 16 + " " + "c2" * 16 + " token", "secret", 1),
    ("a@b.co 212-555-0100 +1 212 555 0100 212-555-0199", "local_phone", 0),               # a mask is no context word
    ("é" * 5000 + "12.34 " + "ssn 111-22-3333 " * 300, "national_id", 300),
])
def test_context_is_the_whole_text_and_masks_are_the_spans(spark, text, kind, n):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find(df).first()
    assert len(row[kind]) == n
    spans = sorted((s["start"], i, s["end"], k.name) for i, k in enumerate(pii.kinds()) for s in row[k.name])
    want, at = "", 0
    for start, _, end, name in spans:
        if start >= at:
            want += text[at:start] + f"[{name.upper()}]"
        at = max(at, end)
    assert pii.mask(df).first()["text"] == want + text[at:]


def test_overlapping_spans_are_masked_as_their_union(spark):
    df = spark.createDataFrame([(1, "x a@10.0.0.1, y +4111 1111 1111 1111 z")], "doc_id long, text string")
    assert pii.mask(df).first()["text"] == "x [EMAIL], y +[CARD] z"
