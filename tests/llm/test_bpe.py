"""Encoding against the tokenizers library, exact round trips, and the merge against one-pair-at-a-time BPE."""

import hashlib
import json
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vulnsift.llm import bpe
from vulnsift.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(tokenizer_path()), cache_pieces=500)


def hostile():
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "漢字", "😀", "‍", "1", "٣", "...", "!!", "<|endoftext|>",
            "<|endoftext", "\x00", " ", "　", "\x85", "\x1c", "aaaa", "AAAA", "-", "_", "�", "é"]
    return ["", " ", "a" * 3000, " " * 3000, "ab" * 2000, "<|endoftext|>" * 3] + \
        ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000)]


def test_ids_equal_the_library(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 2000)
    monkeypatch.setattr(bpe, "SLICE_TOKENS", 50)
    texts = hostile()
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert list(ids) == want, repr(t)
        assert codec.decode(ids) == t == library.decode(want, skip_special_tokens=False)


def test_long_pieces_equal_the_library(codec, library, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (511, 512, 513, 5000, 40000)] + [
        "a" * 9999, "ab" * 5000 + "a", "漢字" * 3000, "".join(rng.choices("日本語漢字書東西南北", k=6000)), "=-" * 3000 + "x y " + "the" * 2000]
    for limit in (512, 3):
        monkeypatch.setattr(bpe, "LONG_PIECE", limit)
        codec._reset()
        for t, ids in zip(texts, codec.encode(texts), strict=True):
            assert list(ids) == library.encode(t, add_special_tokens=False).ids
    words = hostile()
    for t, ids in zip(words, codec.encode(words), strict=True):
        assert list(ids) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_long_piece_takes_time_by_its_length(codec):
    """A round touches what it changes: reading 200,000 letters once a round would take minutes."""
    rng, took = random.Random(4), []
    for n in (50_000, 200_000):
        piece = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)).encode()
        start = time.process_time()
        codec.merge([piece])
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_merge_equals_one_pair_at_a_time(codec):
    j = json.loads(bpe.read_spec(tokenizer_path()))
    rank = {tuple(m): i for i, m in enumerate(j["model"]["merges"])}
    alphabet = {b: c for c, b in bpe._byte_alphabet().items()}
    rng = random.Random(2)
    pieces = ["".join(rng.choices("aethinosé ", k=rng.randint(1, 25))).encode() for _ in range(400)] + [b"aaaaaaa", b"\xff\xfe"]
    ids, lens = codec.merge(pieces)
    at = 0
    for p, n in zip(pieces, lens):
        s = [alphabet[b] for b in p]
        while True:
            best = min((rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(s, s[1:] + [""])))
            if best[0] == 1 << 30:
                break
            s[best[1]:best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        assert [j["model"]["vocab"][x] for x in s] == list(ids[at:at + n])
        at += n


def test_table_operators(spark, library):
    rows = [(1, "Hello  world 😀\n", 1), (1, "Hello  world 😀\n", 2), (2, None, 3), (None, "", 4), (3, "x " * 30000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(df, tokenizer_path()).collect()
    assert len(got) == 5
    for (i, t, _), r in zip(sorted(rows, key=lambda r: (r[0] or 0, r[1] or "")),
                            sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens))):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    enc = bpe.encode(df, tokenizer_path())
    back = bpe.decode(enc, tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    empty = df.where(F.lit(False))
    assert bpe.round_trip(empty, tokenizer_path()).count() == 0 and bpe.encode(empty, tokenizer_path()).count() == 0


def test_unknown_ids_are_refused(codec):
    assert codec.decode(np.zeros(0, dtype=np.int64)) == ""
    for bad in (-1, 50257):
        with pytest.raises(ValueError):
            codec.decode(np.array([bad]))


def test_query_on_the_given_table(spark, library):
    from vulnsift.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
