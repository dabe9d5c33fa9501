"""Phrase collocations: Rabin-Karp fingerprints of all word runs, counted by a shuffle, read back from pointers.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. For
every language (null: ``und``)

1. a scan hashes every run of one and two words with prefix polynomials in numpy, adds up equal runs of a slab and
   emits fingerprint, check, count and one occurrence (text and byte place); the shuffle adds up fingerprints, which
   language and length are mixed into, so that a row is four numbers;
2. for each greater length a further scan emits only runs whose two shorter runs may be frequent. A bitmap of ``BITMAP``
   bits, whatever the input, says so; it has false positives, which the count then drops, and no false negatives;
3. a fingerprint that came with two different checks is a collision: its runs are counted again by their text
   (``recounted``);
4. only frequent fingerprints are read back: their occurrences are joined to the texts, and what is read there must have
   the same fingerprint and check.

``collocations`` then scores each phrase at its weakest cut, with exact decimals, drops those inside a longer phrase that is at least half as
frequent, and keeps the best of each language.

Memory: a slab of texts and bitmaps of fixed size, never a table of phrases in a worker. Of all occurrences of a phrase the one in the
text of the smallest hash is kept, so that few texts are shuffled to meet them; a bitmap drops the others before. A common word
is a few rows per task, since slabs and map-side sums come first.

Defined cases: null text is empty and has no words; a null language is ``und``; null and repeated ids do not matter,
every row counts; very long texts are read in overlapping windows; ties of score go by count, then by phrase in byte order; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm import rolling
from vulnsift.llm.common import written
from vulnsift.llm.wordruns import byte_classes, slabs

MIN_COUNT = 10
MAX_WORDS = 3
ABSORB_PERCENT = 50
TOP = 2000
PARTS = 16
BITMAP = 1 << 27
SLAB = 1 << 20
KINDS = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
_WORDS = re.compile(rb"[^ \t.,;:!?\n-\r]+")
_FULL = (1 << 62) - 1
_CHECK = (1 << 31) - 1
# an occurrence is one number: 40 bits of the text's hash, 20 bits of the byte where the run starts, 4 bits of its length. In a text over
# 1 MiB several places agree in these 20 bits; the fingerprint tells which is meant.
_PLACES = 1 << 20
_COUNTED = "key bigint, chk bigint, cnt bigint, spot bigint"
_NAMES = ["key", "chk", "cnt", "spot"]
_LENGTH, _TEXT_OF = "(spot & 15)", "shiftrightunsigned(spot, 24)"


# -- runs of a slab ---------------------------------------------------------------------------------

class _Runs:
    """Distinct runs of one length in a slab: where each word's run belongs, and one row for each distinct run."""

    def __init__(self, code, first, count, values, size):
        self.code, self.first, self.count, self.values, self.size = code, first, count, values, size


def _distinct(key: np.ndarray, at: np.ndarray, fresh: np.ndarray, n_words: int):
    codes, keys = pd.factorize(key)
    first = np.empty(len(keys), np.int64)
    first[codes[::-1]] = at[::-1]
    spread = np.full(n_words, -1, np.int64)
    spread[at] = codes
    return spread, first, np.bincount(codes, weights=fresh[at], minlength=len(keys)).astype(np.int64)


def _single(w, lang: np.ndarray, hashes, sizes) -> _Runs:
    at = np.arange(len(w.ids))
    code, first, count = _distinct(lang.astype(np.int64) * len(sizes) + w.ids, at, w.fresh, len(w.ids))
    return _Runs(code, first, count, [h[w.ids[first]] for h in hashes], sizes[w.ids[first]])


def _longer(w, runs: _Runs, n: int, hashes, sizes, open_to: np.ndarray | None) -> _Runs:
    """Runs of ``n`` words, by their last word: a run of ``n - 1`` words ending just before it, and that word."""
    last = np.arange(n - 1, len(w.ids))
    whole = (w.piece[last] == w.piece[last - n + 1]) & (runs.code[last - 1] >= 0)
    if open_to is not None:
        whole &= open_to[last - 1] & open_to[last]
    last = last[whole]
    code, first, count = _distinct(runs.code[last - 1] * len(sizes) + w.ids[last], last, w.fresh, len(w.ids))
    word = w.ids[first]
    return _Runs(code, first, count, rolling.append([v[runs.code[first - 1]] for v in runs.values], [h[word] for h in hashes],
                                                    sizes[word]), sizes[word] + 1 + runs.size[runs.code[first - 1]])


def _salt(lang: str, n: int) -> int:
    """What fingerprints of a language and length are mixed with."""
    name = f"{n}:{lang}".encode()
    return (zlib.crc32(name) << 30 ^ zlib.crc32(name[::-1])) & _FULL


def _salts(langs: list[str], n: int) -> np.ndarray:
    return np.array([_salt(x, n) for x in langs], np.int64)


def _levels(w, row_lang, names, up_to: int, bitmap, bits: int, mask: int):
    """``(n, runs, key, chk)`` for each length; the last one pruned by ``bitmap`` of frequent runs one word shorter."""
    hashes = rolling.word_hashes(w.vocab, w.cuts)
    sizes = np.diff(w.cuts)
    lang = row_lang[w.row]
    runs = key = None
    for n in range(1, up_to + 1):
        open_to = None
        if runs is not None and bitmap is not None and n == up_to:
            open_to = np.r_[_marked(bitmap, key, bits), False][runs.code]
        runs = _single(w, lang, hashes, sizes) if n == 1 else _longer(w, runs, n, hashes, sizes, open_to)
        fp, chk = rolling.packed(runs.values)
        salt = _salts(names, n)[lang[runs.first]]
        key = (fp & mask) ^ salt
        yield n, runs, key, chk ^ (salt & _CHECK)


def _counter(up_to: int, emit: tuple[int, ...], bitmap, bits: int, mask: int, with_text: bool = False):
    """Rows of ``_COUNTED`` for the runs whose length is in ``emit``. A row of length 0 has the number of all words of a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            row_lang, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            keys = b.column(1).to_numpy()
            for w in slabs(b.column(2), KINDS, up_to - 1, limit=SLAB):
                if not len(w.ids):
                    continue
                for n, runs, key, chk in _levels(w, row_lang, names, up_to, bitmap.value if bitmap else None, bits, mask):
                    if n not in emit or not len(key):
                        continue
                    begin = runs.first - n + 1
                    cols = [key, chk, runs.count, keys[w.row[begin]] << 24 | w.start[begin] % _PLACES << 4 | n]
                    if with_text:
                        word = [w.vocab[s:e].tobytes() for s, e in zip(w.cuts[:-1], w.cuts[1:])]
                        cols.append([b" ".join(word[i] for i in w.ids[s:s + n]) for s in begin])
                    out = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _NAMES + ["phrase"][:with_text])
                    yield out.filter(pa.array(runs.count > 0)) if up_to > 1 else out
                if 1 in emit and not with_text:
                    total = np.bincount(row_lang[w.row], weights=w.fresh, minlength=len(names)).astype(np.int64)
                    salt, zero = _salts(names, 0), np.zeros(len(names), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (salt, zero, total, zero)], _NAMES)
    return run


def _texts(docs: DataFrame, text: str, lang: str, id_col: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.shiftrightunsigned(F.xxhash64(F.col(id_col), t), 24).alias("text_key"), t.alias("text"))


def _bitmap(df: DataFrame, key: str, bits: int):
    """Broadcast bitmap of the values of ``key``, in blocks of 4 KiB: at most ``bits / 8`` bytes come to the driver."""
    mark = F.pmod(F.expr(key), F.lit(bits)) + 1                              # Spark's blocks count from 1
    blocks = df.select(mark.alias("m")).groupBy(F.bitmap_bucket_number(F.col("m")).alias("block")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("m"))).alias("bytes"))
    out = np.zeros((bits // 32768 + 1) * 4096, np.uint8)
    for r in blocks.collect():                          # at most bits / 32768 + 1 rows
        out[(r.block - 1) * 4096:r.block * 4096] = np.frombuffer(r.bytes, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def _marked(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    mark = values % bits
    return (bitmap[mark >> 3] >> (mark & 7).astype(np.uint8) & 1).astype(bool)


# -- counting -----------------------------------------------------------------------------------------

def frequent_runs(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang",
                  id_col: str = "doc_id", bits: int = BITMAP, mask: int = _FULL) -> DataFrame:
    """``key, chk, a, spot`` of every run of 1 to ``max_words`` words (15 at most) found ``min_count`` times or
    more, and a row of length 0 for all words of a language."""
    if not 1 < max_words < 16:
        raise ValueError("max_words must be from 2 to 15")
    src = _texts(docs, text, lang, id_col)
    out, bitmap = None, None
    for n in range(2, max_words + 1):
        emit = (1, 2) if n == 2 else (n,)
        scan = src.mapInArrow(_counter(n, emit, bitmap, bits, mask), _COUNTED)
        counts = scan.groupBy("key").agg(F.sum("cnt").alias("a"), F.min("chk").alias("chk"), F.max("chk").alias("other"), F.min("spot").alias("spot")) \
            .where(f"a >= {min_count} OR {_LENGTH} = 0")
        counts = written(counts, f"collocations-{n}")
        clash = counts.where("chk <> other")
        counts = counts.drop("other")
        if not clash.isEmpty():
            again = recounted(src, clash, n, emit, mask).where(f"a >= {min_count}")
            counts = written(counts.join(clash.select("key"), "key", "left_anti").unionByName(again), f"collocations-{n}")
        out = counts if out is None else out.unionByName(counts)
        if n < max_words:
            bitmap = _bitmap(counts.where(f"{_LENGTH} = {n}"), "key", bits)
    return out


def recounted(src: DataFrame, clash: DataFrame, up_to: int, emit: tuple[int, ...], mask: int) -> DataFrame:
    """Runs whose fingerprint collided, counted by their text."""
    rows = src.mapInArrow(_counter(up_to, emit, None, 0, mask, True), _COUNTED + ", phrase binary")
    return rows.join(clash.select("key"), "key", "left_semi").groupBy("key", "chk", "phrase").agg(
        F.sum("cnt").alias("a"), F.min("spot").alias("spot")).drop("phrase")


# -- reading back ---------------------------------------------------------------------------------------

_READ = "lang string, n int, key bigint, chk bigint, a bigint, phrase string, total bigint, parts array<struct<i:int,j:int,key:bigint,chk:bigint>>"


def _read(found: list[tuple], n: int, mask: int) -> pa.RecordBatch:
    """``found``: lang, words, key, check and count of runs of ``n`` words. What does not hash to its key and check is left out."""
    langs, words, keys, checks, counts = zip(*found)
    place: dict[bytes, int] = {}
    ids = np.array([[place.setdefault(x, len(place)) for x in ws] for ws in words])
    cuts = np.r_[0, np.cumsum([len(x) for x in place])].astype(np.int64)
    hashes, sizes = rolling.word_hashes(np.frombuffer(b"".join(place), np.uint8), cuts), np.diff(cuts)
    names = sorted(set(langs))
    lang = np.searchsorted(names, langs)
    salts = {m: _salts(names, m)[lang] for m in range(n + 1)}
    parts, whole = [], None
    for i in range(n):
        run = [h[ids[:, i]] for h in hashes]
        for j in range(i + 1, n + 1):
            run = run if j == i + 1 else rolling.append(run, [h[ids[:, j - 1]] for h in hashes], sizes[ids[:, j - 1]])
            fp, chk = rolling.packed(run)
            pair = ((fp & mask) ^ salts[j - i], chk ^ (salts[j - i] & _CHECK))
            if j - i == n:
                whole = pair
            else:
                parts.append((i, j, *pair))
    good = (whole[0] == np.array(keys)) & (whole[1] == np.array(checks))
    m, k = len(found), len(parts)
    flat = pa.StructArray.from_arrays([pa.array(np.tile(np.array([p[0] for p in parts], np.int32), m)), pa.array(np.tile(np.array([p[1] for p in parts], np.int32), m)),
                                       pa.array(np.stack([p[2] for p in parts], 1).ravel()), pa.array(np.stack([p[3] for p in parts], 1).ravel())],
                                      ["i", "j", "key", "chk"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), flat)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs), pa.array(np.full(m, n, np.int32)), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(counts, pa.int64()),
         pa.array([b" ".join(ws).decode("utf-8", "replace") for ws in words]), pa.array(salts[0]), lists],
        ["lang", "n", "key", "chk", "a", "phrase", "total", "parts"]).filter(pa.array(good))


def _words_at(text: bytes, at: int, n: int) -> list[bytes] | None:
    """The ``n`` words from a place on, None unless they are one run that starts there."""
    if at and not KINDS[text[at - 1]]:
        return None
    words = []
    while len(words) < n and (m := _WORDS.match(text, at)):
        words.append(m.group().lower())
        at = m.end()
        while text[at:at + 1] in (b" ", b"\t"):
            at += 1
    return words if len(words) == n else None


def _reader(mask: int):
    """Phrases at their occurrences, with fingerprints of their parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list] = {}
            for lang, text, spots in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist()):
                for s in spots:
                    n = s["spot"] & 15
                    for place in range(s["spot"] >> 4 & _PLACES - 1, len(text), _PLACES):
                        if words := _words_at(text, place, n):
                            found.setdefault(n, []).append((lang, words, s["key"], s["chk"], s["a"]))
            for n, rows in found.items():
                yield _read(rows, n, mask)
    return run


def phrases(docs: DataFrame, runs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", bits: int = BITMAP,
            mask: int = _FULL) -> DataFrame:
    """Text of every frequent run of two words or more, read at its occurrence, and fingerprints of its parts ``i`` to ``j``."""
    spots = runs.where(f"{_LENGTH} > 1").select(F.expr(_TEXT_OF).alias("text_key"), F.struct("key", "chk", "a", "spot").alias("s"))
    bitmap = _bitmap(spots, "text_key", bits)

    def needed(batches):
        for b in batches:
            yield b.filter(pa.array(_marked(bitmap.value, b.column(1).to_numpy(), bits)))

    spots = spots.groupBy("text_key").agg(F.collect_list("s").alias("spots"))        # fewer than the words of the text
    met = _texts(docs, text, lang, id_col).mapInArrow(needed, "lang string, text_key bigint, text string").join(spots, "text_key")
    read = met.select("lang", "text", "spots").mapInArrow(_reader(mask), _READ)
    return read.dropDuplicates(["key", "chk"])                       # repeated rows show an occurrence twice


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP,
                 absorb_percent: int = ABSORB_PERCENT, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
                 bits: int = BITMAP, mask: int = _FULL) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language (all, if None)."""
    runs = frequent_runs(docs, max_words, min_count, text, lang, id_col, bits, mask)
    found = written(phrases(docs, runs, text, lang, id_col, bits, mask), "collocations-phrases")
    me = ["key", "chk"]
    counts = runs.select(F.col("key").alias("part"), F.col("chk").alias("part_chk"), F.col("a").alias("f"))
    parts = found.select(*me, "n", "a", F.explode("parts").alias("p")).select(
        *me, "n", "a", "p.i", "p.j", F.col("p.key").alias("part"), F.col("p.chk").alias("part_chk"))
    # parts at either end have the counts of a cut; parts of two words or more may be absorbed
    sides = parts.where("i = 0 OR j = n").withColumn("k", F.expr("CASE WHEN i = 0 THEN j ELSE i END")) \
        .join(counts, ["part", "part_chk"]).groupBy(*me, "k").agg(
            F.max(F.expr("CASE WHEN i = 0 THEN f END")).alias("l"), F.max(F.expr("CASE WHEN i > 0 THEN f END")).alias("r"), F.max("a").alias("a"))
    taken = parts.where("j - i > 1").groupBy(F.col("part").alias("key"), F.col("part_chk").alias("chk")).agg(F.max("a").alias("longest"))
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    cut = sides.withColumn("score", score.cast("bigint")).groupBy(*me).agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    left = found.drop("parts").join(taken, me, "left") \
        .where(f"longest IS NULL OR CAST(100 AS DECIMAL(3, 0)) * longest < CAST({absorb_percent} AS DECIMAL(3, 0)) * a").join(cut, me)
    words = runs.where(f"{_LENGTH} = 0").select(F.col("key").alias("total"), F.col("a").alias("words"))           # one row a language
    out = left.join(words, "total").select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"),
                                           F.col("words").alias("n"), F.col("c.score").alias("score"))
    best = (F.desc("score"), F.desc("a"), "phrase")
    if top is not None:                                 # a language's best are sought in parts first, so that no task sorts all its phrases
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
        out = out.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= top).drop("_place")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
