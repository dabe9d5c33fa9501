"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are split by the tokenizer's own pattern; every distinct piece of a batch is merged once.
The pieces to merge lie as byte symbols in one flat array. In each round the ranks of all
neighbouring pairs are found by binary search over the sorted pair keys, ``minimum.reduceat`` gives
every piece its lowest rank, and all occurrences of that pair in the piece are merged (in a run of
equal symbols every second one, from the left). A piece leaves the rounds when no pair of it
has a rank. That is the same result as merging one pair at a time, because a merge only makes
pairs of higher rank.

Pieces of more than ``LONG_PIECE`` bytes (letters or symbols without white space) would be read whole once a round. They
merge together, one rank a round for all of them: a heap gives the lowest rank, a table the places where it was seen, and
only the pairs beside a merge are looked up anew, so a round costs what it changes and there are as many rounds as ranks occur.

The vocabulary file is read once on the driver and broadcast: its size is fixed whatever
the data. Work is narrow: no shuffle, batches of about a million characters, a long text in slices
of tokens. The table of pieces already merged is emptied when it has ``CACHE_PIECES``
entries; that changes no result.

Defined cases: null text is the empty text and gives no ids; the tokenizer's special tokens
are recognised inside texts, as the tokenizers library does by default; repeated rows give
repeated results; null ids are kept; an empty table gives no rows; other columns are ignored.
Unknown ids are refused by ``decode``; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.llm.common import id_text

# Fixed value: the split pattern of the byte-level tokenizer family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 150_000
BATCH_CHARS = 1_000_000
SLICE_TOKENS = 200_000
LONG_PIECE = 512
_NONE = np.iinfo(np.int32).max


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for all (s, n)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class _Index(dict):
    """Piece -> number, numbering new pieces as they come."""

    def __missing__(self, piece):
        n = self[piece] = len(self)
        return n


class Codec:
    def __init__(self, spec: bytes, cache_pieces: int = CACHE_PIECES):
        j = json.loads(spec)
        model, alphabet = j["model"], _byte_alphabet()
        if model["type"] != "BPE" or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" \
                or j["pre_tokenizer"].get("add_prefix_space") or j.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *special.values()])
        raw: list[bytes] = [b""] * size
        known = np.zeros(size, dtype=bool)
        for tok, i in vocab.items():
            raw[i], known[i] = bytes(alphabet[c] for c in tok), True
        for tok, i in special.items():
            raw[i], known[i] = tok.encode(), True
        self.known, self.special = known, special
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.tok_len = np.array([len(b) for b in raw], dtype=np.int64)
        self.tok_start = np.cumsum(self.tok_len) - self.tok_len
        self.tok_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.byte_id = np.zeros(256, dtype=np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        keys, merged = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            keys.append(vocab[a] << 20 | vocab[b])
            merged.append(vocab[a + b])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.rank = order.astype(np.int32)
        self.merged = np.array(merged, dtype=np.int32)          # by rank
        self.split = regex.compile(SPLIT)
        self.cache_pieces = cache_pieces
        self._reset()

    def _reset(self):
        self.index = _Index()
        self.p_start = np.zeros(0, dtype=np.int64)
        self.p_len = np.zeros(0, dtype=np.int64)
        self.p_flat = np.zeros(0, dtype=np.int32)

    # -- merging -----------------------------------------------------------------------------
    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one piece after another, ids per piece)."""
        long = np.fromiter((len(p) > LONG_PIECE for p in pieces), dtype=bool, count=len(pieces))
        if not long.any():
            return self._merge_short(pieces)
        parts = [self._merge_short([p for p, x in zip(pieces, long) if not x]), self._merge_long([p for p, x in zip(pieces, long) if x])]
        lens, starts = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        for mine, (ids, own), before in zip((~long, long), parts, (0, len(parts[0][0]))):
            lens[mine], starts[mine] = own, before + np.cumsum(own) - own
        return _gather(np.concatenate([ids for ids, _ in parts]), starts, lens), lens

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair of symbols, ``_NONE`` without one."""
        pair = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.rank[at], _NONE)

    def _merge_long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n, ends = len(sym), np.cumsum(lens)
        # neighbours by place; n stands for none and has a symbol of its own slot
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - lens] = n, n
        rank = np.full(n + 1, _NONE, dtype=np.int32)
        rank[:n - 1] = self._ranks(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        sym = np.append(sym, np.int32(-1))
        there = np.ones(n + 1, dtype=bool)
        seen: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = rank[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts, cuts[1:]):
                r = int(ranks[a])
                if r not in seen:
                    seen[r] = []
                    heapq.heappush(heap, r)
                seen[r].append(places[a:b])

        start = np.flatnonzero(rank[:n] != _NONE)
        if len(start):
            note(start)
        while heap:
            r = heapq.heappop(heap)
            found = seen.pop(r)
            take = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            take = take[there[take] & (rank[take] == r)]        # others were changed by a merge since
            if not len(take):
                continue
            if len(take) > 1:
                run = np.r_[True, after[take[:-1]] != take[1:]]     # runs of one repeated symbol
                at = np.arange(len(take))
                take = take[(at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0]
            gone = after[take]
            there[gone] = False
            sym[take] = self.merged[r]
            after[take] = after[gone]
            before[after[take]] = take
            beside = before[take]
            again = np.unique(np.concatenate([take, beside[beside != n]]))
            right = after[again]
            rank[again] = np.where(right == n, _NONE, self._ranks(sym[again], sym[right]))
            again = again[rank[again] != _NONE]
            if len(again):
                note(again)
        word = np.repeat(np.arange(len(pieces)), lens)[there[:n]]
        return sym[:n][there[:n]], np.bincount(word, minlength=len(pieces)).astype(np.int64)

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        word = np.repeat(np.arange(n), lens)
        out_sym, out_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE, dtype=np.int32)
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(sym[:-1], sym[1:]), _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            best_of = np.repeat(best, sizes)
            live = best_of != _NONE
            if not live.all():                              # finished pieces leave
                out_sym.append(sym[~live])
                out_word.append(word[~live])
                sym, word, rank, best_of = sym[live], word[live], rank[live], best_of[live]
                if not len(sym):
                    break
            take = np.flatnonzero(rank == best_of)
            run = np.r_[True, np.diff(take) != 1]           # runs of one repeated symbol
            run_start = take[run][np.cumsum(run) - 1]
            take = take[(take - run_start) % 2 == 0]
            sym[take] = self.merged[rank[take]]
            keep = np.ones(len(sym), dtype=bool)
            keep[take + 1] = False
            sym, word = sym[keep], word[keep]
        if not out_sym:
            return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n).astype(np.int64)

    def _ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given by number; merges the pieces that are new."""
        if len(self.index) > len(self.p_len):
            ids, lens = self.merge([p.encode() for p in islice(self.index, len(self.p_len), None)])
            self.p_start = np.r_[self.p_start, len(self.p_flat) + np.cumsum(lens) - lens]
            self.p_len = np.r_[self.p_len, lens]
            self.p_flat = np.r_[self.p_flat, ids]
        lens = self.p_len[numbers]
        return _gather(self.p_flat, self.p_start[numbers], lens), lens

    # -- texts -------------------------------------------------------------------------------
    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens; the texts together are a bounded batch."""
        numbers: list[int] = []
        counts = []
        for t in texts:
            before = len(numbers)
            numbers += map(self.index.__getitem__, self.split.findall(t))
            counts.append(len(numbers) - before)
        ids, lens = self._ids_of(np.array(numbers, dtype=np.int64))
        ends = np.r_[0, np.cumsum(lens)][np.cumsum(counts)] if counts else np.zeros(0, dtype=np.int64)
        if len(self.index) > self.cache_pieces:
            self._reset()
        return [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]

    def _long(self, text: str) -> np.ndarray:
        """Ids of one long text, in slices of tokens."""
        found, parts = (m.group() for m in self.split.finditer(text)), []
        while chunk := list(islice(found, SLICE_TOKENS)):
            parts.append(self._ids_of(np.fromiter(map(self.index.__getitem__, chunk), np.int64, len(chunk)))[0])
            if len(self.index) > self.cache_pieces:
                self._reset()
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def _any(self, text: str) -> np.ndarray:
        """Ids of a text that is long or has special tokens."""
        if self.special_re is None or not self.special_re.search(text):
            return self._long(text)
        parts = [np.array([self.special[p]], dtype=np.int32) if p in self.special else self._long(p)
                 for p in self.special_re.split(text) if p]
        return np.concatenate(parts)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of every text, in order."""
        batch, chars = [], 0
        for t in texts:
            if len(t) > BATCH_CHARS or (self.special_re is not None and any(s in t for s in self.special)):
                yield from self._plain(batch)
                batch, chars = [], 0
                yield self._any(t)
                continue
            batch.append(t)
            chars += len(t)
            if chars > BATCH_CHARS:
                yield from self._plain(batch)
                batch, chars = [], 0
        yield from self._plain(batch)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("unknown token id")
        parts = [_gather(self.tok_bytes, self.tok_start[c], self.tok_len[c]).tobytes()
                 for c in (ids[i:i + SLICE_TOKENS] for i in range(0, len(ids), SLICE_TOKENS))]
        return b"".join(parts).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(spec: bytes) -> Codec:
    """One codec per worker process and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_spec(path))


def _rows(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of every text. ``tokenizer``: path of the vocabulary file on the driver."""
    spec = _shared(docs.sparkSession, tokenizer)

    def run(batches):
        c = codec(spec.value)
        for whole in batches:
            for b in _rows(whole):
                ids = list(c.encode(b.column(1).to_pylist()))
                lens = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat))],
                                                 ["doc_id", "ids"])

    src = id_text(docs, text, id_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids are the empty list."""
    spec = _shared(encoded.sparkSession, tokenizer)

    def run(batches):
        c = codec(spec.value)
        for whole in batches:
            for b in _rows(whole):
                texts = [c.decode(np.array(x, dtype=np.int64)) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    src = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    spec = _shared(docs.sparkSession, tokenizer)

    def run(batches):
        c = codec(spec.value)
        for whole in batches:
            for b in _rows(whole):
                n, hids, htext = [], [], []
                for ids in c.encode(b.column(1).to_pylist()):
                    n.append(len(ids))
                    hids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    htext.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(hids, pa.string()), pa.array(htext, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = id_text(docs, text, id_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, "
                               "ids_sha256 string, decoded_sha256 string")
