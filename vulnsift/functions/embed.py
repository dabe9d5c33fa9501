"""Embedding backends (V1-V3).

The reference embeds text with a pretrained sentence-embedding model on a GPU. No model ships here, so the
default backend is a *hashed bag of words*: word tokens, lower-cased, each hashed by md5 into
``dim`` buckets, counted, L2-normalised. It is computed as one projection (no shuffle) and
has an exact SQL twin, so search results can be checked by an oracle. It is a
stand-in, not the reference's model. Real models plug in through ``model_embedder``: an
iterator pandas UDF that loads the model once per Python worker and embeds Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnsift.functions.text import WORD_RUN
from vulnsift.session import ship_package

DEFAULT_DIM = 64


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn`` (a one-element ``transform``).

    Catalyst re-evaluates an expression at every reference inside a lambda; a lambda
    *variable* is evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


# Word characters and lower case of ASCII bytes: what WORD_RUN and lower() make of them. Bytes of other characters come only in words.
_WORD_BYTE = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(128)] + [True] * 128)
_LOWER_BYTE = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)
_LEADING_WORD = re.compile(rb"[a-zA-Z0-9_\x80-\xff]+")


def _words(text) -> Column:
    """What the Arrow functions take of a text: the text itself if it is ASCII, whose words they find themselves, and else its lower-cased
    tokens, with blanks between them."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.array_join(F.regexp_extract_all(F.lower(t), F.lit(WORD_RUN), 0), " "))


def words_in_place(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.DictionaryArray | None]:
    """How many words each text of :func:`_words` has, and all of them in order, found at once and read where they lie: a word is encoded
    with the separators that follow it (:func:`leading_word`)."""
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, kind)
    if ends[0] == ends[-1]:
        return np.zeros(n, np.int64), None
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    word = _WORD_BYTE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = word[heads]                              # a word ends with its text
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(n, np.int64), None
    offsets = np.append(starts, len(data)).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER_BYTE[data] if lower else data)])
    return np.diff(np.searchsorted(starts, ends)), flat.dictionary_encode()


def leading_word(entry: bytes) -> bytes:
    return _LEADING_WORD.match(entry)[0]


def _histogram(texts: pa.Array, dim: int) -> np.ndarray:
    """Bucket counts of each row of :func:`_words`. md5 runs once per *distinct* word of the batch (words repeat a lot), buckets are gathered
    back by the dictionary indices and the histogram of all rows is one ``bincount``."""
    n = len(texts)
    per_row, enc = words_in_place(texts)
    if enc is None:
        return np.zeros((n, dim), np.int64)
    buckets = np.fromiter((int(hashlib.md5(leading_word(w)).hexdigest()[:8], 16) % dim for w in enc.dictionary.to_pylist()),
                          dtype=np.int64, count=len(enc.dictionary))
    at = np.repeat(np.arange(n, dtype=np.int64) * dim, per_row)
    at += buckets[enc.indices.to_numpy(zero_copy_only=False)]
    return np.bincount(at, minlength=n * dim).reshape(n, dim)


_TOKEN_UDFS: dict = {}


def _token_histogram_udf(dim: int):
    """Arrow UDF: words -> L2-normalised list<double>(dim)."""
    if dim in _TOKEN_UDFS:
        return _TOKEN_UDFS[dim]

    @F.arrow_udf("array<double>")
    def token_hist(texts: pa.Array) -> pa.Array:
        counts = _histogram(texts, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        norms[norms == 0] = 1.0
        out = (counts / norms).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)), pa.array(out))

    _TOKEN_UDFS[dim] = token_hist
    return token_hist


def hashed_embedding(text, dim: int = DEFAULT_DIM) -> Column:
    """``array<double>`` of length ``dim``: L2-normalised bucket counts of the word tokens.

    An ASCII text crosses to Python as it is (Arrow) and is cut there a batch at a time; any other text is tokenised in the JVM,
    whose Unicode classes decide. Each distinct token of a batch is hashed once and the histogram of the batch is one
    vectorised ``bincount``. Same vector as the SQL twin's."""
    ship_package()                       # active session, if any
    return _token_histogram_udf(dim)(_words(text))


_COUNT_TYPES = (np.uint8, np.uint16, np.uint32)


def packed_counts(counts: np.ndarray) -> pa.Array:
    """Rows of counts as bytes, each in the narrowest of ``_COUNT_TYPES`` that holds it."""
    n, dim = counts.shape
    most = counts.max(axis=1, initial=0)
    if not n or most.max() <= 255:
        data = counts.astype(np.uint8)
        return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.py_buffer(data)])
    kinds = np.searchsorted([255, 65535], most)
    return pa.array([row.astype(_COUNT_TYPES[k]).tobytes() for row, k in zip(counts, kinds)], pa.binary())


def _packed_udf(dim: int):
    """Arrow UDF: words -> the bucket counts of a row as bytes."""
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return packed_counts(_histogram(texts, dim))

    return packed


def packed_embedding(text, dim: int = DEFAULT_DIM) -> Column:
    """The hashed bag of words of :func:`hashed_embedding` before it is scaled: ``binary`` counts, one byte a bucket for most texts
    (two or four where a bucket has more than 255 or 65535 words), so that vectors take little room in a shuffle."""
    ship_package()
    return _packed_udf(dim)(_words(text))


def packed_embeddings(texts, dim: int = DEFAULT_DIM) -> Column:
    """:func:`packed_embedding` of every text of an array: ``array<binary>``."""
    @F.arrow_udf("array<binary>")
    def packed(texts: pa.Array) -> pa.Array:
        counts = _histogram(texts.flatten(), dim)
        lengths = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), packed_counts(counts))

    ship_package()
    t = F.col(texts) if isinstance(texts, str) else texts
    return packed(F.transform(t, _words))


def unpacked(col: pa.Array, dim: int = DEFAULT_DIM) -> np.ndarray:
    """``binary`` counts -> (rows, dim) float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1] if len(col) and not col.null_count else []
    if len(ends) and (np.diff(ends) == dim).all():                   # one byte a bucket, as in most batches
        return np.frombuffer(col.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(col), dim).astype(np.float64)
    rows = col.to_pylist()
    out = np.zeros((len(rows), dim))
    for size, kind in enumerate(_COUNT_TYPES):
        at = [i for i, r in enumerate(rows) if len(r) == dim << size]
        if at:
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return out


def unpacked_embedding(packed, dim: int = DEFAULT_DIM) -> Column:
    """The vector of :func:`hashed_embedding` from the counts of :func:`packed_embedding`."""
    @F.arrow_udf("array<double>")
    def scaled(col: pa.Array) -> pa.Array:
        counts = unpacked(col, dim)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        norms[norms == 0] = 1.0
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(col) + 1) * dim, dim, dtype=np.int32)), pa.array((counts / norms).ravel()))

    ship_package()
    return scaled(F.col(packed) if isinstance(packed, str) else packed)


def hashed_embedding_sql(text_sql: str, dim: int = DEFAULT_DIM) -> str:
    """DuckDB twin of :func:`hashed_embedding` returning the *unnormalised* counts (cosine
    does not care about scale)."""
    return (f"list_transform(range(0, {dim}), lambda i: len(list_filter("
            f"list_transform(regexp_extract_all(lower(coalesce({text_sql}, '')), '{WORD_RUN}'), "
            f"lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim}), lambda b: b = i))::DOUBLE)")


def model_embedder(load_model: Callable[[], Callable[[list[str]], list[list[float]]]],
                   return_type: str = "array<float>"):
    """Pandas UDF factory for a real model: ``load_model()`` runs once per worker process and
    returns ``encode(list_of_texts) -> list_of_vectors``. Arrow batches are the model batches
    (``spark.sql.execution.arrow.maxRecordsPerBatch``)."""

    @F.pandas_udf(return_type)
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_model()
        for s in batches:
            yield pd.Series(list(encode(s.fillna("").tolist())))

    return _embed
