"""Token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.functions import text as T


def bigrams(tokens) -> Column:
    """Adjacent pairs joined by a blank (empty for fewer than two tokens).

    ``zip_with(t, tail(t))`` is linear; pass a column (not an expression) so the token array
    is computed once rather than once per element."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda x: x.isNotNull())


def explode_tokens(df: DataFrame, id_col: str, tokens: Column, term: str = "term",
                   pos: str = "pos") -> DataFrame:
    """One row per (doc, position, term); narrow (no shuffle)."""
    return df.select(F.col(id_col), F.posexplode(tokens).alias(pos, term))


def whitespace_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """X6 + T1: ``str.split()`` tokens with their positions."""
    return explode_tokens(df, id_col, T.split_ws(text_col))


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """Tokens per document, as a projection."""
    return df.select(id_col, F.size(T.split_ws(text_col)).cast("bigint").alias("n_tokens"), *keep)


def total_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """Total token count (sum of sizes, partial aggregation; no explode needed)."""
    return df.agg(F.sum(F.size(T.split_ws(text_col))).cast("bigint").alias("n_tokens"))
