"""CSV sinks (K1, K2) with Python ``csv.writer`` conventions: minimal quoting, doubled quotes,
blanks kept, empty strings written as empty fields."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.functions.text import preview

log = logging.getLogger(__name__)

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", compression: str | None = None) -> None:
    """K1: header + rows; one file per task (a folder of part files), plain or compressed (``gzip``: Python's ``csv`` over ``gzip.open``)."""
    df.write.mode(mode).options(sep=sep, compression=compression or "none", **CSV_OPTIONS).csv(path)


def save_documents(df: DataFrame, path: str, id_col: str = "id_cve", doc_col: str = "documents",
                   n_preview: int = 3, preview_chars: int = 200, order: str = "pos", compression: str | None = None) -> DataFrame | None:
    """K2: write unless empty (then warn and skip); return the numbered preview of the first
    rows (P13) for display.

    Documents are made for the file and for the first rows only: whether there is a row, and which come first, is read from ``id_col`` and ``order``."""
    if df.select(id_col).isEmpty():
        log.warning("No data to save")
        return None
    write_csv(df.select(id_col, doc_col), path, compression=compression)
    first = df
    if order in df.columns:
        # the n-th smallest key bounds the rows that may come first; null keys come before all others
        last = df.select(order).orderBy(order).limit(n_preview).collect()[-1][0]
        few = F.col(order).isNull() if last is None else F.col(order).isNull() | (F.col(order) <= F.lit(last))
        first = df.where(few).orderBy(order)
    return first.select(id_col, doc_col).limit(n_preview).select(
        id_col, preview(F.col(doc_col), preview_chars).alias("preview"))
