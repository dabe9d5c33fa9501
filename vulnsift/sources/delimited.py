"""Delimited-text sources.

Spark's CSV defaults differ from Python's ``csv``/pandas: the escape is ``\\`` and outer blanks
are trimmed on write. The readers/writers here set the options that make files round-trip
equal with the Python tools the reference uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_semicolon_unquoted(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``;``-separated, header, no quoting at all (quote characters are data)."""
    r = spark.read.options(header=True, sep=";", quote="")
    return (r.schema(schema) if schema else r).csv(path)


def read_semicolon(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``;``-separated with standard double-quote quoting (quotes doubled inside)."""
    r = spark.read.options(header=True, sep=";", quote='"', escape='"', multiLine=True)
    return (r.schema(schema) if schema else r).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``,``-separated with header, standard quoting, fields may hold newlines."""
    r = spark.read.options(header=True, quote='"', escape='"', multiLine=True)
    return (r.schema(schema) if schema else r).csv(path)
