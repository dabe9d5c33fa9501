"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.session import checkpoint_dir


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A higher-order function re-evaluates an outer expression that its lambda names for every
    element; a lambda variable is evaluated once, so the value travels as one."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Only the two columns an operator works on, null text as the empty text; whatever other
    columns the table has (also ones named like an operator's own) stay out of the plan."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def hash_share(id_col: str, limit: int, total: int) -> Column:
    """True for about ``limit`` of ``total`` distinct ids, those with the smallest hash. Narrow, unlike an ordered
    limit, of which every task would send its ``limit`` first rows to the driver."""
    u = F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(float(1 << 53))
    return u < F.lit(limit / total if total > limit else 1.0)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet under the shared checkpoint folder and read it back: the wide
    form of ``cut`` (compressed, column-pruned on each later read)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
