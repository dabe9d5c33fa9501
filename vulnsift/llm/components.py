"""Connected components of a link table by alternating large-star and small-star steps.

Each step points neighbours at a smaller node; the number of rounds is logarithmic in practice, also
for long chains. A hub's links never meet in one task as a list: its minimum is a partially
aggregated ``min``, and the join that hands it out is split by adaptive skew handling.

Up to ``FEW_LINKS`` links, counted first, are stored in one partition, and their rounds need no shuffle: a round of a small
table is otherwise some ten stages of as many tasks as there are shuffle partitions, whose figures the driver has to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm.common import cut

FEW_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``links(a, b)`` that are not the smallest of their component."""
    e = cut(links.select("a", "b").where("a <> b").distinct())
    few = e.count() <= FEW_LINKS

    def together(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    def lowest(df: DataFrame) -> DataFrame:
        """Add ``m``, the smallest ``b`` of each ``a``: in one partition by a window, as a join would deal both sides anew."""
        if few:
            return df.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        return df.join(df.groupBy("a").agg(F.min("b").alias("m")), "a")

    e = together(cut(together(e))) if few else e
    seen = None
    while True:
        both = together(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        met = lowest(large)
        e = together(cut(together(met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                                  .unionByName(met.select("a", F.col("m").alias("b")))).distinct()))
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = state
