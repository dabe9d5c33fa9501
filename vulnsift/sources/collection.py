"""Vector collection as a Parquet table folder plus a metadata table.

``add`` is insert-if-absent, the documented behaviour of the reference's store: ids already
in the collection are skipped, and within one batch the first row per id wins. Both steps are
distributed: the in-batch dedupe is a ``min_by`` aggregate (partial aggregation, so a hot
duplicated id never lands whole in one task) and the existing-id check reads ids only.

Rows are stored in ``BUCKETS`` folders by a hash of the id. An add reads the ids of those buckets that its own ids fall into;
if these are at most ``FEW_IDS`` (counted), they are broadcast, and no stored row is shuffled; a larger batch meets them in a
shuffle join. Appends go through the file committer, so a lost task is redone without duplicates.

``embedding`` makes the vector of a row that is about to be stored from its other columns: after duplicates and known ids are gone and
the rows are dealt to their buckets, so no vector is shuffled. A bucket of many rows is written by several tasks, of about ``FILE_ROWS``
rows each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vulnsift.session import checkpoint_dir

DEFAULT_METADATA = {"hnsw:space": "cosine"}
BUCKETS = 32
FEW_IDS = 1_000_000
FILE_ROWS = 1 << 17


def _missing(e: AnalysisException) -> bool:
    """Only a path that is not there reads as an empty collection; any other failure is one."""
    return e.getCondition() == "PATH_NOT_FOUND"


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.path = f"{root.rstrip('/')}/{name}"

    @property
    def data_path(self) -> str:
        return f"{self.path}/data"

    @property
    def meta_path(self) -> str:
        return f"{self.path}/_metadata"

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, name: str,
                       metadata: dict[str, str] | None = None) -> "Collection":
        """Open the named collection, or create it with ``metadata`` (metric etc.)."""
        c = cls(spark, root, name)
        if c.metadata() is None:
            meta = metadata if metadata is not None else DEFAULT_METADATA
            spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string") \
                .coalesce(1).write.mode("overwrite").json(c.meta_path)
        return c

    def metadata(self) -> dict[str, str] | None:
        try:
            rows = self.spark.read.schema("key string, value string").json(self.meta_path).collect()
        except AnalysisException as e:
            if not _missing(e):
                raise
            return None
        return {r.key: r.value for r in rows} if rows else None

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.data_path)
        except AnalysisException as e:
            if not _missing(e):
                raise
            return None

    def read(self) -> DataFrame:
        stored = self._stored()
        if stored is None:
            return self.spark.createDataFrame([], "id string, document string, embedding array<float>, pos bigint")
        return stored.drop("bucket")

    def known_ids(self, ids: DataFrame) -> DataFrame | None:
        """Those of ``ids(id, bucket)``, all different, that are stored; None if nothing is."""
        stored = self._stored()
        if stored is None:
            return None
        n, buckets = ids.agg(F.count(F.lit(1)), F.collect_set("bucket")).first()          # at most BUCKETS numbers
        held = stored.where(F.col("bucket").isin(buckets)).select("id")
        if n <= FEW_IDS:
            return F.broadcast(held.join(F.broadcast(ids.select("id")), "id", "left_semi"))
        return ids.select("id").join(held, "id", "left_semi")

    def add(self, rows: DataFrame, order_col: str = "pos", embedding: Column | None = None) -> None:
        """Append rows whose id is not stored yet; first row per id (by ``order_col``). ``rows`` have a column ``embedding``,
        or the vector is ``embedding`` of their other columns."""
        cols = ["document", "embedding", order_col] if embedding is None else [c for c in rows.columns if c != "id"]
        bucket = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(BUCKETS)).cast("int").alias("bucket")
        # ids already stored go first, so that nothing is embedded for them
        known = self.known_ids(rows.select("id").distinct().select("id", bucket))
        fresh = rows if known is None else rows.join(known, "id", "left_anti")
        first = fresh.groupBy("id").agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("r")) \
            .select("id", *[F.col(f"r.{c}").alias(c) for c in cols], bucket)
        if embedding is None:
            dealt = first.repartition("bucket")
        else:
            checkpoint_dir(self.spark)
            first = first.checkpoint()                              # without vectors
            parts = math.ceil(first.count() / (BUCKETS * FILE_ROWS))
            if not parts and known is not None:
                return
            part = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(max(1, parts)))
            dealt = first.repartition(BUCKETS * max(1, parts), "bucket", part) \
                .select("id", "document", embedding.alias("embedding"), order_col, "bucket")
        dealt.write.mode("append").partitionBy("bucket").parquet(self.data_path)
