"""Keyed tables that a repeated batch leaves as they are: versions of hash buckets, with tombstones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from triagelake.operators.similarity import cut


class KeyedTable:
    """Rows by key in Parquet folders ``bucket=b/version=v``.

    An upsert of version v rewrites the buckets that it touches, from what was there before v, and no others; so running a
    version again gives the same table, and readers of earlier versions are not disturbed. Readers take the newest version
    of each bucket. Deleted keys stay as tombstones, since a bucket that had none left would show an old version.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = StructType.fromDDL(schema)

    def stored(self, before: int | None = None) -> DataFrame:
        """Every row of the newest versions (older than ``before``), tombstones included, with ``deleted`` and ``bucket``."""
        whole = StructType([*self.schema.fields, *StructType.fromDDL("deleted boolean, bucket int, version long").fields])
        try:
            rows = self.spark.read.schema(whole).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole).drop("version")
        if before is not None:
            rows = rows.where(F.col("version") < before)
        newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # one row for each bucket
        return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version")

    def rows(self, before: int | None = None) -> DataFrame:
        return self.stored(before).where(~F.col("deleted")).select(self.schema.names)

    def upsert(self, changes: DataFrame, version: int) -> None:
        """Rows of changes (each key once; with a boolean ``deleted``, or none for no deletions) take the place of theirs."""
        if "deleted" not in changes.columns:
            changes = changes.withColumn("deleted", F.lit(False))
        changes = changes.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields), F.coalesce("deleted", F.lit(False)).alias("deleted"))
        changes = cut(changes.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))  # read three times
        touched = changes.select("bucket").distinct()
        old = self.stored(version).join(F.broadcast(touched), "bucket", "left_semi").join(changes.select(*self.keys), self.keys, "left_anti")
        out = old.unionByName(changes).withColumn("version", F.lit(version).cast("long"))
        # only the touched buckets' folders of this version are replaced
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
