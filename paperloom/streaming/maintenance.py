"""Results kept up to date by batch: a late document changes its own result and those of the documents related to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored


class Maintained:
    """Documents, their keys and their results as tables under ``path``, in folders by bucket.

    Documents are related if they agree on all columns of one of ``related`` (nulls agree with
    nothing).  ``evaluate(affected, documents)`` gives the results (``id`` and the rest of
    ``result``) of the ids in ``affected``, from the documents that share a key with any of them.

    A batch reads and rewrites only the buckets of its documents, of their old and new keys,
    and of the documents whose results it changes.  A rewritten bucket is its rows without
    those of the batch, and those of the batch, so a batch that is applied again (after a
    failure, say) leaves the same tables.
    """

    def __init__(self, spark: SparkSession, path: str, id: str, document: T.StructType, related: list[list[str]], evaluate: Callable[[DataFrame, DataFrame], DataFrame], result: T.StructType, buckets: int = 64):
        self.spark, self.path, self.id, self.related, self.evaluate, self.buckets = spark, path, id, related, evaluate, buckets
        bucket = T.StructField("bucket", T.IntegerType())
        keys = [T.StructField("key", T.StringType()), document[id]]
        self.schemas = {"documents": T.StructType([*document, bucket]), "keys": T.StructType([*keys, bucket]), "results": T.StructType([*result, T.StructField("batch", T.LongType()), bucket])}

    # ------------------------------------------------------------------------ the tables

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schemas[table])
        rows = self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}").where(F.col(self.id).isNotNull())
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def results(self) -> DataFrame:
        return self.read("results").drop("bucket")

    def _in_bucket(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _buckets(*tables: DataFrame) -> list[int]:
        """At most as many as there are buckets."""
        return sorted({r.bucket for df in tables for r in df.select("bucket").distinct().collect()})

    def _keys(self, documents: DataFrame) -> DataFrame:
        """``key, id`` of each document: what it can be related by."""
        each = [F.when(~F.coalesce(*[F.when(F.col(c).isNull(), True) for c in columns], F.lit(False)), F.to_json(F.struct(F.lit(i).alias("by"), *columns))) for i, columns in enumerate(self.related)]
        keys = documents.select(F.explode(F.array_compact(F.array(*each))).alias("key"), self.id)
        return self._in_bucket(keys.distinct(), "key")

    def _merge(self, table: str, gone: DataFrame, new: DataFrame, buckets: list[int]) -> None:
        """In ``buckets`` the rows of the ids ``gone`` are replaced by ``new``; other folders are not touched."""
        if not buckets:
            return
        kept = self.read(table, buckets).join(gone.select(self.id).distinct(), self.id, "left_anti")
        names = self.schemas[table].names
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")  # a bucket that ends empty is rewritten too
        rows = stored(kept.select(names).unionByName(new.select(names)).unionByName(marks, allowMissingColumns=True), f"merged-{table}")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")

    # -------------------------------------------------------------------------- a batch

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Takes up a batch: rows as ``documents`` have them, a row an id, and ``deleted boolean``.  For ``foreachBatch``."""
        batch = stored(self._in_bucket(batch, self.id), "batch")
        own = self._buckets(batch)
        old = self.read("documents", own).join(batch.select(self.id), self.id, "left_semi")
        new = batch.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
        before, after = stored(self._keys(old), "old-keys"), stored(self._keys(new), "new-keys")
        touched = self._buckets(before, after)
        # Whoever shared a key before the batch, or does after it.
        changed = before.select("key").union(after.select("key")).distinct()
        partners = self.read("keys", touched).join(changed, "key", "left_semi").select(self.id)
        affected = stored(partners.union(batch.select(self.id)).distinct(), "affected")
        self._merge("documents", batch, new, own)
        self._merge("keys", batch, after, touched)
        # The affected documents, and all that share a key with one of them.
        placed = self._in_bucket(affected, self.id)
        places = self._buckets(placed)
        rows = self.read("documents", places).join(affected, self.id, "left_semi")
        keys = stored(self._keys(rows), "affected-keys")
        around = self.read("keys", self._buckets(keys)).join(keys.select("key").distinct(), "key", "left_semi").select(self.id).union(affected).distinct()
        around = stored(self._in_bucket(around, self.id), "around")
        members = self.read("documents", self._buckets(around)).join(around.select(self.id), self.id, "left_semi").drop("bucket")
        results = self.evaluate(rows.select(self.id), members).withColumn("batch", F.lit(batch_id).cast("long"))
        self._merge("results", affected, stored(self._in_bucket(results, self.id), "new-results"), places)
