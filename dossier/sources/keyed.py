"""Tables by key in hash buckets: an update rewrites the buckets of its keys and no other.

Each bucket is a folder. A replacement reads the touched buckets, merges, stores the merged
rows, and then overwrites exactly these folders (dynamic partition overwrite). Applying the
same updates again gives the same rows, so a load that broke off is simply run again; the
stored rows outlive a lost executor between reading and writing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.ranking import first_per
from dossier.session import cut
from dossier.sources.writers import dealt

BUCKETS = 64


@dataclass(frozen=True)
class KeyedTable:
    """Where a keyed table is, its key, columns and number of buckets."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.stored().drop("bucket")

    def _write(self, rows: DataFrame, mode: str) -> None:
        out = dealt(rows.withColumn("bucket", self.bucket()), "bucket", self.key).write.mode("overwrite")
        out.option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path)

    def upsert(self, updates: DataFrame, *order: Column | str) -> int:
        """Replace whole rows by key; the first update per key in the given order counts. Returns the number of buckets written.

        Only bucket numbers come to the driver, at most as many as there are. A null key is a
        key like any other. Updates without rows write nothing.
        """
        if not order:
            raise ValueError("name the order that tells which update of a key counts")
        last = cut(first_per(updates, self.key, *order).select(*self.schema.names))
        touched = [r[0] for r in last.select(self.bucket().alias("b")).distinct().collect()]
        if touched:
            same = F.col(self.key).eqNullSafe(F.col("_key"))
            base = self.stored().filter(F.col("bucket").isin(touched)).drop("bucket")
            kept = base.join(last.select(F.col(self.key).alias("_key")), same, "left_anti")
            self._write(kept.unionByName(last), "dynamic")  # `dealt` stores the merged rows before any folder is replaced
        return len(touched)


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
    """Write a table, whose keys are different, by buckets of its key."""
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    table = KeyedTable(df.sparkSession, path, key, plain, buckets)
    table._write(df, "static")
    return table
