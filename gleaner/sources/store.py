"""A table that is read and replaced as a whole: versions in Parquet, the newest complete one counts.

One writer at a time: a version is written to a folder of its own number, and a second writer of the same number fails.
Files are reached through Hadoop's file systems, so the path may be in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], keep: int = 2):
        self.spark, self.path, self.schema, self.keys, self.keep = spark, path.rstrip("/"), schema, keys, keep

    def folder(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def files(self):
        return self.folder().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs = self.files()
        if not fs.exists(self.folder()):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(self.folder())]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self.folder(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, table: DataFrame) -> None:
        """The next version; older ones than the last few go."""
        found = self.versions()
        table.select(*self.read().columns).write.mode("error").parquet(f"{self.path}/v={found[-1] + 1 if found else 1}")
        for old in found[: len(found) + 1 - self.keep]:
            self.files().delete(self.folder(f"v={old}"), True)

    def upsert(self, new: DataFrame, order: str) -> None:
        """Rows of ``new`` replace those with their keys; of several the one with the highest ``order`` counts."""
        now = self.read()
        rows = [df.select(F.struct(*now.columns).alias("row"), F.lit(i).alias("turn")) for i, df in enumerate((now, new))]
        latest = Window.partitionBy(*(f"row.{k}" for k in self.keys)).orderBy(F.col("turn").desc(), F.col(f"row.{order}").desc())
        self.write(rows[0].union(rows[1]).withColumn("place", F.row_number().over(latest)).where("place = 1").select("row.*"))

    def remove(self, condition: str) -> None:
        self.write(self.read().where(f"NOT coalesce({condition}, false)"))

    def clear(self) -> None:
        self.write(self.read().limit(0))

    def size(self) -> int:
        return self.read().count()
