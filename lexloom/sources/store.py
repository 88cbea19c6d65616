"""A table of points on Parquet: created once, written by source, deleted by source, scanned by payload."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.operators.retrieval import filtered


class PointStore:
    """Points partitioned by source, so that replacing or deleting a source touches its own partitions only."""

    def __init__(self, spark: SparkSession, path: str, by: str = "source") -> None:
        self.spark, self.path, self.by = spark, path, by

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def ensure(self, schema: StructType) -> None:
        """Create the table where there is none; another vector or payload type than before is refused."""
        if not self.exists():
            self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/_schema")
            return
        have = {f.name: f.dataType for f in self.schema()}
        for f in schema:
            if f.name in have and have[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/_schema").first()[0]))

    def upsert(self, points: DataFrame) -> None:
        """Replace the points of every source that is written; ids are stable, so writing twice changes nothing."""
        rows = points.withColumn("point_id", F.sha2(F.concat_ws("\x1f", self.by, F.col("section").cast("string"), F.col("chunk_index").cast("string")), 256))
        # in order of what is filtered by, so that the ranges in the files' footers skip row groups
        near = [c for c in ("act_year", "act_name", "section", "chunk_index") if c in rows.columns]
        rows.repartition(self.by).sortWithinPartitions(self.by, *near).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)

    def _files(self, source: str | None = None):
        jvm = self.spark.sparkContext._jvm
        name = self.path if source is None else f"{self.path}/{self.by}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)}"
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def delete_source(self, source: str) -> None:
        path, fs = self._files(source)
        fs.delete(path, True)

    def truncate(self) -> None:
        schema = self.schema()
        path, fs = self._files()
        fs.delete(path, True)
        self.ensure(schema)

    def points(self) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(self.path)

    def scan(self, filters: dict | None = None, limit: int | None = None) -> DataFrame:
        """Points by payload alone, in order of id where they are limited."""
        rows, _ = filtered(self.points(), filters)
        return rows if limit is None else rows.orderBy("point_id").limit(limit)

    def info(self) -> DataFrame:
        """One row: name, number of points, status."""
        return self.points().agg(F.count("*").alias("points_count")).select(F.lit(self.path.rsplit("/", 1)[-1]).alias("name"), "points_count", F.lit("green").alias("status"))
