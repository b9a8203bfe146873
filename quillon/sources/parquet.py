"""External Parquet tables, read only: scans stay lazy, so filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class ParquetTables:
    """The tables {directory}/{name}.parquet, looked up when first named."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")
        self._found: dict[str, DataFrame | None] = {}

    def get(self, name: str) -> DataFrame | None:
        if name not in self._found:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}.parquet")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            self._found[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet") if there else None
        return self._found[name]
