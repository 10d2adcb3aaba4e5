"""Keys of contents processed by earlier runs, as a table with one folder for each run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SeenTable:
    """Adding a run again replaces its folder, so a repeated run neither loses nor doubles keys."""

    def __init__(self, spark: SparkSession, path: str, key: str = "blob"):
        self.spark, self.path, self.key = spark, path, key

    def read(self, besides: int | None = None) -> DataFrame | None:
        """Keys of all runs, or of all but one; None before the first run."""
        try:
            df = self.spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return (df if besides is None else df.where(F.col("batch") != besides)).select(self.key)

    def unseen(self, df: DataFrame, besides: int | None = None) -> DataFrame:
        """Rows of df whose key no run has added."""
        known = self.read(besides)
        return df if known is None else df.join(known, self.key, "left_anti")

    def add(self, df: DataFrame, run: int) -> None:
        """To be called after the run's own results are committed."""
        df.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.path}/batch={run}")
