"""A vector table kept elsewhere: (id, content, embedding, metadata as JSON, created_at), here as Parquet that any store of files can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import of_dimension
from .readers import remote_topk

COLUMNS = "id long, content string, embedding array<float>, metadata string, created_at timestamp"


class RemoteTable:
    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path, dim

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int) -> "RemoteTable":
        """An empty table where there is none."""
        spark.createDataFrame([], COLUMNS).write.mode("ignore").parquet(path)
        return cls(spark, path, dim)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(self.path)

    def insert(self, rows: DataFrame) -> None:
        """Appends rows (content, embedding[, metadata]) in one commit; ids follow from the content, metadata defaults to {}."""
        metadata = F.coalesce("metadata", F.lit("{}")) if "metadata" in rows.columns else F.lit("{}")
        own = rows.select(F.xxhash64("content", metadata).alias("id"), "content", of_dimension(F.col("embedding").cast("array<float>"), self.dim).alias("embedding"), metadata.alias("metadata"), F.current_timestamp().alias("created_at"))
        own.write.mode("append").parquet(self.path)

    def insert_one(self, content: str, embedding: list[float], metadata: str = "{}") -> None:
        self.insert(self.spark.createDataFrame([(content, [float(x) for x in embedding], metadata)], "content string, embedding array<float>, metadata string"))

    def search(self, query: list[float], k: int = 5) -> DataFrame:
        if len(query) != self.dim:
            raise ValueError(f"the query has {len(query)} entries instead of {self.dim}")
        return remote_topk(self.rows(), query, k)

    def count(self) -> int:
        return self.rows().count()


def connect(spark: SparkSession, path: str, dim: int) -> RemoteTable | None:
    """The table, or None where it can't be read."""
    table = RemoteTable(spark, path, dim)
    try:
        table.count()
    except Exception:  # a missing table is no error of the caller's
        return None
    return table
