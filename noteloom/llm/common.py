"""Small shared helpers: the shared folder, written tables, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.sources.shared import drop as dropped
from noteloom.sources.shared import stored as written

__all__ = ["IDENTITY", "dropped", "identity", "keyed", "same_identity", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns, doc_id BIGINT and text STRING with null as empty, whatever else the table carries."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


IDENTITY = ["doc_id", "k1", "k2"]


def identity(docs: DataFrame) -> list[Column]:
    """What tells one document from another: its id and 128 bits of its text. Rows alike in both count as one document."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def same_identity(prefix: str) -> Column:
    """Equality of IDENTITY and of the columns so named with the prefix; null ids are equal."""
    return F.col("doc_id").eqNullSafe(F.col(f"{prefix}doc_id")) & (F.col("k1") == F.col(f"{prefix}k1")) & (F.col("k2") == F.col(f"{prefix}k2"))
