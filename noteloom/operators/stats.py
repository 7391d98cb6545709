"""Listings, folder statistics and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import keys

from .index import Index


def list_documents(index: Index, prefix: str = "", limit: int = 100) -> DataFrame:
    docs = index.documents.where(keys.has_prefix(F.col("key"), prefix))
    return docs.select("key", F.col("indexed_etag").alias("etag"), "modified_ms", "size", "content_type").orderBy("key").limit(limit)


def recent(index: Index, prefix: str = "", limit: int = 20) -> DataFrame:
    return index.documents.where(keys.has_prefix(F.col("key"), prefix)).select("key", "modified_ms", "size").orderBy(F.desc("modified_ms"), "key").limit(limit)


def folders(index: Index) -> DataFrame:
    return index.documents.groupBy(keys.top_folder(F.col("key")).alias("folder")).agg(F.count("*").alias("count"), F.max("modified_ms").alias("last_modified")).orderBy(F.desc("last_modified"), "folder")


def stats(index: Index) -> DataFrame:
    """One row over all notes; among equal sizes the first key is named."""
    large, small = F.min_by("key", F.struct((-F.col("size")).alias("s"), "key")), F.min_by("key", F.struct("size", "key"))
    return index.documents.agg(F.count("*").alias("count"), F.sum("size").alias("total_size"), F.min("modified_ms").alias("oldest"), F.max("modified_ms").alias("newest"), large.alias("largest"), small.alias("smallest"))


def _by_folder(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(keys.top_folder(F.col("key")).alias("folder")).agg(F.count("*").alias("count"), F.sum("size").alias("size"), F.max("modified_ms").alias("last_modified"))
    return out.orderBy(F.desc("count"), "folder")


def folder_stats(index: Index) -> DataFrame:
    return _by_folder(index.documents)


def object_stats(objects: DataFrame) -> DataFrame:
    """The same over the listing: binaries count, system keys don't."""
    return _by_folder(objects.where(~keys.is_system_key(F.col("key"))))


def folder_rollup(index: Index) -> DataFrame:
    """Every folder, with what lies in it and below. Depth varies, so this is an explode of ancestors, not a ROLLUP."""
    return index.documents.select(F.explode(keys.ancestors(F.col("key"))).alias("folder"), "modified_ms").groupBy("folder").agg(F.count("*").alias("count"), F.max("modified_ms").alias("last_modified"))


def folder_contents(index: Index, path: str, limit: int = 100) -> DataFrame:
    inside = index.documents.where(keys.has_prefix(F.col("key"), path.rstrip("/") + "/"))
    total = inside.agg(F.count("*").alias("count"), F.sum("size").alias("total_size"))
    return inside.select("key", "size", "modified_ms").orderBy(F.desc("modified_ms"), "key").limit(limit).join(total)


def complete_keys(index: Index, fragment: str, limit: int = 50) -> DataFrame:
    return index.documents.where(F.lower("key").contains(fragment.lower())).select("key").orderBy("key").limit(limit)


def complete_dates(index: Index, fragment: str = "", limit: int = 50) -> DataFrame:
    return index.documents.select(keys.date_from_key(F.col("key")).alias("date")).where(F.col("date").contains(fragment)).distinct().orderBy(F.desc("date")).limit(limit)


def complete_folders(index: Index, fragment: str = "", limit: int = 50) -> DataFrame:
    return folder_rollup(index).where(F.lower("folder").contains(fragment.lower())).select("folder").orderBy("folder").limit(limit)


def duplicate_content(index: Index) -> DataFrame:
    """Contents under several keys: a count and the first key. Copies aren't collected into one row."""
    return index.documents.groupBy("content_sha256").agg(F.count("*").alias("copies"), F.min("key").alias("first_key")).where("copies > 1")
