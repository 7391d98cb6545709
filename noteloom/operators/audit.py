"""Listing against index: what is fresh, missing, stale, gone. Texts never travel through these joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import keys

from .index import INDEX_VERSION

SYSTEM_SOURCE = "system"


def _sides(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """objects: (key, etag); documents: (key, indexed_etag, index_version, indexed_at). Notes only, joined on key."""
    o = objects.where(keys.is_indexable(F.col("key"))).select("key", F.col("etag"), F.lit(True).alias("listed"))
    d = documents.select("key", "indexed_etag", "index_version", "indexed_at", F.lit(True).alias("indexed"))
    return o.join(d, "key", "full_outer")


def freshness_report(objects: DataFrame, documents: DataFrame, version: int = INDEX_VERSION) -> DataFrame:
    """(key, state): missing from the index, absent from the store, stale etag, outdated version, or fresh."""
    state = F.when(F.col("indexed").isNull(), "missing").when(F.col("listed").isNull(), "absent").when(~F.col("etag").eqNullSafe(F.col("indexed_etag")), "stale").when(F.col("index_version") != version, "outdated").otherwise("fresh")
    return _sides(objects, documents).select("key", state.alias("state"))


def audit_diff(objects: DataFrame, documents: DataFrame, started_at: int, include_outdated: bool = False, version: int = INDEX_VERSION) -> DataFrame:
    """(path, action, target_etag, source, not_before): upserts of notes whose etag differs, removals of keys that aren't listed.

    A key indexed after the audit began is no candidate for removal. The version counts only if include_outdated.
    """
    both = _sides(objects, documents)
    old = F.col("index_version") != version if include_outdated else F.lit(False)
    up = F.col("listed") & (F.col("indexed").isNull() | ~F.col("etag").eqNullSafe(F.col("indexed_etag")) | old)
    gone = F.col("listed").isNull() & (F.col("indexed_at") < started_at)
    action = F.when(up, "upsert").when(gone, "remove")
    rows = both.select(F.col("key").alias("path"), action.alias("action"), F.when(up, F.col("etag")).alias("target_etag"))
    return rows.where("action is not null").withColumn("source", F.lit(SYSTEM_SOURCE)).withColumn("not_before", F.lit(started_at).cast("long"))


def audit_report(objects: DataFrame, documents: DataFrame, started_at: int, page: int = 200, worked: DataFrame | None = None) -> DataFrame:
    """One row: pages and notes scanned, upserts and removals enqueued, and of these those applied and those left. worked: (path) of the intents worked since the audit began."""
    scanned = objects.agg(F.ceil(F.count("*") / page).alias("pages"), F.count_if(keys.is_indexable(F.col("key"))).alias("scanned"))
    queued, done = audit_diff(objects, documents, started_at), F.lit(False)
    if worked is not None:
        queued, done = queued.join(worked.select("path", F.lit(True).alias("__done")).distinct(), "path", "left"), F.coalesce("__done", F.lit(False))
    counts = [F.count_if(F.col("action") == "upsert").alias("enqueued"), F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(done).alias("applied"), F.count_if(~done).alias("pending")]
    return scanned.join(queued.agg(*counts))


def apply_index_intents(intents: DataFrame, objects: DataFrame, documents: DataFrame, version: int = INDEX_VERSION) -> DataFrame:
    """(path, outcome): what working an intent comes to after looking again: removed, noop or indexed.

    A removal of an object that is there re-indexes it. Parse only the rows that are indexed: join them with the objects.
    """
    o = objects.select(F.col("key").alias("path"), "etag", F.lit(True).alias("__there"))
    d = documents.select(F.col("key").alias("path"), "indexed_etag", "index_version", F.lit(True).alias("__known"))
    rows = intents.select("path", "action").join(o, "path", "left").join(d, "path", "left")
    lost = F.col("__there").isNull() | ~keys.is_indexable(F.col("path"))
    same = F.col("etag").eqNullSafe(F.col("indexed_etag")) & (F.col("index_version") == version)
    outcome = F.when(lost & F.col("__known").isNull(), "noop").when(lost, "removed").when(F.coalesce(same, F.lit(False)), "noop").otherwise("indexed")
    return rows.select("path", "action", outcome.alias("outcome"))
