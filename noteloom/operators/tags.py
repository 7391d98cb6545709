"""Questions about tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import keys

from .index import Index


def _under(index: Index, prefix: str, *columns: str) -> DataFrame:
    docs = index.documents.where(keys.has_prefix(F.col("key"), prefix))
    return docs.select(F.col("id").alias("document_id"), *columns)


def tag_list(index: Index, sources: list[str] | None = None, prefix: str = "", contains: str = "", min_references: int = 1, limit: int = 100) -> DataFrame:
    """References and documents of each tag, split by source, in order of the tag.

    (document, tag, source) is unique, so a tag's documents are counted as two-level sums, without a distinct.
    """
    rows = index.tags
    if sources:
        rows = rows.where(F.col("source").isin(sources))
    if contains:
        rows = rows.where(keys.contains(F.col("tag"), contains))
    if prefix:
        rows = rows.join(_under(index, prefix), "document_id", "left_semi")
    by = lambda s: F.sum(F.when(F.col("source") == s, F.col("occurrences")).otherwise(0))
    once = rows.groupBy("tag", "document_id").agg(F.sum("occurrences").alias("n"), by("frontmatter").alias("f"), by("body").alias("b"))
    out = once.groupBy("tag").agg(F.sum("n").alias("reference_count"), F.count("*").alias("document_count"), F.sum("f").alias("frontmatter_count"), F.sum("b").alias("body_count"))
    return out.where(F.col("reference_count") >= min_references).orderBy("tag").limit(limit)


def tag_documents(index: Index, tag: str, match: str = "exact", sources: list[str] | None = None, prefix: str = "", limit: int = 100) -> DataFrame:
    """Documents with the tag, or with one below it (match='descendants'), newest first."""
    is_it = F.col("tag") == tag
    rows = index.tags.where(is_it | keys.has_prefix(F.col("tag"), tag + "/") if match == "descendants" else is_it)
    if sources:
        rows = rows.where(F.col("source").isin(sources))
    by = lambda s: F.sum(F.when(F.col("source") == s, F.col("occurrences")).otherwise(0))
    counted = rows.groupBy("document_id").agg(by("frontmatter").alias("frontmatter_count"), by("body").alias("body_count"))
    return counted.join(_under(index, prefix, "key", "modified_ms"), "document_id").select("key", "modified_ms", "frontmatter_count", "body_count").orderBy(F.desc("modified_ms"), "key").limit(limit)


def tag_suggest(index: Index, tag: str, limit: int = 10) -> DataFrame:
    """Of all tags, those that contain the given one or are contained in it, and whether it exists itself."""
    known = index.tags.select("tag").distinct()
    exists = index.tags.where(F.col("tag") == tag).limit(1).select(F.lit(True).alias("tag_exists"))
    near = known.where((F.col("tag") != tag) & (keys.contains(F.col("tag"), tag) | keys.ascii_fold(F.lit(tag)).contains(keys.ascii_fold(F.col("tag")))))
    return near.select("tag").orderBy("tag").limit(limit).join(exists, how="left").select("tag", F.coalesce("tag_exists", F.lit(False)).alias("tag_exists"))


def tag_suggestions(index: Index, limit: int = 10) -> DataFrame:
    """(tag, suggested): for every tag the first `limit` of all tags that contain it or are contained in it, whatever the case of A-Z.

    A tag is looked for among those that hold its rarest piece of three characters (one of fewer is its own piece), and compared there.
    """
    low, piece = keys.ascii_fold(F.col("tag")), lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - (n - 1)), lambda k: F.substring("low", k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    held = index.tags.select("tag").distinct().withColumn("low", low).withColumn("piece", F.explode(F.array_distinct(F.concat(piece(1), piece(2), piece(3)))))
    own = held.where(F.length("piece") == F.least(F.length("low"), F.lit(3)))
    counted = own.join(held.groupBy("piece").agg(F.count("*").alias("n")), "piece")
    rarest = counted.groupBy(F.col("tag").alias("part"), F.col("low").alias("part_low")).agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    pairs = held.join(rarest, "piece").where((F.col("tag") != F.col("part")) & F.col("low").contains(F.col("part_low"))).select("tag", "part", (F.col("low") == F.col("part_low")).alias("same"))
    both = pairs.select("tag", F.col("part").alias("suggested")).unionByName(pairs.where(~F.col("same")).select(F.col("part").alias("tag"), F.col("tag").alias("suggested")))
    first = F.row_number().over(Window.partitionBy("tag").orderBy("suggested"))
    return both.withColumn("__k", first).where(F.col("__k") <= limit).drop("__k")


def complete_tags(index: Index, fragment: str, limit: int = 50) -> DataFrame:
    return tag_list(index, contains=fragment, limit=limit).select("tag")
