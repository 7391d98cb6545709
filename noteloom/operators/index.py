"""Notes to index tables: one narrow pass over the objects, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import keys, text
from noteloom.functions.frontmatter import parse_frontmatter

INDEX_VERSION = 1


def parse_documents(objects: DataFrame) -> DataFrame:
    """objects (id, key, etag, size, modified_ms, text, ...) that are notes, with everything the index derives from a text.

    Adds content_sha256, title, front (JSON or null), body, headings, heading_text, links, tags, tag_text. Null texts count as
    empty. Only texts with a frontmatter block carry YAML to Python.
    """
    block, body = text.split_frontmatter(F.col("text"))
    cut = objects.where(keys.is_indexable(F.col("key"))).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__yaml", block).withColumn("body", body)
    cut = cut.withColumn("__front", parse_frontmatter(F.col("__yaml"))).withColumn("headings", text.extract_headings(F.col("body")))
    # Named first, so that the fold over distinct tags reads what was found and doesn't search the text for each of them.
    cut = cut.withColumn("__told", text.frontmatter_tags(F.coalesce("__front.tags", F.array().cast("array<string>")))).withColumn("__said", text.extract_body_tags(F.col("body")))
    tally = lambda values, source: F.transform(F.array_distinct(values), lambda t: F.struct(t.alias("tag"), F.lit(source).alias("source"), F.size(F.filter(values, lambda x: x == t)).cast("long").alias("occurrences")))
    declared, first = text.trim_ws(F.col("__front.title")), F.get(F.filter("headings", lambda h: h["level"] == 1), 0)["text"]
    return (
        cut.withColumn("content_sha256", F.sha2("text", 256))
        .withColumn("title", F.coalesce(F.when(declared != "", declared), first, keys.strip_extension(keys.basename(F.col("key")))))
        .withColumn("front", F.col("__front.json"))
        .withColumn("heading_text", F.array_join(F.transform("headings", lambda h: h["text"]), "\n"))
        .withColumn("links", text.extract_wikilinks(F.col("body")))
        .withColumn("tags", F.concat(tally(F.col("__told"), "frontmatter"), tally(F.col("__said"), "body")))
        .withColumn("tag_text", F.array_join(F.transform("tags", lambda t: t["tag"]), " "))
        .drop("__yaml", "__front", "__told", "__said")
    )


@dataclass
class Index:
    """The index tables of one state of the vault. Where they are stored: postings and grams (document_id, column, token, n, positions), names (document_id, gram, key, modified_ms)."""

    documents: DataFrame
    headings: DataFrame
    front: DataFrame
    tags: DataFrame
    links: DataFrame
    postings: DataFrame | None = None
    grams: DataFrame | None = None
    names: DataFrame | None = None


def build_index(objects: DataFrame, indexed_at: int | None = None) -> Index:
    """The index tables as views of one parse; publish() of sources.io stores them, for more than one question."""
    return index_of(parse_documents(objects), indexed_at)


def index_of(parsed: DataFrame, indexed_at: int | None = None) -> Index:
    """Child tables carry document_id and nothing of the text; documents folds the searched columns in. parsed may hold the tokens of the ranked columns (tokens), which then aren't cut again."""
    one = F.col("id").alias("document_id")
    columns = {"title": "title", "headings": "heading_text", "tags": "tag_text", "body": "body"}
    tokens = [F.col(f"tokens.{n}") if "tokens" in parsed.columns else text.tokenize(F.coalesce(c, F.lit(""))) for n, c in columns.items()]
    documents = parsed.select(
        "id", "key", F.col("etag").alias("indexed_etag"), "content_sha256", "title", keys.content_type(F.col("key")).alias("content_type"), "modified_ms", "size",
        F.lit(INDEX_VERSION).alias("index_version"), F.lit(indexed_at).cast("long").alias("indexed_at"), "body", "heading_text", "tag_text",
        sum(map(F.size, tokens), F.lit(0)).alias("length"),
    )
    headings = parsed.select(one, F.posexplode("headings").alias("ordinal", "h")).select("document_id", "ordinal", "h.level", "h.text", "h.line")
    front = parsed.select(one, F.explode(F.from_json("front", "map<string,string>")).alias("field", "value")).withColumn("value", F.coalesce("value", F.lit("null")))
    tags = parsed.select(one, F.explode("tags").alias("t")).select("document_id", "t.tag", "t.source", "t.occurrences")
    links = parsed.select(one, F.explode("links").alias("to_key"))
    return Index(documents, headings, front, tags, links)


def read_parsed(objects: DataFrame, key: str) -> DataFrame:
    """One note as its reader sees it: tags and links here come from the whole text, not from the body."""
    found = parse_documents(objects.where(F.col("key") == key))
    return found.select("key", "front", "body", F.array_distinct(text.extract_body_tags(F.col("text"))).alias("tags"), text.extract_wikilinks(F.col("text")).alias("links"))


def heading_outline(index: Index, key: str) -> DataFrame:
    note = index.documents.where(F.col("key") == key).select(F.col("id").alias("document_id"))
    return index.headings.join(note, "document_id", "left_semi").select("ordinal", "level", "text", "line").orderBy("ordinal")


def search_frontmatter(index: Index, field: str, value: str | None = None, contains: str | None = None, prefix: str = "", limit: int = 100) -> DataFrame:
    """Notes whose field equals the value and contains the part, newest first."""
    rows = index.front.where(F.col("field") == field)
    if value is not None:
        rows = rows.where(F.col("value") == value)
    if contains is not None:
        rows = rows.where(keys.contains(F.col("value"), contains))
    docs = index.documents.where(keys.has_prefix(F.col("key"), prefix)).select(F.col("id").alias("document_id"), "key", "modified_ms")
    return rows.join(docs, "document_id").select("key", "value", "modified_ms").orderBy(F.desc("modified_ms"), "key").limit(limit)


def index_freshness(index: Index, version: int = INDEX_VERSION) -> DataFrame:
    """One row: documents, those of another version, whether some or all are current, and when the newest was indexed."""
    stale = F.count_if(F.col("index_version") != version)
    return index.documents.agg(F.count("*").alias("documents"), stale.alias("stale"), ((stale > 0) & (stale < F.count("*"))).alias("partial"), ((F.count("*") > 0) & (stale == 0)).alias("ready"), F.max("indexed_at").alias("indexed_at"))
