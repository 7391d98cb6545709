"""Reading objects and journals, publishing index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import keys
from noteloom.operators import search
from noteloom.operators.index import Index, index_of, parse_documents
from noteloom.operators.journal import EVENT

TABLES = ["headings", "front", "tags", "links", "postings", "grams", "names"]


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder: key, etag (MD5 of the bytes), size, modified_ms, content_type, text (UTF-8, null for binaries)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    key = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), root, -1)
    kind = keys.content_type(key)
    return rows.select(
        F.xxhash64(key).alias("id"), key.alias("key"), F.md5("content").alias("etag"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"),
        kind.alias("content_type"), F.when(keys.is_text_content_type(kind), F.expr("try_validate_utf8(cast(content as string))")).alias("text"),
    )


def list_objects(objects: DataFrame, prefix: str = "", limit: int = 100) -> DataFrame:
    """Binaries too, newest first."""
    return objects.where(keys.has_prefix(F.col("key"), prefix)).select("key", "etag", "size", "modified_ms", keys.content_type(F.col("key")).alias("content_type")).orderBy(F.desc("modified_ms"), "key").limit(limit)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path)


def journal_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt anew where its files have fewer splits than the cluster has cores: one file of texts would be parsed by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def laid_out(name: str, rows: DataFrame, ways: int = 16) -> DataFrame:
    """Postings, grams and names in files by hash of the token, in order of token and document, so that a token reads few row groups. A token's documents are dealt to `ways` files at
    most, so a frequent one is no single task's. Documents are in order of id in each file."""
    if name == "documents":
        return rows.sortWithinPartitions("id")
    token = {"postings": "token", "grams": "token", "names": "gram"}.get(name)
    return rows if token is None else rows.repartition(F.xxhash64(token, F.pmod("document_id", F.lit(ways)))).sortWithinPartitions(token, "document_id")


def store(name: str, rows: DataFrame, path: str) -> None:
    """One index table. Documents carry a Bloom filter of their ids, so a question for few of them passes by the row groups without any."""
    out = laid_out(name, rows).write.mode("overwrite")
    if name == "documents":
        out = out.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    out.parquet(path)


def tokenized(parsed: DataFrame) -> DataFrame:
    """parsed notes with the tokens of their ranked columns, cut once for lengths and postings."""
    return parsed.withColumn("tokens", F.struct(*search.tokens_by_column().values()))


def index_tables(parsed: DataFrame, indexed_at: int | None = None) -> Index:
    """The index tables of stored parsed notes with tokens, all of them."""
    index = index_of(parsed, indexed_at)
    index.postings = search.postings_of(parsed.select(F.col("id").alias("document_id"), "tokens.*"))
    index.grams, index.names = search.grams_of(parsed), search.names_of(parsed)
    return index


def write_index(index: Index, path: str, revision: str) -> None:
    """Children first, documents last: a revision exists once its documents do, and readers go through them."""
    made = {"postings": search.build_postings, "grams": lambda x: search.grams_of(x.documents), "names": lambda x: search.names_of(x.documents)}
    for name in (*TABLES, "documents"):
        rows = getattr(index, name)
        store(name, made[name](index) if rows is None else rows, f"{path}/{name}/revision={revision}")


def publish(objects: DataFrame, path: str, revision: str, indexed_at: int | None = None) -> Index:
    """Parse the objects once, store every index table, and return the stored index."""
    spark, parsed = objects.sparkSession, f"{path}/parsed/revision={revision}"
    tokenized(parse_documents(objects).drop("text")).write.mode("overwrite").parquet(parsed)
    write_index(index_tables(spark.read.parquet(parsed), indexed_at), path, revision)
    return read_index(spark, path, revision)


def publish_graph(objects: DataFrame, path: str) -> Index:
    """What questions about links alone read, stored: id, key and modified_ms of notes, and their links. Nothing of the texts is stored."""
    parse_documents(objects).select("id", "key", "modified_ms", "links").write.option("compression", "zstd").parquet(path)
    notes = objects.sparkSession.read.parquet(path)
    return Index(notes.drop("links"), None, None, None, notes.select(F.col("id").alias("document_id"), F.explode("links").alias("to_key")))


def read_index(spark: SparkSession, path: str, revision: str, complete: bool = True) -> Index:
    """A published revision. complete: it was written to its end, so children need no look at whether their documents are there; else those of missing documents are left out."""
    documents = spark.read.parquet(f"{path}/documents/revision={revision}")
    rest = {n: spark.read.parquet(f"{path}/{n}/revision={revision}") for n in TABLES}
    if not complete:
        ids = documents.select(F.col("id").alias("document_id"))
        rest = {n: t.join(ids, "document_id", "left_semi") for n, t in rest.items()}
    return Index(documents, **rest)
