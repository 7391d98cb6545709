"""The index in segments: a batch of changed notes adds tables of its own beside those that are there, and nothing unchanged is read or written.

A segment is one partition (segment=n) of every index table, and of `gone`, the ids whose rows in earlier segments no longer hold. Segments are never
changed. A row of `commits` makes one visible: (id, first, upto, tier), the publishes it covers. Questions read the visible segments without the rows that a
later one has replaced. Segments of like size at the end are merged into one, so their number grows with the logarithm of the notes published.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.index import Index, parse_documents

from .io import TABLES, index_tables, store, tokenized
from .shared import delete, exists

OBJECT = "id long, key string, etag string, size long, modified_ms long, text string"
GONE, COMMIT = "document_id long", "id long, first long, upto long, tier int, notes long"


@dataclass(frozen=True)
class Segment:
    id: int
    first: int
    upto: int
    tier: int
    notes: int


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/commits") if exists(spark, f"{path}/commits") else spark.createDataFrame([], COMMIT)


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """The visible segments in order. One row a publish or merge is read, whatever the notes."""
    rows = [Segment(*r) for r in _commits(spark, path).collect()]
    covered = lambda a: any(b.id > a.id and b.first <= a.first and a.upto <= b.upto for b in rows)
    return sorted((a for a in rows if not covered(a)), key=lambda a: a.upto)


def _schemas(spark: SparkSession) -> dict[str, str]:
    empty = index_tables(tokenized(parse_documents(spark.createDataFrame([], OBJECT)).drop("text")))
    return {n: getattr(empty, n).schema for n in (*TABLES, "documents")} | {"gone": GONE}


def _rows(spark: SparkSession, path: str, name: str, schema, of: list[Segment]) -> DataFrame:
    """Rows of some segments with upto, the last publish each one's segment covers."""
    out = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/segment={s.id}" for s in of])
    upto = F.element_at(F.create_map(*[F.lit(x).cast("long") for s in of for x in (s.id, s.upto)]), F.col("segment").cast("long"))
    return out.withColumn("upto", upto).drop("segment")


def _alive(spark: SparkSession, path: str, of: list[Segment], later: list[Segment]) -> dict[str, DataFrame]:
    """The index tables of some segments, without what those or later ones have replaced."""
    schemas = _schemas(spark)
    out = {n: _rows(spark, path, n, schemas[n], of) for n in (*TABLES, "documents")}
    since = [s for s in (*of, *later) if s.upto > of[0].upto]
    if since:
        gone = _rows(spark, path, "gone", GONE, since).groupBy("document_id").agg(F.max("upto").alias("__gone")).withColumnRenamed("document_id", "__id")
        key = lambda n: "id" if n == "documents" else "document_id"
        out = {n: t.join(gone, (F.col(key(n)) == F.col("__id")) & (F.col("upto") < F.col("__gone")), "left_anti") for n, t in out.items()}
    return {n: t.drop("upto") for n, t in out.items()}


def _write(spark: SparkSession, path: str, tables: dict[str, DataFrame], gone: DataFrame, id_: int, first: int, upto: int, fanout: int) -> Segment:
    """Tables first, the commit last: what broke off before it is written over by the next publish of that number."""
    for name, rows in ({n: tables[n] for n in TABLES} | {"gone": gone, "documents": tables["documents"]}).items():
        store(name, rows, f"{path}/{name}/segment={id_}")
    notes = spark.read.schema("id long").parquet(f"{path}/documents/segment={id_}").count()
    made = Segment(id_, first, upto, int(math.log(max(1, notes), fanout) + 1e-9), notes)
    spark.createDataFrame([(made.id, made.first, made.upto, made.tier, made.notes)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={id_}")
    return made


def _next(spark: SparkSession, path: str) -> int:
    return _commits(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def publish_changes(changed: DataFrame, path: str, removed: DataFrame | None = None, indexed_at: int | None = None, fanout: int = 4) -> Segment:
    """Add a segment: changed holds the present objects of notes that are new or changed, removed (id) those that are gone. Only these are parsed and written.

    A changed object that is no note any more leaves the index too. An id in both counts as changed. The first publish is the whole vault.
    """
    spark = changed.sparkSession
    now, id_ = segments(spark, path), _next(spark, path)
    upto = now[-1].upto + 1 if now else 1
    parsed = f"{path}/parsed/segment={id_}"
    tokenized(parse_documents(changed).drop("text")).write.mode("overwrite").parquet(parsed)
    x = index_tables(spark.read.parquet(parsed), indexed_at)
    gone = changed.select(F.col("id").cast("long").alias("document_id"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col("id").cast("long").alias("document_id"))).distinct()
    return _write(spark, path, {n: getattr(x, n) for n in (*TABLES, "documents")}, gone, id_, upto, upto, fanout)


def read_segments(spark: SparkSession, path: str) -> Index:
    """The index as all publishes so far leave it."""
    now = segments(spark, path)
    if not now:
        raise ValueError("nothing is published there")
    return Index(**_alive(spark, path, now, []))


def mergeable(now: list[Segment], fanout: int = 4) -> list[Segment]:
    """The run of newest segments to merge: fanout or more of one tier or lower at the end, of the lowest tier that has so many; none if one of them is far larger than all others together."""
    for tier in sorted({s.tier for s in now}):
        run: list[Segment] = []
        for s in reversed(now):
            if s.tier > tier:
                break
            run.insert(0, s)
        sizes = sorted(fanout**s.tier for s in run)
        if len(run) >= fanout and sizes[-1] <= fanout * sum(sizes[:-1]):
            return run
    return []


def merge_segments(spark: SparkSession, path: str, fanout: int = 4) -> Segment | None:
    """Write the newest segments of like size as one, without what is replaced; older ones aren't read. None if there is nothing to merge."""
    now = segments(spark, path)
    run = mergeable(now, fanout)
    if not run:
        return None
    tables = _alive(spark, path, run, [])
    older = [s for s in now if s.upto < run[0].first]
    gone = _rows(spark, path, "gone", GONE, run).select("document_id").distinct()
    return _write(spark, path, tables, gone if older else gone.limit(0), _next(spark, path), run[0].first, run[-1].upto, fanout)


def drop_merged(spark: SparkSession, path: str) -> list[int]:
    """Delete the segments that a merge has replaced, once no question that began before it is still running."""
    keep = {s.id for s in segments(spark, path)}
    ids = [r[0] for r in _commits(spark, path).select("id").orderBy("id").collect() if r[0] not in keep]
    for k in ids:
        delete(spark, f"{path}/commits/commit={k}")
        for name in (*TABLES, "documents", "gone", "parsed"):
            delete(spark, f"{path}/{name}/segment={k}")
    return ids


def segment_rows(spark: SparkSession, path: str) -> DataFrame:
    """(publishes, document_id) of every row that the visible segments hold, replaced ones too: what each publish or merge has written."""
    now = segments(spark, path)
    rows = _rows(spark, path, "documents", "id long", now)
    label = F.element_at(F.create_map(*[F.lit(x) for s in now for x in (s.upto, f"{s.first}-{s.upto}")]), F.col("upto").cast("int"))
    return rows.select(label.alias("publishes"), F.col("id").alias("document_id"))
