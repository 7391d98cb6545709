"""Importance resampling towards a target: hashed n-gram weights, and the highest scores by parallel sorting by regular sampling.

Two scans count features by bucket in the table and in the target; the gains of all buckets (a bounded array) weigh every document. The scored rows are
written as locally sorted runs. Regular samples of the runs give splitters, rows are exchanged by splitter and merge inside their segment, and the
segments' sizes, summed up, turn places inside a segment into exact ranks. Segments past the last drawn rank are never exchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written

BUCKETS, WORDS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text: bytes | None, buckets: int = BUCKETS, words: int = WORDS) -> tuple[int, np.ndarray]:
    """(number of words, the bucket of every run of 1 to `words` of them). A run's CRC goes on from that of the run one word shorter."""
    found = _WORD.findall((text or b"").lower())  # lower() of bytes changes A-Z alone
    runs = list(map(crc32, found))
    out = [np.array(runs, dtype=np.int64)]
    for k in range(1, words):
        runs = list(map(crc32, found[k:], [crc32(b" ", c) for c in runs[: len(found) - k]]))
        out.append(np.array(runs, dtype=np.int64))
    return len(found), np.concatenate(out) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """(bucket, n) over all rows of texts (text): a task counts in an array of its own, so at most `buckets` rows of each one are shuffled."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                total += np.bincount(feature_buckets(t.as_py(), buckets, words)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the table, both with one added."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.array([math.floor(1000 * math.log(((b + 1) * (s.sum() + n)) / ((a + 1) * (t.sum() + n)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A document's own draw from a Gumbel distribution, in thousandths: by the hash of its id alone, so no run or machine changes it."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _array_of(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most `buckets` rows."""
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs."""
    table = keyed(docs)
    wins = gains(_array_of(bucket_counts(table, buckets, words), buckets), _array_of(bucket_counts(target.select(F.coalesce(F.col("`text`"), F.lit("")).alias("text")), buckets, words), buckets))
    sent = docs.sparkSession.sparkContext.broadcast(wins)

    def run(batches):
        wins = sent.value
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for i, t in zip(ids, b.column("text").cast(pa.binary()), strict=True):
                n, own = feature_buckets(t.as_py(), buckets, words)
                weight = int(wins[own].sum()) // len(own) if len(own) else 0
                rows.append((i, n, len(own), weight, weight + noise(i, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


_ORDER = ["down", "id", "row"]


def _regular_samples(runs: DataFrame, each: int) -> list[np.ndarray]:
    """Of every locally sorted run, the rows at `each` to 2 * each regular places: their three columns, in order."""

    def run(batches):
        kept, n, step = [], 0, 1  # twice as many as asked for at most, thinned as the run goes on
        for b in batches:
            cols = [b.column(c).to_numpy() for c in _ORDER]
            at = np.arange((-n) % step, len(cols[0]), step)
            kept += list(zip(*(c[at].tolist() for c in cols), strict=True))
            n += len(cols[0])
            while len(kept) > 2 * each:
                kept, step = kept[::2], 2 * step
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], pa.int64()) for k in range(3)], _ORDER)

    found = runs.select(*_ORDER).mapInArrow(run, "down long, id long, row long").toArrow()  # 24 bytes each, at most 2 * most_runs ** 2
    cols = [found.column(c).to_numpy() for c in _ORDER]
    by = np.lexsort(cols[::-1])
    return [c[by] for c in cols]


def _segmented(runs: DataFrame, splitters: list[np.ndarray]) -> DataFrame:
    """Adds segment, the number of splitters at or before each row."""
    sent = runs.sparkSession.sparkContext.broadcast(splitters)
    names = runs.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)

    def run(batches):
        a, b, c = sent.value
        for x in batches:
            down, id_, row = (x.column(n).to_numpy() for n in _ORDER)
            lo, hi = np.searchsorted(a, down, "left"), np.searchsorted(a, down, "right")
            seg = lo.copy()
            for k in np.flatnonzero(lo < hi):  # splitters of the same score: the id and the row decide
                p, q = lo[k], hi[k]
                p2, q2 = p + np.searchsorted(b[p:q], id_[k], "left"), p + np.searchsorted(b[p:q], id_[k], "right")
                seg[k] = p2 + np.searchsorted(c[p2:q2], row[k], "right")
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(seg, pa.int32())], [*names, "segment"])

    return runs.mapInArrow(run, f"{fields}, segment int")


def ranked(rows: DataFrame, keep: int | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, most_runs: int = 1024) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight, score) with rank: 1, 2, 3... of the drawn, by score, then doc_id; null of the others.

    keep: how many are drawn; percent of the rows with least_words words if it isn't given. Splitters are read from at most most_runs runs with twice as many
    samples each, whatever the size of the table, and cut it into at most most_runs segments.
    """
    spark = rows.sparkSession
    runs = min(most_runs, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    fit = F.col("n_words") >= least_words
    table = written(rows.withColumn("down", -F.col("score")).withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1))), "scored")
    fit_rows = table.where(fit)
    if keep is None:
        keep = percent * fit_rows.count() // 100
    sorted_runs = fit_rows.coalesce(runs).sortWithinPartitions(*_ORDER)
    samples = _regular_samples(sorted_runs, runs)
    at = np.arange(1, runs) * len(samples[0]) // runs if len(samples[0]) else np.zeros(0, np.int64)
    splitters = [c[at] for c in samples]
    cut = written(_segmented(sorted_runs.select("doc_id", "n_words", "n_features", "weight", "score", *_ORDER), splitters), "segments")
    sizes = {r.segment: r["count"] for r in cut.groupBy("segment").count().collect()}  # at most most_runs
    before, total = {}, 0
    for s in sorted(sizes):
        before[s], total = total, total + sizes[s]
    asked = [s for s in before if before[s] < keep]
    own = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    past = max(asked, default=-1)
    base = F.element_at(F.create_map(*[F.lit(x).cast(t) for s in asked for x, t in ((s, "int"), (before[s], "long"))]), F.col("segment")) if asked else F.lit(0).cast("long")
    place = base + F.row_number().over(Window.partitionBy("segment").orderBy(*_ORDER))
    drawn = cut.where(F.col("segment") <= past).withColumn("rank", place).select(*own, F.when(F.col("rank") <= keep, F.col("rank")).alias("rank"))
    return drawn.unionByName(cut.where(F.col("segment") > past).select(*own, none)).unionByName(table.where(~fit).select(*own, none))


def resample(docs: DataFrame, target: DataFrame, keep: int | None = None, buckets: int = BUCKETS, words: int = WORDS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs: which of them resemble the target's texts, drawn without replacement.

    Null and empty texts have no features and the weight 0; a table with an empty target still has its gains (each bucket's count is one more than it is). A null
    doc_id has the hash of an empty one and comes last among equal scores. Rows alike are drawn each for itself, in any order among each other; an empty
    table gives an empty one. Very long texts are read whole; columns other than doc_id and text are never read.
    """
    return ranked(scored(docs, target, buckets, words, seed), keep, percent, least_words)
