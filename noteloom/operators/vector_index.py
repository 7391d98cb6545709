"""Nearest vectors from inverted lists: trained centroids, residual codes with their errors, bounds that end a search exactly, full vectors for the last ranking.

Every distinct vector lies in the list of its nearest centroid as one byte a dimension of what it differs from that centroid by, beside the length of what the code
leaves out (err). So a code tells a product with a query up to err, and a centroid's distance to its farthest member tells what a whole list can hold at most. A
search looks at the few lists nearest to each query; the exact one then looks at every other list that may hold something as near as the k-th found. Queries go to
the lists they ask, so no vector is copied to all queries; candidates that the bounds leave are ranked by their full vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.sources.shared import stored

SLACK = 1e-6  # products of single bytes and floats are off by less


@dataclass
class VectorIndex:
    """lists: (list, block, key, code, scale, err); first_keys: (node, key) of equal vectors, at most `most` each; vectors: (key, embedding) of the nodes, in full."""

    key: str
    centers: np.ndarray
    far: np.ndarray
    blocks: np.ndarray
    lists: DataFrame
    first_keys: DataFrame
    vectors: DataFrame
    most: int


def units(rows: list) -> np.ndarray:
    """Rows of length 1; zero vectors stay zero."""
    x = np.array(rows, dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x, 0) / np.maximum(n, 1e-300)


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a column of arrays of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return units(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def trained(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors by k-means, from distinct ones of the sample."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = _nearest(sample, centers)
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        size = np.bincount(own, minlength=len(centers))
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ centers.T - half, axis=1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def coded(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, distance to its centroid, code, scale, err) of each row."""
    own = _nearest(x, centers)
    rest = x - centers[own]
    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12).astype(np.float32) / np.float32(127)
    code = np.clip(np.rint(rest / scale[:, None]), -127, 127).astype(np.int8)
    err = np.linalg.norm(rest - code * scale[:, None].astype(np.float64), axis=1)
    return own, np.linalg.norm(rest, axis=1), code, scale, err


def build_vector_index(vectors: DataFrame, key: str = "chunk_id", lists: int | None = None, fit_rows: int = 20_000, part: int = 16_384, most: int = 64) -> VectorIndex:
    """Index vectors (key, embedding), all of one width. The centroids are fitted on about fit_rows of them, drawn by hash; every vector is indexed.

    lists: the root of the number of vectors if not given, 4,096 at most. A list of over `part` vectors lies in several blocks. Equal vectors are one row of the
    lists; the first `most` keys of each are what searches for up to `most` results can name.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    n = vectors.count()
    lists = lists or max(1, min(4096, round(n**0.5)))
    share = min(1.0, fit_rows / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").toArrow().column("embedding").combine_chunks()
    centers = trained(_vectors(drawn), lists) if len(drawn) else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centers)

    def place(batches):
        for b in batches:
            x = _vectors(b.column("embedding"))
            own, far, code, scale, err = coded(x, sent.value)
            raw = pa.array([r.tobytes() for r in code], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h1"), b.column("h2"), pa.array(own.astype(np.int32)), pa.array(far), raw, pa.array(scale), pa.array(err)], ["key", "h1", "h2", "list", "far", "code", "scale", "err"])

    same = vectors.select(F.col(key).alias("key"), "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    if not len(centers):
        same = same.limit(0)
    rows = stored(same.mapInArrow(place, f"key {kind}, h1 long, h2 long, list int, far double, code binary, scale float, err double"), "vector-codes")
    nodes = stored(rows.groupBy("h1", "h2").agg(F.min("key").alias("node")), "vector-nodes")
    # In two steps, so that no group of equal vectors meets in one task.
    parted = rows.select("h1", "h2", "key").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    for by in (["h1", "h2", "part"], ["h1", "h2"]):
        parted = parted.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("place") <= most).drop("place")
    first_keys = stored(parted.join(nodes, ["h1", "h2"]).select("node", "key"), "vector-keys")
    single = rows.join(nodes.select(F.col("node").alias("key")), "key", "left_semi")
    about = {r.list: r for r in single.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a list
    far = np.array([about[k].far if k in about else 0.0 for k in range(len(centers))])
    blocks = np.array([-(-about[k].n // part) if k in about else 0 for k in range(len(centers))], dtype=np.int64)
    many = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks]), F.col("list") + 1) if len(blocks) else F.lit(1)
    told = stored(single.select("list", F.pmod(F.xxhash64("key"), many).cast("int").alias("block"), "key", "code", "scale", "err"), "vector-lists")
    full = stored(vectors.select(F.col(key).alias("key"), "embedding").join(nodes.select(F.col("node").alias("key")), "key", "left_semi"), "vector-full")
    return VectorIndex(key, centers, far, blocks, told, first_keys, full, most)


def _asked(queries: DataFrame, index: VectorIndex, probes: int, rest: bool) -> DataFrame:
    """(query_id, unit, list, block): the blocks of each query's nearest lists; rest: of all other lists that may hold a product of `reach` or more."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centers, index.far, index.blocks))

    def run(batches):
        centers, far, blocks = sent.value
        if not len(centers):
            return
        norms = (centers**2).sum(axis=1)
        for b in batches:
            x = _vectors(b.column("unit"))
            ids, units_, lists_, blocks_ = [], [], [], []
            for at in range(0, len(x), 256):
                product = x[at : at + 256] @ centers.T
                away = np.sqrt(np.maximum(1 + norms - 2 * product, 0))
                order = np.argsort(away, axis=1, kind="stable")
                for k, own in enumerate(order):
                    chosen = own[:probes]
                    if rest:
                        near = np.maximum(away[k] - far, 0)  # of a unit vector; a zero vector's product is 0
                        bound = np.maximum(1 - near**2 / 2, np.where(np.sqrt(norms) <= far + SLACK, 0, -2))
                        chosen = own[probes:][bound[own[probes:]] >= b.column("reach")[at + k].as_py() - SLACK]
                    for c in chosen.tolist():
                        for block in range(int(blocks[c])):
                            ids.append(b.column("query_id")[at + k].as_py())
                            units_.append(x[at + k])
                            lists_.append(c)
                            blocks_.append(block)
            flat = np.array(units_).reshape(-1) if units_ else np.zeros(0)
            width = x.shape[1] if len(x) else 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(flat, pa.float64())), pa.array(lists_, pa.int32()), pa.array(blocks_, pa.int32())], ["query_id", "unit", "list", "block"])

    return queries.mapInArrow(run, "query_id long, unit array<double>, list int, block int")


def _candidates(asked: DataFrame, index: VectorIndex, k: int, ways: int = 512) -> DataFrame:
    """(query_id, key, low, high) of what may be among a query's k nearest of a block: bounds of its product. Some `ways` queries meet a block at a time."""
    kind, centers = index.lists.schema["key"].dataType.simpleString(), index.centers
    sent = asked.sparkSession.sparkContext.broadcast(centers)
    asked = stored(asked, "vector-asked")
    crowd = asked.groupBy("list", "block").agg(F.ceil(F.count("*") / ways).cast("int").alias("crowd"))  # a row a block
    left = asked.join(crowd, ["list", "block"]).withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowd")).cast("int"))
    right = index.lists.join(crowd, ["list", "block"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1)))

    def near(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "key": [], "low": [], "high": []})
        code = np.frombuffer(b"".join(v["code"]), dtype=np.int8).reshape(len(v), -1)
        x = sent.value[int(v["list"].iloc[0])] + code * v["scale"].to_numpy(dtype=np.float64)[:, None]
        product, err = np.stack(q["unit"].to_list()) @ x.T, v["err"].to_numpy()
        low, high = product - err, product + err
        reach = -np.partition(-low, k - 1, axis=1)[:, k - 1] if len(v) > k else np.full(len(q), -2.0)
        a, b = np.nonzero(high >= reach[:, None] - SLACK)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[a], "key": v["key"].to_numpy()[b], "low": low[a, b], "high": high[a, b]})

    by = ["list", "block", "crowd"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, f"query_id long, key {kind}, low double, high double")


def _reach(found: DataFrame, k: int) -> DataFrame:
    """(query_id, reach): the k-th highest lower bound so far, or less than any product if there are fewer."""
    return found.groupBy("query_id").agg(F.coalesce(F.get(F.sort_array(F.collect_list("low"), asc=False), k - 1), F.lit(-2.0)).alias("reach"))


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the k nearest by cosine of each query (query_id, embedding), equal scores by key.

    exact: all of them, whatever the lists; else what the `probes` nearest lists hold. Zero vectors have the score 0 with all; a zero query has the first keys.
    """
    if k > index.most:
        raise ValueError(f"the index names {index.most} results at most")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("unit"))
    zero: Column = F.forall("unit", lambda x: x == 0)
    lively = asked.where(~zero)
    found = stored(_candidates(_asked(lively, index, probes, False), index, k), "vector-found")
    if exact:
        reach = lively.join(_reach(found, k), "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(-2.0)))
        found = found.unionByName(stored(_candidates(_asked(reach, index, probes, True), index, k), "vector-more"))
    left = found.join(_reach(found, k), "query_id").where(F.col("high") >= F.col("reach") - SLACK).select("query_id", "key")

    def ranked(batches):
        for b in batches:
            score = np.round((_vectors(b.column("unit")) * _vectors(b.column("embedding"))).sum(axis=1), 9) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("key"), pa.array(score)], ["query_id", "key", "score"])

    kind = index.lists.schema["key"].dataType.simpleString()
    scores = left.join(index.vectors, "key").join(lively, "query_id").mapInArrow(ranked, f"query_id long, key {kind}, score double")
    named = scores.withColumnRenamed("key", "node").join(index.first_keys, "node").select("query_id", "key", "score")
    few = index.first_keys.select("key").orderBy("key").limit(k)  # k rows
    named = named.unionByName(asked.where(zero).select("query_id").join(F.broadcast(few)).select("query_id", "key", F.lit(0.0).alias("score")))
    best = named.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("key").alias("k")))), 1, k).alias("h"))
    return best.select("query_id", F.posexplode("h").alias("rank", "h")).select("query_id", F.col("h.k").alias(index.key), (-F.col("h.s")).alias("score"), (F.col("rank") + 1).alias("rank"))
