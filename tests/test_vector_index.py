"""Inverted lists: exact search equals brute force whatever the data, bounds hold, clustered data visit few lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.operators import vector_index as V


def table(spark, x):
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def brute(x, queries, k):
    f = V.units(x.astype(np.float32).tolist())
    out = set()
    for q in queries:
        s = np.round((f[q] * f).sum(axis=1), 9)
        out |= {(q, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(len(x)), -s))[:k])}
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_exact_search(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(14, 12)), 50, axis=0) + 0.02 * x
    if kind == "copies":
        x[100:500] = x[99]
        x[7] = x[301] = 0
    v = table(spark, np.round(x, 4))
    index = V.build_vector_index(v, "vec_id", part=40)
    asked = v.where("vec_id % 20 = 0 or vec_id in (7, 99)").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in V.nearest(index, asked, 9, probes=2).collect()}
    assert got == brute(np.round(x, 4), sorted({*range(0, 700, 20), 7, 99}), 9)
    some = {(r.query_id, r.vec_id) for r in V.nearest(index, asked, 9, probes=6, exact=False).collect()}
    recall = len(some & {(q, i) for q, i, _ in got}) / len(got)
    assert recall > (0.95 if kind == "clusters" else 0.4)
    if kind == "copies":  # equal vectors are one row of the lists, and name the first keys only
        assert index.lists.count() == 700 - 399 - 1 and index.first_keys.groupBy("node").count().agg(F.max("count")).first()[0] == 64
    if kind == "clusters":  # bounds leave most lists unseen
        reach = asked.withColumnRenamed("embedding", "unit").select("query_id", F.col("unit").cast("array<double>").alias("unit"), F.lit(0.97).alias("reach"))
        assert V._asked(reach, index, 2, True).count() < 0.3 * asked.count() * int(index.blocks.sum())


def test_codes_tell_how_wrong_they_are():
    rng = np.random.default_rng(0)
    x = V.units(rng.normal(size=(200, 16)).tolist() + [[0.0] * 16])
    centers = V.trained(x, 9)
    own, far, code, scale, err = V.coded(x, centers)
    back = centers[own] + code * scale[:, None].astype(np.float64)
    assert np.allclose(np.linalg.norm(x - back, axis=1), err) and np.allclose(np.linalg.norm(x - centers[own], axis=1), far) and err.max() < 0.05
    assert (np.abs(x @ x.T - x @ back.T) <= err[None, :] + 1e-12).all()


def test_few_vectors(spark):
    v = table(spark, np.array([[1.0, 0.0], [0.0, 1.0]]))
    asked = v.withColumnRenamed("vec_id", "query_id")
    assert {(r.query_id, r.vec_id, r["rank"]) for r in V.nearest(V.build_vector_index(v, "vec_id"), asked, 5).collect()} == {(0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 0, 2)}
    assert V.nearest(V.build_vector_index(v.limit(0), "vec_id"), asked, 5).count() == 0
    with pytest.raises(ValueError, match="names 64"):
        V.nearest(V.build_vector_index(v, "vec_id"), asked, 65)
