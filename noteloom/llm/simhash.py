"""SimHash near-duplicates, linked through vantage-point shards.

Fingerprints within `radius` (2) bits of each other agree wholly in at least one of three disjoint blocks of bits. There is
one vantage-point tree for each block. Its upper levels measure the Hamming distance to vantage points inside the block: there
the triangle bound |d(a,v) - d(b,v)| <= d(a,b) = 0 prunes every ring but one. Its last level measures the distance over
all 64 bits to one more vantage point, and splits at the median: there the bound is `radius`, and a fingerprint whose ball
crosses the boundary is also sent, as a query only, to the shard on the other side. Shards search themselves with local
vantage-point trees over all 64 bits and return star edges, never all pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written
from .components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCKS = np.array([0x00000000003FFFFF, 0x000007FFFFC00000, 0xFFFFF80000000000], dtype=np.uint64)
STEP = 1 << 16


def shingle_hashes(text: str | None, words_in_shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, repeats included, STEP at a time; of the whole sequence where there are fewer words, none without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    for at in range(0, max(1, len(words) - words_in_shingle + 1) if words else 0, STEP):
        part = words[at : at + STEP + words_in_shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(words_in_shingle)))) if len(part) >= words_in_shingle else [b" ".join(part)]
        yield np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=">u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have set, as an unsigned number; 0 without any."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The 64 bits as an unsigned number; 0 for a text without words."""
    return majority(shingle_hashes(text, words_in_shingle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, fp long")


def _uneven(keys: np.ndarray) -> float:
    _, n = np.unique(keys, return_counts=True)
    return float(((n / len(keys)) ** 2).sum())


class Forest:
    """Vantage points and boundaries of the three trees, fitted on a bounded sample; small, and sent with the tasks."""

    def __init__(self, sample: np.ndarray, total: int, shard_rows: int, hot_rows: int, radius: int, max_levels: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.radius, self.block_points, self.last = radius, [], []
        for block in BLOCKS:
            points, keys = [], np.zeros(len(sample), dtype=np.int64)
            for _ in range(max_levels):
                if _uneven(keys) * total <= shard_rows:
                    break
                tried = [(_uneven(keys * 64 + np.bitwise_count((sample ^ v) & block)), int(v)) for v in rng.choice(sample, min(12, len(sample)), replace=False)]
                points.append(np.uint64(min(tried)[1]))
                keys = np.unique(keys * 64 + np.bitwise_count((sample ^ points[-1]) & block), return_inverse=True)[1]
            tried = []
            for v in rng.choice(sample, min(12, len(sample)), replace=False):
                d = np.bitwise_count(sample ^ v).astype(int)
                at = int(np.median(d))
                tried.append((float((np.abs(d - at) <= radius).mean()), int(v), at))
            _, v, at = min(tried)
            self.block_points.append(points)
            self.last.append((np.uint64(v), at))
        self.hot: dict[tuple[int, int], tuple] = {}
        for tree in range(3):
            home = self.keys(tree, sample) * np.uint64(2) + self.sides(tree, sample)[0]
            for key, n in Counter(home.tolist()).items():
                if n >= 8 and n / len(sample) * total > hot_rows:
                    self.hot[(tree, key)] = self._split(sample[home == key], total / len(sample), hot_rows, rng)

    def _split(self, x: np.ndarray, each: float, hot_rows: int, rng, depth: int = 0) -> tuple:
        """Further levels of a hot shard, over all 64 bits: (vantage point, boundary, near, far), down to (slices,) where a sample row stands for `each` rows and boundaries no longer prune."""
        if len(x) * each <= hot_rows or depth >= 12:
            return (max(1, math.ceil(len(x) * each / hot_rows)),)
        tried = []
        for v in rng.choice(x, min(12, len(x)), replace=False):
            d = np.bitwise_count(x ^ v).astype(int)
            at = int(np.median(d))
            near, far = x[d <= at + self.radius], x[d > at - self.radius]
            tried.append((max(len(near), len(far)), int(v), at, d))
        most, v, at, d = min(tried, key=lambda t: t[:3])
        if most > 0.8 * len(x):
            return (math.ceil(len(x) * each / hot_rows),)
        return (np.uint64(v), at, *(self._split(x[side], each, hot_rows, rng, depth + 1) for side in (d <= at, d > at)))

    def _dealt(self, node: tuple, x: np.ndarray, resident: np.ndarray, leaf: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(leaf, slices, rows, whether they live there): a row whose ball crosses a boundary is asked of the other side too."""
        if not len(x):
            return
        if len(node) == 1:
            yield leaf, node[0], x, resident
            return
        v, at, near, far = node
        d = np.bitwise_count(x ^ v).astype(np.int64)
        for side, home, reach in ((near, d <= at, d <= at + self.radius), (far, d > at, d > at - self.radius)):
            yield from self._dealt(side, x[reach], (resident & home)[reach], leaf * 2 + (side is far))

    def keys(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The rings of x around the block's vantage points, as one number (6 bits a level; 10 levels at most)."""
        out = np.zeros(len(x), dtype=np.uint64)
        for v in self.block_points[tree]:
            out = out * np.uint64(64) + np.bitwise_count((x ^ v) & BLOCKS[tree]).astype(np.uint64)
        return out

    def sides(self, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home side of the boundary, and whether the ball of the radius reaches the other side."""
        v, at = self.last[tree]
        d = np.bitwise_count(x ^ v).astype(np.int64)
        return (d > at).astype(np.uint64), np.where(d <= at, d + self.radius > at, d - self.radius <= at)

    def route(self, x: np.ndarray) -> pd.DataFrame:
        """A row for each shard that x lives in (resident) or must be asked of. A shard that stays hot has slices: each holds all its residents and a part of the queries."""
        out = []

        def add(tree: int, shard: np.ndarray, leaf: int, slices: int, fp: np.ndarray, resident: np.ndarray) -> None:
            own = (fp.view(np.int64) * np.int64(0x9E3779B97F4A7C1) >> 40) % slices
            copies = np.where(resident, slices, 1)
            rep = np.repeat(np.arange(len(fp)), copies)
            part = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
            part = np.where(resident[rep], part, own[rep])
            out.append(pd.DataFrame({"tree": np.int32(tree), "shard": shard[rep].view(np.int64), "part": leaf * 1_000_000 + part, "fp": fp[rep].view(np.int64), "resident": resident[rep], "query": part == own[rep]}))

        for tree in range(3):
            key = self.keys(tree, x) * np.uint64(2)
            side, over = self.sides(tree, x)
            shard, fp = np.concatenate([key + side, (key + (np.uint64(1) - side))[over]]), np.concatenate([x, x[over]])
            resident = np.arange(len(fp)) < len(x)
            cold = np.ones(len(fp), dtype=bool)
            for (t, k), node in self.hot.items():
                if t == tree and (mine := shard == np.uint64(k)).any():
                    cold &= ~mine
                    for leaf, slices, part, lives in self._dealt(node, fp[mine], resident[mine]):
                        add(tree, np.full(len(part), k, dtype=np.uint64), leaf, slices, part, lives)
            add(tree, shard[cold], 0, 1, fp[cold], resident[cold])
        return pd.concat(out, ignore_index=True)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            parent[x] = r
            return r
        r = up


def _link(parent, nodes, q, r, radius, rng, depth=0):
    """Union all pairs of q and r (places in nodes) within the radius. A local vantage point splits large searches while that prunes."""
    if len(q) * len(r) > 1 << 24 and depth < 40:
        v = nodes[r[rng.integers(len(r))]]
        dr, dq = (np.bitwise_count(nodes[x] ^ v).astype(np.int16) for x in (r, q))
        at = int(np.median(dr))
        near, far = (q[dq <= at + radius], r[dr <= at]), (q[dq > at - radius], r[dr > at])
        if sum(len(a) * len(b) for a, b in (near, far)) < 0.9 * len(q) * len(r):
            for a, b in (near, far):
                if len(a) and len(b):
                    _link(parent, nodes, a, b, radius, rng, depth + 1)
            return
    step = max(1, (1 << 21) // max(1, len(r)))
    for at in range(0, len(q), step):
        qs = q[at : at + step]
        apart = np.bitwise_count(nodes[qs][:, None] ^ nodes[r][None, :])
        hit = apart - np.uint8(1) < radius  # 0, a node met by itself, wraps to 255
        for k in np.flatnonzero(hit.any(axis=1)):
            roots = np.unique(_root(parent, np.append(r[hit[k]], qs[k])))
            parent[roots] = roots[0]


def shard_edges(g: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Star edges (u, v) of one shard's components, u the larger end."""
    fp = g["fp"].to_numpy().view(np.uint64)
    nodes, place = np.unique(fp, return_inverse=True)
    q, r = np.unique(place[g["query"].to_numpy()]), np.unique(place[g["resident"].to_numpy()])
    parent = np.arange(len(nodes))
    if len(q) and len(r):
        _link(parent, nodes, q, r, radius, np.random.default_rng(1))
    root = _root(parent, np.arange(len(nodes)))
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[moved].view(np.int64), "v": nodes[root[moved]].view(np.int64)})


def near_duplicates(docs: DataFrame, radius: int = 2, shard_rows: int = 2048, hot_rows: int = 8192, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Equal fingerprints are one node, so a group of copies costs one row beyond its fingerprints. fit_rows bounds the sample
    that vantage points and boundaries are fitted on; every fingerprint is routed and searched. Empty and null texts have
    fingerprint 0. Rows with a null doc_id get their component's id too; rows that repeat a doc_id are rows of their own, each with its text's fingerprint; an empty table
    gives an empty result. Very long texts are hashed STEP shingles at a time; columns other than doc_id and text are never read, so their names can't clash.
    """
    if radius > 2:
        raise ValueError("three blocks prove a shared block for at most 2 differing bits")
    fps = written(fingerprints(docs), "simhash-docs")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    total = nodes.count()
    named = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    if not total:
        return fps.select("doc_id", named, F.col("doc_id").alias("component_id"))
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(fit_rows).collect()], dtype=np.int64).view(np.uint64)
    forest = Forest(sample, total, shard_rows, hot_rows, radius)

    def route(batches):
        for pdf in batches:
            yield forest.route(pdf["fp"].to_numpy().view(np.uint64))

    routed = nodes.select("fp").mapInPandas(route, "tree int, shard long, part long, fp long, resident boolean, query boolean")
    edges = routed.groupBy("tree", "shard", "part").applyInPandas(lambda g: shard_edges(g, radius), "u long, v long")
    roots = connected_components(edges)
    # Both written, so that joins have exchanges of their own on both sides and AQE can split a giant component, or a fingerprint that very many documents share.
    found = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    classes = written(found.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-classes")
    return fps.join(found.join(classes, "root").select("fp", "component_id"), "fp").select("doc_id", named, "component_id")


