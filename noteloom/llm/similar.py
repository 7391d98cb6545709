"""Near-duplicates by word shingles of a similarity (Jaccard), with SimHash fingerprints in vantage-point shards.

At a similarity of 0.8 two 64-bit fingerprints differ in some 10 bits (arccos 0.89 / pi of them), and unrelated ones in 32 with a spread of 4: no vantage-point tree
over whole fingerprints can prune at such a radius. So the trees stand on the sets themselves, whose distance is the number of shingles that only one of two has, and on
fingerprints of parts of them, where the bound is tight:

* The first level's vantage point is the empty set: a set's distance from it is its size. Rings are powers of two; a set whose ball reaches a larger ring is also asked
  there, as a guest. Inside a ring the similarity bounds by how many shingles two linked sets differ.
* Below, there is one tree for each block of shingle hashes, with more blocks than shingles may differ, so two linked sets agree wholly in at least one that isn't empty.
  Its levels measure the Hamming distance of the block's own SimHash to vantage points; the bound is 0 there, and prunes every ring but one.

This is a proof, not a probability: of the first `differ` + 1 blocks of a set that aren't empty, one agrees. Equal sets of shingles are one node from the start. Fingerprints of
whole documents are searched by Hamming distance in each shard.

Two rounds find all links. The first proposes few pairs, nearest first, that connect what is near, and confirms each by its shingles: groups of copies become one
component at little cost. The second proposes every other pair of a shard within the radius whose ends the first has left in different components, and whose sizes
and min-hashes allow the similarity at all; those are confirmed too. So a near pair that shows to be no link hides no true one behind it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IDENTITY, dropped, identity, same_identity, written
from .components import connected_components
from .simhash import _root, _uneven, majority, shingle_hashes

HASHES, RADIUS, LEVELS = 48, 22, 14
AGREE = 27  # of HASHES min-hashes; at a similarity of 0.8 some 38 agree, with a spread of 2.8
STEP = 1 << 16
_rng = np.random.default_rng(17)
_TIMES, _PLUS = (_rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    parts = [np.unique(h.astype(np.uint64)) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def least_hashes(own: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over the set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 4096):
        mixed = own[at : at + 4096] * _TIMES[:, None] + _PLUS[:, None]
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=1))
    return least


def block_fingerprints(hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each block, which is n hashes from start on: bits are counted for all blocks at once, in planes of binary digits."""
    planes = [np.zeros(len(n), dtype=np.uint64) for _ in range(int(n.max(initial=0)).bit_length())]
    for p in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > p)
        carry = hashes[start[on] + p]
        for plane in planes:
            had = plane[on]
            plane[on], carry = had ^ carry, had & carry
    over, equal = np.zeros(len(n), dtype=np.uint64), np.full(len(n), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in reversed(range(len(planes))):
        half = (-(n // 2 >> j & 1)).astype(np.int64).view(np.uint64)
        over |= equal & planes[j] & ~half
        equal &= ~(planes[j] ^ half)
    return over


def shown_blocks(own: np.ndarray, size: np.ndarray, similarity: float, up: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, ring, block, fingerprint) of the blocks by which sets are found in the ring `up` above their own; own holds the sets one after another.

    Those are a set's first blocks that aren't empty, one more than the shingles by which it may differ from any partner there. Of two linked sets, the one that is done with
    fewer blocks agrees with the other in one of them. A set without so many shows all blocks, empty ones too.
    """
    ring = np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1 + up
    low = np.int64(1) << np.maximum(ring, 0)
    reach, share = np.floor(size / similarity + 1e-9).astype(np.int64), (1 - similarity) / (1 + similarity)
    differ = np.floor((size + np.minimum(reach, 2 * low - 1)) * share + 1e-9).astype(np.int64)
    blocks = np.ceil(4.5 * share * low).astype(np.int64) + 2
    here = (size > 0) & (reach >= low) & (differ > 0)  # sets that may not differ are one node
    row = np.repeat(np.arange(len(size)), size)
    own, row = own[here[row]], row[here[row]]
    place = row << 32 | ((own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[row])
    order = np.argsort(place, kind="stable")
    place, own = place[order], own[order]
    start = np.flatnonzero(np.diff(place, prepend=-1))
    n, of = np.diff(start, append=len(place)), place[start] >> 32
    have = np.bincount(of, minlength=len(size))
    shown = np.arange(len(of)) - (np.cumsum(have) - have)[of] <= differ[of]
    row, block, fp = of[shown], (place[start] & 0xFFFFFFFF)[shown], block_fingerprints(own, start[shown], n[shown])
    for k in np.flatnonzero(here & (have <= differ)):
        empty = np.setdiff1d(np.arange(blocks[k]), block[row == k])
        row, block, fp = np.append(row, np.full(len(empty), k)), np.append(block, empty), np.append(fp, np.zeros(len(empty), dtype=np.uint64))
    return row, ring[row], block, fp


def shard_keys(ring: np.ndarray, block: np.ndarray, fp: np.ndarray, points: np.ndarray) -> np.ndarray:
    """One number for the tree and the rings around its vantage points."""
    out = (ring << 48 | block).view(np.uint64)
    for v in points:
        out = out * np.uint64(65) + np.bitwise_count(fp ^ v)
    return out.view(np.int64)


def routed(sets: list[np.ndarray], similarity: float, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each set, the shards it lives in and those of larger rings that it is asked of."""
    homes, guests, at = [], [], 0
    while at < len(sets):
        part, n = [], 0
        while at < len(sets) and (not part or n + len(sets[at]) <= STEP):
            part.append(sets[at])
            n += len(sets[at])
            at += 1
        own, size, found, up = np.concatenate(part), np.array([len(x) for x in part], dtype=np.int64), [], 0
        # A ball reaches size / similarity, and each ring is twice as far as the one before.
        while up == 0 or similarity * 2 ** (up - 1) < 1:
            row, *tree = shown_blocks(own, size, similarity, up)
            found.append((row, shard_keys(*tree, points)))
            up += 1
        for to, parts in ((homes, found[:1]), (guests, found[1:])):
            row, key = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(row, kind="stable")
            to.extend(np.split(key[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1]))
    return homes, guests


def vantage_points(docs: DataFrame, words: int, similarity: float, fit_rows: int) -> np.ndarray:
    """LEVELS vantage points that spread a sample of block fingerprints well: up to 32 blocks of each of fit_rows documents. All documents are routed."""

    def run(batches):
        for b in batches:
            for t in b.column("text").to_pylist():
                x = shingle_set(t, words)
                fps = shown_blocks(x, np.array([len(x)]), similarity)[3][:32]
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])

    taken = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select("text").limit(fit_rows).mapInArrow(run, "fp long").collect()
    rng = np.random.default_rng(7)
    # Where the sample is small, some points are drawn.
    sample = np.concatenate([np.array([r[0] for r in taken], dtype=np.int64).view(np.uint64), rng.integers(0, 1 << 63, 64, dtype=np.uint64)])
    points, keys = [], np.zeros(len(sample), dtype=np.int64)
    for _ in range(LEVELS):
        tried = [(_uneven(keys * 65 + np.bitwise_count(sample ^ v)), int(v)) for v in rng.choice(sample, 6, replace=False) if v not in points]
        points.append(np.uint64(min(tried)[1]))
        keys = np.unique(keys * 65 + np.bitwise_count(sample ^ points[-1]), return_inverse=True)[1]
    return np.array(points)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def sketches(docs: DataFrame, words: int, similarity: float, points: np.ndarray) -> DataFrame:
    """(n, doc_id, k1, k2, s1, s2, fp, size, mins, homes, guests) of each row with an id: a number of the row, its identity, 128 bits of its shingles, fingerprint, number of shingles, a byte of each least hash, shards (see routed)."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), dtype="<i8").reshape(-1, 2)
            fps = np.array([majority([x] if len(x) else []) for x in sets], dtype=np.uint64).view(np.int64)
            mins = [(least_hashes(x) >> np.uint64(7)).astype(np.uint8).tobytes() for x in sets]
            cols = [*(b.column(c) for c in ["n", *IDENTITY]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(fps), pa.array([len(x) for x in sets], pa.int64()), pa.array(mins, pa.binary()), *map(_lists, routed(sets, similarity, points))]
            yield pa.RecordBatch.from_arrays(cols, ["n", *IDENTITY, "s1", "s2", "fp", "size", "mins", "homes", "guests"])

    rows = docs.where(docs["doc_id"].isNotNull()).select(F.monotonically_increasing_id().alias("n"), *identity(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "n long, doc_id long, k1 long, k2 long, s1 long, s2 long, fp long, size long, mins binary, homes array<long>, guests array<long>")


def pairs_within(fp: np.ndarray, query: np.ndarray, radius: int = RADIUS, nearest: int = 2) -> list[tuple[int, int]]:
    """Pairs of places within the radius, one of them a query: each query's nearest few, and what connects all that such pairs connect, nearest first."""
    n, q = len(fp), np.flatnonzero(query)
    if n == 2:
        return [(0, 1)] if int(np.bitwise_count(fp[0] ^ fp[1])) <= radius and len(q) else []
    out, parent = set(), np.arange(n)
    step = max(1, (1 << 22) // n)
    for limit in sorted({min(radius, x) for x in (3, 8, 14, radius)}):
        for at in range(0, len(q), step):
            rows = q[at : at + step]
            apart = np.bitwise_count(fp[rows][:, None] ^ fp[None, :])
            apart[np.arange(len(rows)), rows] = 255
            if limit == radius:
                best = np.argpartition(apart, min(nearest, n - 1) - 1, axis=1)[:, :nearest]
                for a, b in np.argwhere(np.take_along_axis(apart, best, axis=1) <= radius).tolist():
                    out.add((min(rows[a], best[a, b]), max(rows[a], best[a, b])))
            hit = apart <= limit
            for k in np.flatnonzero(hit.any(axis=1)):
                others = np.flatnonzero(hit[k])
                roots, first = np.unique(_root(parent, others), return_index=True)
                mine = _root(parent, rows[k : k + 1])[0]
                new = roots != mine
                if new.any():
                    out |= {(min(rows[k], o), max(rows[k], o)) for o in others[first[new]].tolist()}
                    parent[roots[new]] = mine
    return [(int(a), int(b)) for a, b in out]


def pairs_across(fp: np.ndarray, query: np.ndarray, home: np.ndarray, root: np.ndarray, size: np.ndarray, mins: np.ndarray, radius: int, similarity: float, agree: int = AGREE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within the radius, one of them a query and one at home, of different roots, whose sizes and least hashes allow the similarity; in blocks."""
    n, q = len(fp), np.flatnonzero(query)
    step = max(1, (1 << 20) // n)
    for at in range(0, len(q), step):
        rows = q[at : at + step]
        hit = np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= radius
        hit &= root[rows][:, None] != root[None, :]
        hit &= home[rows][:, None] | home[None, :]
        hit &= ~query[None, :] | (np.arange(n)[None, :] > rows[:, None])  # of two queries, once
        small, large = np.minimum(size[rows][:, None], size[None, :]), np.maximum(size[rows][:, None], size[None, :])
        hit &= small >= similarity * large - 1e-9
        a, b = np.nonzero(hit)
        a = rows[a]
        for lo in range(0, len(a), 1 << 18):
            x, y = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
            keep = (mins[x] == mins[y]).sum(axis=1) >= agree
            yield x[keep], y[keep]


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of rows that come sorted by the keys, across batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        change = np.zeros(len(t) - 1, dtype=bool) if len(t) else np.zeros(0, dtype=bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield {c: x[lo:hi] for c, x in cols.items()}
        held = t.slice(cuts[-1]).to_batches() if len(t) else []
    if held:
        t = pa.Table.from_batches(held)
        yield {c: t.column(c).to_numpy() for c in t.column_names}


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v) of every shard of rows (shard, slice, node, fp, query)."""

    def run(batches):
        us, vs = [], []
        for g in _grouped(batches, ["shard", "slice"]):
            node, first = np.unique(g["node"], return_index=True)
            if len(node) < 2:
                continue
            query = np.isin(node, g["node"][g["query"].astype(bool)])
            for a, b in pairs_within(g["fp"][first].view(np.uint64), query, radius):
                us.append(node[max(a, b)])
                vs.append(node[min(a, b)])
            if len(us) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    by = ["shard", "slice"]
    return rows.repartition(*by).sortWithinPartitions(*by).select(*by, "node", "fp", F.col("query").cast("int").alias("query")).mapInArrow(run, "u long, v long").distinct()


def _across(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(u, v) of pairs_across in every shard of rows (shard, slice, node, fp, query, home, root, size, mins)."""

    def run(batches):
        for g in _grouped(batches, ["shard", "slice"]):
            node, first = np.unique(g["node"], return_index=True)
            root = g["root"][first]
            if len(node) < 2 or (root == root[0]).all():
                continue
            query, home = (np.isin(node, g["node"][g[c].astype(bool)]) for c in ("query", "home"))
            mins = np.frombuffer(b"".join(g["mins"][first].tolist()), dtype=np.uint8).reshape(len(node), -1)
            for a, b in pairs_across(g["fp"][first].view(np.uint64), query, home, root, g["size"][first], mins, radius, similarity):
                u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    by, cols = ["shard", "slice"], ["shard", "slice", "node", "fp", "root", "size", "mins"]
    return rows.repartition(*by).sortWithinPartitions(*by).select(*cols, F.col("query").cast("int").alias("query"), F.col("home").cast("int").alias("home")).mapInArrow(run, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the written pairs whose shingles are so similar. Only documents of pairs are read again."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    wanted = rows.select("n", *[F.col(c).alias(f"w_{c}") for c in IDENTITY]).join(asked, "n", "left_semi")

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))], ["n", "own"])

    texts = docs.where(docs["doc_id"].isNotNull()).select(*identity(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sets = written(texts.join(wanted, same_identity("w_")).select("n", "text").mapInArrow(run, "n long, own array<long>").dropDuplicates(["n"]), "similar-sets")
    both = pairs.join(sets.select(F.col("n").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("n").alias("v"), F.col("own").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared) - F.lit(1e-9)).select("u", "v")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, hot_rows: int = 2048, anchors: int = 32, fit_rows: int = 256) -> DataFrame:
    """(doc_id, k1, k2, n, root) of every row with an id: rows of one root are linked by a chain of documents of that similarity.

    Vantage points are fitted on fit_rows documents, and every document is routed. A shard of over hot_rows nodes is dealt in slices, which hold some anchors of it in common; in the second round,
    what isn't in the shard's largest component asks all of its slices, so no two of a shard go unseen and a shard's size changes only how many pairs the first round proposes. Texts without words are
    one group. Very long texts are read whole; null texts count as empty. Below a similarity of some 0.7, most sets show empty blocks too, and shards grow.
    """
    rows = written(sketches(docs, words, similarity, vantage_points(docs, words, similarity, fit_rows)), "similar-sketches")
    classes = written(rows.groupBy("s1", "s2").agg(F.min("n").alias("node")), "similar-classes")
    one = written(rows.join(classes.select(F.col("node").alias("n")), "n", "left_semi").select(F.col("n").alias("node"), "fp", "homes", "guests"), "similar-nodes")
    lives, asks = (one.select("node", "fp", F.explode(c).alias("shard"), F.lit(c == "guests").alias("guest")) for c in ("homes", "guests"))
    nodes = lives.unionByName(asks)
    shards = written(nodes.groupBy("shard").agg(F.count("*").alias("many"), F.min("guest").alias("guests_only")).where("many > 1 and not guests_only").drop("guests_only"), "similar-shards")
    members = written(nodes.join(shards, "shard").withColumn("slices", F.ceil(F.col("many") / hot_rows).cast("int")).withColumn("slice", F.pmod(F.xxhash64("node", "shard"), F.col("slices")).cast("int")), "similar-members")
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    hot = members.where("slices > 1")
    some = hot.groupBy("shard", "slices", F.pmod(F.xxhash64("node"), F.lit(anchors)).alias("a")).agg(F.min(F.struct("node", "fp")).alias("m"))
    asked = members.withColumn("query", ~F.col("guest")).select("node", "fp", "shard", "slice", "query").unionByName(some.select("m.node", "m.fp", "shard", every().alias("slice"), F.lit(True).alias("query")))
    tried = written(_searched(asked, radius), "similar-pairs")
    edges = written(_confirmed(tried, docs, rows, words, similarity), "similar-edges")
    roots = written(connected_components(edges), "similar-roots").withColumnRenamed("node", "r")
    # Shards of two have shown all they hold; of the others, those that still are of more than one component.
    placed = members.where("many > 2").join(roots, F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node")).drop("r")
    apart = placed.groupBy("shard").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shard")
    told = rows.select(F.col("n").alias("node"), "size", "mins")
    open_ = written(placed.join(apart, "shard", "left_semi").join(told, "node").select("node", "fp", "shard", "slice", "slices", "guest", "root", "size", "mins"), "similar-open")
    largest = open_.where("slices > 1").groupBy("shard", "root").agg(F.count("*").alias("c")).groupBy("shard").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    outside = open_.where("slices > 1").join(largest, "shard").where("root <> largest").drop("largest")
    visits = outside.withColumn("slice", every()).withColumns({"query": F.lit(True), "home": F.lit(False)})
    # Two guests of a shard have met in a smaller ring.
    again = open_.withColumns({"query": F.col("slices") == 1, "home": ~F.col("guest") | (F.col("slices") > 1)}).unionByName(visits).drop("slices", "guest")
    more = written(_across(again, radius, similarity).join(tried, ["u", "v"], "left_anti"), "similar-more-pairs")
    edges = edges.unionByName(_confirmed(more, docs, rows, words, similarity))
    roots = written(connected_components(edges), "similar-roots")
    known = rows.join(classes, ["s1", "s2"]).select(*IDENTITY, "n", "node")
    return known.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select(*IDENTITY, "n", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar documents, the one with the smallest doc_id (of rows that share it, any one); all columns stay. Rows without a doc_id stay as well.

    Null and empty texts are a group of their own; an empty table gives an empty one.
    """
    groups = written(similar_groups(docs, words, similarity), "similar-groups")
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "n", "k1", "k2")).alias("b")).select("b.*")
    repeats = groups.groupBy(*IDENTITY).agg(F.count("*").alias("copies"))
    kept = written(kept.join(repeats.where("copies > 1"), IDENTITY, "left").select(*[F.col(c).alias(f"__kept_{c}") for c in IDENTITY], F.coalesce("copies", F.lit(1)).alias("__copies")), "similar-kept")
    one, k1, k2 = identity(docs)
    same = (one == kept["__kept_doc_id"]) & (k1 == kept["__kept_k1"]) & (k2 == kept["__kept_k2"])
    once = docs.join(kept.where("__copies = 1"), same, "left_semi")
    several = docs.join(kept.where("__copies > 1"), same).withColumn("__place", F.row_number().over(Window.partitionBy("__kept_doc_id", "__kept_k1", "__kept_k2").orderBy("__copies"))).where("__place = 1").select(*[docs[c] for c in docs.columns])
    out = once.unionByName(docs.where(docs["doc_id"].isNull()))
    return out.unionByName(several) if kept.where("__copies > 1").limit(1).count() else out
