"""The link graph: aliases, edges, degrees, neighbourhoods, renames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import keys
from noteloom.sources.shared import stored

from .index import Index


def outgoing_links(index: Index, key: str) -> DataFrame:
    note = index.documents.where(F.col("key") == key).select(F.col("id").alias("document_id"))
    return index.links.join(note, "document_id", "left_semi").select("to_key").orderBy("to_key")


def _names(key: Column) -> Column:
    return F.array_distinct(F.array(key, keys.strip_extension(key), keys.strip_extension(keys.basename(key))))


def backlinks(index: Index, key: str | None = None, limit: int | None = None) -> DataFrame:
    """Notes that link to a key, by full key, key without extension, or basename without it; of all keys if none is given.

    The bulk form is the expanded join, N * M rows for a name that N notes share and M link by; backlink_classes() holds the same in N + M. Its rows go from the join to whoever reads them and
    are never exchanged: links meet their sources first, then, in cells of some CELL links and CELL names, the names.
    """
    targets = index.documents if key is None else index.documents.where(F.col("key") == key)
    names = targets.select(F.col("key").alias("target"), F.explode(_names(F.col("key"))).alias("to_key"))
    sources = index.documents.select(F.col("id").alias("document_id"), "key", "modified_ms")
    found = index.links.join(sources, "document_id").join(names, "to_key") if key is not None else _expanded(index.links, sources, names)
    out = found.select("target", "key", F.col("to_key").alias("via"), "modified_ms")
    return out if limit is None else out.orderBy(F.desc("modified_ms"), "key", "via").limit(limit)


#: Links by one name, and notes of that name, that meet in one cell of the expanded join; rows of it that one task makes, about.
CELL, ROWS = 4096, 1 << 24


def _expanded(links: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """links with their sources and all names they fit. A name of many links or notes is dealt in cells, so a task's rows don't grow with it; what is exchanged for N * M rows is N + M and 2 * N * M / CELL."""
    count = lambda df, n: df.groupBy("to_key").agg(F.count("*").alias(n))
    sizes = stored(count(links, "links").join(count(names, "names"), "to_key"), "linked")  # a row a name that is linked
    pairs = sizes.agg(F.sum(F.col("links") * F.col("names"))).first()[0] or 0
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    large = F.broadcast(sizes.where((F.col("links") > CELL) | (F.col("names") > CELL)).select("to_key", cells("links").alias("a"), cells("names").alias("b")))  # a row for CELL links or names at least
    ways = lambda n: F.coalesce(n, F.lit(1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), ways(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), ways(n) - 1))
    left = links.join(sources, "document_id").join(large, "to_key", "left").select("to_key", "key", "modified_ms", dealt("key", F.col("a")).alias("i"), every(F.col("b")).alias("j"))
    right = names.join(large, "to_key", "left").select("to_key", "target", dealt("target", F.col("b")).alias("j"), every(F.col("a")).alias("i"))
    parts, by = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // ROWS)), ["to_key", "i", "j"]
    return left.repartition(parts, *by).join(right.repartition(parts, *by), by)


def backlink_classes(index: Index) -> tuple[DataFrame, DataFrame]:
    """Backlinks of all keys, unexpanded: (via, target) for each name that is linked, and (via, key, modified_ms) for each note that links by it.

    N notes that share a basename and M links to it are N + M rows here, N * M in backlinks(); the join on via gives those.
    """
    linked = index.links.select(F.col("to_key").alias("via")).distinct()
    names = index.documents.select(F.col("key").alias("target"), F.explode(_names(F.col("key"))).alias("via"))
    sources = index.documents.select(F.col("id").alias("document_id"), "key", "modified_ms")
    by = index.links.join(names.select(F.col("via").alias("to_key")).distinct(), "to_key", "left_semi").join(sources, "document_id")
    return names.join(linked, "via", "left_semi").select("via", "target"), by.select(F.col("to_key").alias("via"), "key", "modified_ms")


def link_aliases(index: Index, prefix: str = "") -> DataFrame:
    """alias -> key, one row an alias: the last key in order wins, so the join on it can't multiply rows."""
    docs = index.documents.where(keys.has_prefix(F.col("key"), prefix))
    return docs.select("key", F.explode(_names(F.col("key"))).alias("alias")).groupBy("alias").agg(F.max("key").alias("key"))


def resolve_edges(index: Index, prefix: str = "", edge_scope: str = "prefix") -> DataFrame:
    """(from_key, link, to_key, dangling, unresolved). Dangling: the raw link is no alias, even if it is one without its extension."""
    alias = link_aliases(index, prefix)
    docs = index.documents.where(keys.has_prefix(F.col("key"), prefix if edge_scope == "prefix" else ""))
    rows = index.links.join(docs.select(F.col("id").alias("document_id"), F.col("key").alias("from_key")), "document_id").withColumn("__bare", keys.strip_extension(F.col("to_key")))
    a, b = alias.select(F.col("alias").alias("__a"), F.col("key").alias("__ka")), alias.select(F.col("alias").alias("__b"), F.col("key").alias("__kb"))
    out = rows.join(a, F.col("to_key") == F.col("__a"), "left").join(b, F.col("__bare") == F.col("__b"), "left")
    to = F.coalesce("__ka", "__kb")
    return out.select("from_key", F.col("to_key").alias("link"), to.alias("to_key"), F.col("__ka").isNull().alias("dangling"), to.isNull().alias("unresolved"))


def degrees(index: Index, prefix: str = "") -> DataFrame:
    """Out-degree counts every edge, dangling ones too; in-degree the resolved ones."""
    edges = resolve_edges(index, prefix)
    ends = edges.select(F.col("from_key").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.where("to_key is not null").select("to_key", F.lit(0), F.lit(1)))
    counted = ends.groupBy("key").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    docs = index.documents.where(keys.has_prefix(F.col("key"), prefix)).select("key", "title")
    return docs.join(counted, "key", "left").select("key", "title", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def graph_nodes(index: Index, prefix: str = "", limit: int = 200) -> DataFrame:
    """A page of nodes with the degrees they have in the whole graph."""
    return degrees(index, prefix).orderBy("key").limit(limit)


def graph_edges(index: Index, prefix: str = "", limit: int = 200, include_dangling: bool = True) -> DataFrame:
    """Edges that leave a node of the page and end in one, or nowhere."""
    page = index.documents.where(keys.has_prefix(F.col("key"), prefix)).select("key").orderBy("key").limit(limit)
    edges = resolve_edges(index, prefix).join(page.select(F.col("key").alias("from_key")), "from_key", "left_semi")
    inside = edges.where("to_key is not null").join(page.select(F.col("key").alias("to_key")), "to_key", "left_semi").select("from_key", "link", "to_key", "dangling")
    return inside.union(edges.where("to_key is null").select("from_key", "link", "to_key", "dangling")) if include_dangling else inside


def graph_totals(index: Index, prefix: str = "", limit: int = 200) -> DataFrame:
    """Edges are counted over the whole graph, not over the page."""
    edges = resolve_edges(index, prefix).agg(F.count("*").alias("edge_count"), F.count_if("dangling").alias("dangling_count"))
    nodes = index.documents.where(keys.has_prefix(F.col("key"), prefix)).agg(F.count("*").alias("total_nodes"), F.least(F.count("*"), F.lit(limit)).alias("node_count"))
    return nodes.join(edges)


def orphans(index: Index, mode: str = "isolated", prefix: str = "", limit: int | None = None) -> DataFrame:
    lone = {"isolated": "in_degree = 0 and out_degree = 0", "noIncoming": "in_degree = 0", "noOutgoing": "out_degree = 0"}[mode]
    out = degrees(index, prefix).where(lone)
    return out if limit is None else out.orderBy("key").limit(limit)


def neighbors(index: Index, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(seed, key, hops) within 1 to 3 hops, either direction. seeds: one column, key. The edges and each hop, of which only what is new is kept, are stored once."""
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1, 2 or 3")
    edges = resolve_edges(index).where("to_key is not null").select(F.col("from_key").alias("a"), F.col("to_key").alias("b"))
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    known = index.documents.join(seeds.select("key").distinct(), "key", "left_semi")
    seen = front = stored(known.select(F.col("key").alias("seed"), "key", F.lit(0).alias("hops")), "seeds")
    for hop in range(1, depth + 1):
        reached = front.join(both, front["key"] == both["a"]).select("seed", F.col("b").alias("key")).distinct()
        front = stored(reached.join(seen.select("seed", "key"), ["seed", "key"], "left_anti").select("seed", "key", F.lit(hop).alias("hops")), "frontier")
        seen = seen.union(front)
    return seen


def dangling_links(index: Index, prefix: str = "") -> DataFrame:
    return resolve_edges(index, prefix).where("to_key is null").select("from_key", "link")


_LINK = re.compile(r"\[\[([^\]\n|#]+)((?:[#|][^\]\n]*)?)\]\]")


def rewrite_text(text: str | None, renames: dict[str, str]) -> str | None:
    """Links whose target, or its basename, is renamed get the new name; what follows # or | stays."""

    def swap(m: re.Match) -> str:
        target = m[1].strip()
        new = renames.get(target, renames.get(target.rsplit("/", 1)[-1]))
        return m[0] if new is None else f"[[{new}{m[2]}]]"

    return None if text is None else _LINK.sub(swap, text)


def rename_links(objects: DataFrame, index: Index, renames: DataFrame, dry_run: bool = False) -> DataFrame:
    """Notes that change when files are renamed: key, and text unless dry_run.

    renames: (from_key, to_key). The links table tells which notes are touched and by what; only those texts are read and rewritten,
    each with the few renames that concern it. The renamed note itself is left alone.
    """
    bare = keys.strip_extension(F.col("from_key"))
    names = renames.select(F.col("from_key").alias("moved"), keys.strip_extension(F.col("to_key")).alias("new"), F.explode(F.array_distinct(F.array(bare, keys.basename(bare)))).alias("target"))
    names = names.groupBy("target").agg(F.min(F.struct("moved", "new")).alias("m")).select("target", "m.moved", "m.new")
    links = index.links.select("document_id", F.explode(F.array_distinct(F.array("to_key", keys.basename(F.col("to_key"))))).alias("target"))
    per = links.join(names, "target").groupBy("document_id").agg(F.map_from_entries(F.collect_set(F.struct("target", "new"))).alias("renames"), F.collect_set("moved").alias("moved"))
    notes = objects.where(keys.is_indexable(F.col("key"))).join(per, objects["id"] == per["document_id"]).where(~F.array_contains("moved", F.col("key")))
    if dry_run:
        return notes.select("key")

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([rewrite_text(t, dict(m)) for t, m in zip(text, how, strict=True)])

    return notes.select("key", rewrite("text", "renames").alias("text"))
