"""The registered queries over the vault and journal derived from the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import keys
from noteloom.operators import edits, index, links, search, stats, tags
from noteloom.sources import io, segments
from noteloom.sources.shared import folder

from .derived import BASE, journal, vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = BASE):
    """Register f(spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = base + sql
        return f

    return add


INDEXED_AT = 1704067200000 + 9_000_000_000
_published: dict[tuple, index.Index] = {}


def stamp(spark: SparkSession, sf: str, *tables: str) -> tuple:
    """What tells whether tables below a folder have changed: session, files, sizes, times of change."""
    found = []
    for t in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet")
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return (spark.sparkContext.applicationId, sf, *sorted(found))


def stored_index(spark: SparkSession, sf: str) -> index.Index:
    """The index of the vault below a folder, published on the first question and read by all others of the session; anew when the table's files change."""
    key = stamp(spark, sf, "documents")
    if key not in _published:
        _published[key] = io.publish(vault(spark, sf), folder(spark, "index"), "1", INDEXED_AT)
    return _published[key]


_graphs: dict[tuple, index.Index] = {}


def graph_index(spark: SparkSession, sf: str) -> index.Index:
    """The stored index if there is one; else keys, times and links alone, stored on the first question about them."""
    key = stamp(spark, sf, "documents")
    if key not in _published and key not in _graphs:
        _graphs[key] = io.publish_graph(vault(spark, sf), folder(spark, "graph"))
    return _published.get(key) or _graphs[key]


def over_graph(name: str, f: Callable[[index.Index], DataFrame], sql: str) -> None:
    """A question about links, which reads no texts, titles or tags."""
    query(name, sql)(lambda spark, sf: f(graph_index(spark, sf)))


def over_index(name: str, f: Callable[[index.Index], DataFrame], sql: str | None = None) -> None:
    """A question to the stored index."""
    query(name, sql)(lambda spark, sf: f(stored_index(spark, sf)))


def over_objects(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf: f(vault(spark, sf)))


# Sources and keys
over_objects("list_objects", lambda o: io.list_objects(o, "p").select("key", "etag", "size", "modified_ms"), "SELECT key, etag, size, modified_ms FROM objects WHERE starts_with(lower(key), 'p') ORDER BY modified_ms DESC, key LIMIT 100")
over_objects(
    "guess_content_type",
    lambda o: o.select("key", keys.content_type(F.col("key")).alias("content_type"), keys.is_text_content_type(keys.content_type(F.col("key"))).alias("is_text")),
    "SELECT key, CASE WHEN ends_with(key, '.png') THEN 'image/png' WHEN ends_with(key, '.txt') THEN 'text/plain; charset=utf-8' ELSE 'text/markdown; charset=utf-8' END AS content_type, NOT ends_with(key, '.png') AS is_text FROM objects",
)
over_objects(
    "key_predicates",
    lambda o: o.select(
        "key", keys.is_text_key(F.col("key")).alias("is_text"), keys.is_system_key(F.col("key")).alias("is_system"), keys.is_indexable(F.col("key")).alias("is_indexable"),
        keys.key_error(F.concat("key", F.when(F.col("id") % 7 == 0, "/").when(F.col("id") % 7 == 1, "//x").when(F.col("id") % 7 == 2, "/../x").otherwise(""))).alias("key_error"),
        keys.strip_extension(F.col("key")).alias("bare"), keys.top_folder(F.col("key")).alias("folder"), keys.version_source_path(F.col("key")).alias("source_path"),
    ),
    r"""SELECT key, regexp_matches(lower(key), '\.(md|txt|markdown|mdx)$') AS is_text, starts_with(key, '.mineral/') AS is_system, key IN (SELECT key FROM notes) AS is_indexable,
  CASE id % 7 WHEN 0 THEN 'leading or trailing /' WHEN 1 THEN 'contains //' WHEN 2 THEN 'contains ..' END AS key_error, regexp_replace(key, '(?i)\.(md|markdown|mdx|txt)$', '') AS bare,
  CASE WHEN contains(key, '/') THEN string_split(key, '/')[1] ELSE '(root)' END AS folder, nullif(regexp_extract(key, '^\.mineral/versions/[^/]+/content/(.*)$', 1), '') AS source_path FROM objects""",
)
over_objects(
    "canonical_paths",
    lambda o: o.select("key", keys.canonical_path(F.concat(F.lit("\\"), F.translate("key", "/", "\\"))).alias("path"), keys.is_canonical_path(F.concat(F.lit("/"), "key")).alias("slash_first"), keys.object_key(F.lit("/vault/"), F.col("key")).alias("object_key"), keys.vault_key(F.lit("p0"), F.col("key")).alias("vault_key")),
    "SELECT key, key AS path, FALSE AS slash_first, 'vault/' || key AS object_key, CASE WHEN starts_with(key, 'p0/') THEN substr(key, 4) END AS vault_key FROM objects",
)
over_objects("relative_time", lambda o: o.select("key", keys.relative_time(F.col("modified_ms") / 1000, F.lit(1710000000)).alias("age")), "SELECT key, CASE WHEN a < 60 THEN CAST(a AS BIGINT) || '秒前' WHEN a < 3600 THEN CAST(floor(a / 60) AS BIGINT) || '分钟前' WHEN a < 86400 THEN CAST(floor(a / 3600) AS BIGINT) || '小时前' WHEN a < 2592000 THEN CAST(floor(a / 86400) AS BIGINT) || '天前' WHEN a < 31536000 THEN CAST(floor(a / 2592000) AS BIGINT) || '个月前' ELSE CAST(floor(a / 31536000) AS BIGINT) || '年前' END AS age FROM (SELECT key, greatest(0, 1710000000 - modified_ms / 1000.0) AS a FROM objects) AS t")


def _edits(o: DataFrame) -> DataFrame:
    return o.where("id % 4 = 0").select(F.when(F.col("id") % 8 == 0, F.concat(F.lit("new/"), "key")).otherwise(F.col("key")).alias("key"), F.concat(F.lit("added "), "id").alias("new_text"))


_E = ", e AS (SELECT CASE WHEN id % 8 = 0 THEN 'new/' || key ELSE key END AS key, 'added ' || id AS new_text FROM objects WHERE id % 4 = 0), b AS (SELECT e.key, e.new_text, o.text AS old FROM e LEFT JOIN objects o ON o.key = e.key) "
_write = lambda mode: lambda o: edits.apply_writes(o, _edits(o), mode).select("key", F.sha2("text", 256).alias("sha"), "outcome")
over_objects("apply_writes_create", _write("create"), _E + "SELECT key, sha256(coalesce(old, new_text)) AS sha, CASE WHEN old IS NULL THEN 'created' ELSE 'exists' END AS outcome FROM b")
over_objects("apply_writes_overwrite", _write("overwrite"), _E + "SELECT key, sha256(new_text) AS sha, CASE WHEN old IS NULL THEN 'created' ELSE 'replaced' END AS outcome FROM b")
over_objects("apply_writes_append", _write("append"), _E + "SELECT key, sha256(CASE WHEN old IS NULL THEN new_text WHEN ends_with(old, chr(10)) THEN old || new_text ELSE old || chr(10) || chr(10) || new_text END) AS sha, CASE WHEN old IS NULL THEN 'created' ELSE 'appended' END AS outcome FROM b")

# Parsing
over_objects("parse_documents", lambda o: index.parse_documents(o).select("id", "key", "content_sha256", "title", "heading_text", F.sha2("body", 256).alias("body_sha256")), "SELECT id, key, content_sha256, title, heading_text, sha256(body) AS body_sha256 FROM documents_")
over_index("document_headings", lambda x: x.headings, "SELECT * FROM headings")
over_index("frontmatter_rows", lambda x: x.front, "SELECT * FROM front")
over_index("tag_counts", lambda x: x.tags, "SELECT document_id, tag, source, occurrences FROM tags")
over_index("extract_wikilinks", lambda x: x.links, "SELECT * FROM links")
over_index("heading_outline", lambda x: index.heading_outline(x, "p0/n1.md"), "SELECT ordinal, level, h.text, line FROM headings h JOIN notes n ON n.id = h.document_id WHERE n.key = 'p0/n1.md'")
over_objects("read_parsed", lambda o: index.read_parsed(o, "p0/n1.md").select("key", "front", F.sha2("body", 256).alias("body_sha256"), F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links")), "SELECT key, '{\"title\":\"Note 1\",\"tags\":[\"alpha\",\"t1\",\"area/a1\"],\"status\":\"done\",\"rank\":1}' AS front, sha256(body) AS body_sha256, 't1,Beta' AS tags, 'p0/n7,n3,missing1,p0/n1.md' AS links FROM notes WHERE key = 'p0/n1.md'")
over_index("search_frontmatter", lambda x: index.search_frontmatter(x, "status", "draft", prefix="p"), "SELECT n.key, value, modified_ms FROM front f JOIN notes n ON n.id = f.document_id WHERE field = 'status' AND value = 'draft' AND starts_with(lower(n.key), 'p') ORDER BY modified_ms DESC, n.key LIMIT 100")
over_index("index_freshness", index.index_freshness, "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS stale, FALSE AS partial, TRUE AS ready, CAST(1713067200000 AS BIGINT) AS indexed_at FROM notes")

# Tags
_BY = "sum(occurrences) FILTER (source = '{}')"
_SUMS = "CAST(coalesce(" + _BY.format("frontmatter") + ", 0) AS BIGINT) AS frontmatter_count, CAST(coalesce(" + _BY.format("body") + ", 0) AS BIGINT) AS body_count"
over_index("tag_list", tags.tag_list, f"SELECT tag, CAST(sum(occurrences) AS BIGINT) AS reference_count, count(DISTINCT document_id) AS document_count, {_SUMS} FROM tags GROUP BY tag ORDER BY tag LIMIT 100")
over_index("tag_list_filtered", lambda x: tags.tag_list(x, ["body"], "p", "T", 5), f"SELECT tag, CAST(sum(occurrences) AS BIGINT) AS reference_count, count(DISTINCT document_id) AS document_count, {_SUMS} FROM tags JOIN notes n ON n.id = document_id WHERE source = 'body' AND contains(lower(tag), 't') AND starts_with(lower(n.key), 'p') GROUP BY tag HAVING sum(occurrences) >= 5 ORDER BY tag LIMIT 100")
over_index("tag_documents", lambda x: tags.tag_documents(x, "t3"), f"SELECT n.key, n.modified_ms, {_SUMS} FROM tags JOIN notes n ON n.id = document_id WHERE tag = 't3' GROUP BY 1, 2 ORDER BY n.modified_ms DESC, n.key LIMIT 100")
over_index("tag_descendants", lambda x: tags.tag_documents(x, "area", "descendants"), f"SELECT n.key, n.modified_ms, {_SUMS} FROM tags JOIN notes n ON n.id = document_id WHERE tag = 'area' OR starts_with(lower(tag), 'area/') GROUP BY 1, 2 ORDER BY n.modified_ms DESC, n.key LIMIT 100")
over_index("tag_suggest", lambda x: tags.tag_suggest(x, "area/a1/x"), "SELECT DISTINCT tag, FALSE AS tag_exists FROM tags WHERE contains('area/a1/x', lower(tag)) OR contains(lower(tag), 'area/a1/x') ORDER BY tag LIMIT 10")
over_index("tag_suggestions", tags.tag_suggestions, "SELECT tag, suggested FROM (SELECT a.tag, b.tag AS suggested, row_number() OVER (PARTITION BY a.tag ORDER BY b.tag) AS k FROM (SELECT DISTINCT tag FROM tags) a JOIN (SELECT DISTINCT tag FROM tags) b ON a.tag <> b.tag AND (contains(lower(a.tag), lower(b.tag)) OR contains(lower(b.tag), lower(a.tag)))) AS s WHERE k <= 10")
over_index("complete_tags", lambda x: tags.complete_tags(x, "A"), "SELECT DISTINCT tag FROM tags WHERE contains(lower(tag), 'a') ORDER BY tag LIMIT 50")

# Links
over_graph("outgoing_links", lambda x: links.outgoing_links(x, "p0/n1.md"), "SELECT to_key FROM links JOIN notes n ON n.id = document_id WHERE n.key = 'p0/n1.md'")
over_graph("backlinks", lambda x: links.backlinks(x, "p0/n7.md", 100), "SELECT a.key AS target, n.key, l.to_key AS via, n.modified_ms FROM names a JOIN links l ON l.to_key = a.alias JOIN notes n ON n.id = l.document_id WHERE a.key = 'p0/n7.md' ORDER BY n.modified_ms DESC, n.key, via LIMIT 100")
over_graph("backlinks_all", links.backlinks, "SELECT a.key AS target, n.key, l.to_key AS via, n.modified_ms FROM names a JOIN links l ON l.to_key = a.alias JOIN notes n ON n.id = l.document_id")
over_graph("backlink_names", lambda x: links.backlink_classes(x)[0], "SELECT DISTINCT alias AS via, key AS target FROM names JOIN links ON to_key = alias")
over_graph("backlink_sources", lambda x: links.backlink_classes(x)[1], "SELECT to_key AS via, n.key, n.modified_ms FROM links l JOIN notes n ON n.id = l.document_id WHERE to_key IN (SELECT alias FROM names)")
over_graph("link_aliases", links.link_aliases, "SELECT alias, key FROM aliases")
over_graph("resolve_edges", links.resolve_edges, "SELECT * FROM edges")
over_index("degrees", links.degrees, "SELECT * FROM degrees")
over_index("graph_nodes", lambda x: links.graph_nodes(x, limit=50), "SELECT * FROM degrees ORDER BY key LIMIT 50")
_PAGE = ", page AS (SELECT key FROM notes ORDER BY key LIMIT 50), e AS (SELECT from_key, link, to_key, dangling FROM edges WHERE from_key IN (SELECT key FROM page) AND (to_key IS NULL OR to_key IN (SELECT key FROM page))) "
over_graph("graph_edges", lambda x: links.graph_edges(x, limit=50), _PAGE + "SELECT * FROM e")
over_graph("graph_totals", lambda x: links.graph_totals(x, limit=50), _PAGE + "SELECT (SELECT count(*) FROM notes) AS total_nodes, (SELECT count(*) FROM page) AS node_count, count(*) AS edge_count, count(*) FILTER (dangling) AS dangling_count FROM edges")
for _mode, _lone in (("isolated", "in_degree = 0 AND out_degree = 0"), ("noIncoming", "in_degree = 0"), ("noOutgoing", "out_degree = 0")):
    over_index(f"orphans_{_mode}", lambda x, m=_mode: links.orphans(x, m), f"SELECT * FROM degrees WHERE {_lone}")
_BOTH = ", r AS (SELECT DISTINCT a, b FROM (SELECT from_key AS a, to_key AS b FROM edges WHERE to_key IS NOT NULL UNION ALL SELECT to_key, from_key FROM edges WHERE to_key IS NOT NULL) AS u), s AS (SELECT key FROM notes WHERE id % 20 = 0), h1 AS (SELECT DISTINCT key AS seed, b AS key FROM s JOIN r ON a = key), h2 AS (SELECT DISTINCT seed, b AS key FROM h1 JOIN r ON a = key) "
over_graph("neighbors", lambda x: links.neighbors(x, x.documents.where("id % 20 = 0").select("key"), 2), _BOTH + "SELECT seed, key, CAST(min(h) AS INTEGER) AS hops FROM (SELECT key AS seed, key, 0 AS h FROM s UNION ALL SELECT seed, key, 1 FROM h1 UNION ALL SELECT seed, key, 2 FROM h2) AS u GROUP BY 1, 2")
over_graph("dangling_links", links.dangling_links, "SELECT from_key, link FROM edges WHERE unresolved")


@query("rename_links", r", m AS (SELECT DISTINCT n.key, n.text FROM notes n JOIN links l ON l.document_id = n.id WHERE l.to_key IN ('p0/n7', 'n7') AND n.key <> 'p0/n7.md') SELECT key, sha256(regexp_replace(text, '\[\[(?:p0/)?n7((?:[#|][^\]\n]*)?)\]\]', '[[moved/seven\1]]', 'g')) AS sha FROM m")
def _rename(spark: SparkSession, sf: str) -> DataFrame:
    o = vault(spark, sf)
    one = o.where("key = 'p0/n7.md'").select(F.col("key").alias("from_key"), F.lit("moved/seven.md").alias("to_key"))
    return links.rename_links(o, index.build_index(o), one).select("key", F.sha2("text", 256).alias("sha"))


# Statistics and completions
_FOLDER = "CASE WHEN contains(key, '/') THEN string_split(key, '/')[1] ELSE '(root)' END AS folder"
over_index("list_documents", stats.list_documents, "SELECT key, etag, modified_ms, size, CASE WHEN ends_with(key, '.txt') THEN 'text/plain; charset=utf-8' ELSE 'text/markdown; charset=utf-8' END AS content_type FROM notes ORDER BY key LIMIT 100")
over_index("recent", stats.recent, "SELECT key, modified_ms, size FROM notes ORDER BY modified_ms DESC, key LIMIT 20")
over_index("folders", stats.folders, f"SELECT {_FOLDER}, count(*) AS count, max(modified_ms) AS last_modified FROM notes GROUP BY 1")
over_index("stats", stats.stats, "SELECT count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size, min(modified_ms) AS oldest, max(modified_ms) AS newest, (SELECT key FROM notes ORDER BY size DESC, key LIMIT 1) AS largest, (SELECT key FROM notes ORDER BY size, key LIMIT 1) AS smallest FROM notes")
over_index("folder_stats", stats.folder_stats, f"SELECT {_FOLDER}, count(*) AS count, CAST(sum(size) AS BIGINT) AS size, max(modified_ms) AS last_modified FROM notes GROUP BY 1")
over_objects("object_stats", stats.object_stats, f"SELECT {_FOLDER}, count(*) AS count, CAST(sum(size) AS BIGINT) AS size, max(modified_ms) AS last_modified FROM objects WHERE NOT starts_with(key, '.mineral/') GROUP BY 1")
over_index("folder_rollup", stats.folder_rollup, "SELECT folder, count(*) AS count, max(modified_ms) AS last_modified FROM (SELECT array_to_string(string_split(key, '/')[1:k], '/') AS folder, modified_ms FROM notes, unnest(range(1, len(string_split(key, '/')))) AS u(k)) AS t GROUP BY 1")
over_index("folder_contents", lambda x: stats.folder_contents(x, "p1"), "SELECT key, size, modified_ms, (SELECT count(*) FROM notes WHERE starts_with(key, 'p1/')) AS count, (SELECT CAST(sum(size) AS BIGINT) FROM notes WHERE starts_with(key, 'p1/')) AS total_size FROM notes WHERE starts_with(key, 'p1/') ORDER BY modified_ms DESC, key LIMIT 100")
over_index("complete_keys", lambda x: stats.complete_keys(x, "N12"), "SELECT key FROM notes WHERE contains(lower(key), 'n12') ORDER BY key LIMIT 50")
over_index("complete_folders", stats.complete_folders, "SELECT DISTINCT string_split(key, '/')[1] AS folder FROM notes WHERE contains(key, '/') ORDER BY folder LIMIT 50")
query("complete_dates", "SELECT DISTINCT regexp_extract(k, '(\\d{4})-?(\\d{2})-?(\\d{2})', 1) || '-' || regexp_extract(k, '(\\d{4})-?(\\d{2})-?(\\d{2})', 2) || '-' || regexp_extract(k, '(\\d{4})-?(\\d{2})-?(\\d{2})', 3) AS date FROM (SELECT 'daily/2026-06-' || (10 + id % 20) || '.md' AS k FROM notes) AS t ORDER BY date DESC LIMIT 50")(
    lambda spark, sf: stats.complete_dates(index.build_index(vault(spark, sf).where(keys.is_indexable(F.col("key"))).withColumn("key", F.concat(F.lit("daily/2026-06-"), (10 + F.col("id") % 20).cast("string"), F.lit(".md")))))
)
query("duplicate_content", "SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id || '.md') AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "")(
    lambda spark, sf: stats.duplicate_content(index.build_index(spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".md")).alias("key"), F.lit("").alias("etag"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("modified_ms"), "text")))
)

# Search
_TOKENS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"
_T = ", t AS (SELECT id, key, title, modified_ms, " + ", ".join(f"{_TOKENS.format(c)} AS {n}" for n, c in (("ti", "title"), ("he", "heading_text"), ("ta", "tag_text"), ("bo", "body"))) + " FROM documents_)"
_C = "len(list_filter({c}, lambda x: x = '{t}'))"
_W = lambda t: "(10.0 * " + _C.format(c="ti", t=t) + " + 4.0 * " + _C.format(c="he", t=t) + " + 2.0 * " + _C.format(c="ta", t=t) + " + " + _C.format(c="bo", t=t) + ")"
_S = lambda k: f"greatest(ln(((SELECT count(*) FROM w) - (SELECT count(*) FROM w WHERE w{k} > 0) + 0.5) / ((SELECT count(*) FROM w WHERE w{k} > 0) + 0.5)), 1e-6) * w{k} * 2.2 / (w{k} + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM w)))"
_ROWS = ", u AS (SELECT id AS document_id, 'title' AS \"column\", ti AS xs FROM t UNION ALL SELECT id, 'headings', he FROM t UNION ALL SELECT id, 'tags', ta FROM t UNION ALL SELECT id, 'body', bo FROM t) "
_postings = lambda x: x.postings.select("document_id", "column", "token", "n", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))
over_index(
    "build_postings", _postings,
    _T + _ROWS + "SELECT document_id, \"column\", token, count(*) AS n, string_agg(CAST(k - 1 AS VARCHAR), ',' ORDER BY k) AS positions FROM (SELECT document_id, \"column\", unnest(xs) AS token, generate_subscripts(xs, 1) AS k FROM u) AS p GROUP BY ALL",
)
_WORDS = "list_filter(string_split_regex(coalesce(body, ''), '\\s+'), lambda x: x <> '')"


def _shown(terms: str) -> str:
    """The snippet of `body` as a scalar subquery: of the windows of 12 words that begin with a match, most terms, most matches, the first."""
    return f"""(SELECT CASE WHEN s > 1 THEN '…' ELSE '' END || array_to_string(ws[s:s + 11], ' ') || CASE WHEN len(ws) > s + 11 THEN '…' ELSE '' END FROM (
  SELECT ws, CASE WHEN len(vs) = 0 THEN 1 ELSE greatest(1, vs[1].a - (12 - (vs[1].z - vs[1].a + 1)) // 2) END AS s FROM (
  SELECT ws, list_sort(list_transform(hs, lambda p: struct_pack(d := -len(list_distinct(list_filter(ts[p:p + 11], lambda x: x <> ''))), n := -len(list_filter(ts[p:p + 11], lambda x: x <> '')), a := p, z := list_max(list_filter(hs, lambda q: q < p + 12))))) AS vs FROM (
  SELECT ws, ts, list_filter(range(1, len(ts) + 1), lambda k: ts[k] <> '') AS hs FROM (SELECT ws, list_transform(ws, lambda x: regexp_extract(lower(x), '^[^a-z0-9]*({terms})\\b', 1)) AS ts FROM (SELECT {_WORDS} AS ws) AS y) AS u) AS v) AS w_) AS z_)"""


_BM = f"SELECT key, title, modified_ms, size, len(ti) + len(he) + len(ta) + len(bo) AS n, {_W('part')} AS w0, {_W('alpha')} AS w1, {_W('t3')} AS w2, body FROM t JOIN (SELECT id, size, body FROM documents_) d USING (id)"
_bm25 = lambda x: search.search_bm25(x, "part alpha NOT t3", limit=40).withColumn("score", F.round("score", 6))
over_index("search_bm25", _bm25, _T + f", w AS ({_BM}) SELECT key, title, modified_ms, size, round(-({_S(0)} + {_S(1)} + {_S(2)}), 6) AS score, {_shown('part|alpha|t3')} AS snippet FROM w WHERE w0 > 0 AND w1 > 0 AND NOT w2 > 0 ORDER BY ({_S(0)} + {_S(1)} + {_S(2)}) DESC, key LIMIT 40")


# The same vault, published in parts: an older state of some notes first, then two batches of changes, which are merged into one segment.
_SEGMENTED: dict[tuple, str] = {}


def segmented(spark: SparkSession, sf: str) -> str:
    key = stamp(spark, sf, "documents")
    if key not in _SEGMENTED:
        now, at = vault(spark, sf), folder(spark, "segments")
        was = now.where("id % 97 <> 5").withColumn("text", F.when(F.col("id") % 100 == 1, F.concat(F.lit("# Was\n\nan older text #old "), "id")).otherwise(F.col("text")))
        later_gone = now.where("id % 50 = 3").select((F.col("id") + 10_000_000_000).alias("id"), F.concat(F.lit("gone/"), "key").alias("key"), "etag", "size", "modified_ms", F.lit("part alpha gone").alias("text"))
        segments.publish_changes(was.unionByName(later_gone), at, indexed_at=INDEXED_AT)
        segments.publish_changes(now.where("id % 100 = 1"), at, indexed_at=INDEXED_AT)
        segments.publish_changes(now.where("id % 97 = 5"), at, later_gone.select("id"), INDEXED_AT)
        segments.merge_segments(spark, at, 2)
        _SEGMENTED[key] = at
    return _SEGMENTED[key]


def over_segments(name: str, f: Callable[[index.Index], DataFrame], sql: str) -> None:
    query(name, sql)(lambda spark, sf: f(segments.read_segments(spark, segmented(spark, sf))))


over_segments("segment_postings", _postings, ORACLES["build_postings"][len(BASE) :])
over_segments("segment_search", _bm25, ORACLES["search_bm25"][len(BASE) :])
over_segments("segment_degrees", links.degrees, "SELECT * FROM degrees")
query("segment_rows", "SELECT publishes, count(*) AS notes, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT '1-1' AS publishes, id FROM notes WHERE id % 97 <> 5 UNION ALL SELECT '1-1', id + 10000000000 FROM notes WHERE id % 50 = 3 UNION ALL SELECT '2-3', id FROM notes WHERE id % 97 = 5 OR id % 100 = 1) AS s GROUP BY 1")(
    lambda spark, sf: segments.segment_rows(spark, segmented(spark, sf)).groupBy("publishes").agg(F.count("*").alias("notes"), F.sum("document_id").alias("ids"))
)
over_index("search_phrase", lambda x: search.search_phrase(x, "心率 徒步", limit=50), "SELECT key, title, modified_ms, size, CAST(10 + (length(body) - length(replace(body, '心率', ''))) // 2 AS BIGINT) AS score, CASE WHEN instr(body, '心率') > 60 THEN '…' ELSE '' END || substr(body, greatest(1, instr(body, '心率') - 60), 150) AS snippet FROM documents_ WHERE contains(body, '心率') AND contains(body, '徒步') ORDER BY score DESC, modified_ms DESC, key LIMIT 50")
over_index("search_filename", lambda x: search.search_filename(x, "N17"), "SELECT key, modified_ms FROM notes WHERE contains(lower(key), 'n17') ORDER BY modified_ms DESC, key LIMIT 20")
_Q = "CASE WHEN stem = 'n1' OR base = 'n1' THEN 'exact' WHEN starts_with(base, 'n1') THEN 'prefix' WHEN contains(base, 'n1') THEN 'substring' WHEN contains(lower(key), 'n1') THEN 'path' END AS quality"
_B = ", b AS (SELECT key, modified_ms, body, title, lower(regexp_extract(key, '([^/]*)$', 1)) AS base, lower(regexp_extract(bare, '([^/]*)$', 1)) AS stem FROM documents_) "
over_index("name_quality", lambda x: x.documents.select("key", search.name_quality(F.col("key"), " N1 ").alias("quality")), _B + f"SELECT key, {_Q} FROM b")


def _merged(x: index.Index) -> DataFrame:
    c = search.placed(x.documents.where("body like '%徒步%'").select("key", "modified_ms").orderBy(F.desc("modified_ms"), "key").limit(30), F.desc("modified_ms"), F.asc("key"))
    return search.merge_search(c, search.placed(search.search_filename(x, "n1", limit=40), F.desc("modified_ms"), F.asc("key")), "n1", 50)


over_index(
    "merge_search", _merged,
    _B + f""", c AS (SELECT key, row_number() OVER (ORDER BY modified_ms DESC, key) AS p FROM (SELECT * FROM b WHERE contains(body, '徒步') ORDER BY modified_ms DESC, key LIMIT 30) AS s),
n AS (SELECT key, quality, row_number() OVER (ORDER BY modified_ms DESC, key) AS p FROM (SELECT key, modified_ms, {_Q} FROM b WHERE contains(lower(key), 'n1') ORDER BY modified_ms DESC, key LIMIT 40) AS s),
m AS (SELECT coalesce(c.key, n.key) AS key, quality, c.p AS cp, n.p AS np, CASE quality WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 WHEN 'substring' THEN 3 WHEN 'path' THEN 4 END AS nt FROM c FULL JOIN n ON c.key = n.key)
SELECT key, CAST(least(coalesce(nt, 9), CASE WHEN cp IS NULL THEN 9 ELSE 2 END) AS INTEGER) AS tier, CASE WHEN nt IS NULL THEN 'content' WHEN cp IS NULL THEN 'name' WHEN nt < 2 THEN 'name,content' ELSE 'content,name' END AS matched, quality
FROM m ORDER BY 2, cp IS NULL, coalesce(cp, np), key LIMIT 50""",
)
over_index(
    "search", lambda x: search.search(x, "n1", limit=40),
    _T + f""", b AS (SELECT id, key, size, body, bare, lower(regexp_extract(key, '([^/]*)$', 1)) AS base, lower(regexp_extract(bare, '([^/]*)$', 1)) AS stem FROM documents_),
w AS (SELECT key, title, modified_ms, size, len(ti) + len(he) + len(ta) + len(bo) AS n, {_W('n1')} AS w0, body FROM t JOIN (SELECT id, size, body FROM documents_) d USING (id)),
c AS (SELECT *, row_number() OVER (ORDER BY score, key) AS p FROM (SELECT key, -({_S(0)}) AS score, {_shown('n1')} AS snippet FROM w WHERE w0 > 0 ORDER BY 2, key LIMIT 40) AS s),
n AS (SELECT key, quality, row_number() OVER (ORDER BY modified_ms DESC, key) AS p FROM (SELECT b.key, modified_ms, {_Q.replace('lower(key)', 'lower(b.key)')} FROM b JOIN t USING (id) WHERE contains(lower(b.key), 'n1') ORDER BY modified_ms DESC, b.key LIMIT 40) AS s),
m AS (SELECT coalesce(c.key, n.key) AS key, quality, c.p AS cp, n.p AS np, c.snippet, CASE quality WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 WHEN 'substring' THEN 3 WHEN 'path' THEN 4 END AS nt FROM c FULL JOIN n ON c.key = n.key),
r AS (SELECT key, CAST(least(coalesce(nt, 9), CASE WHEN cp IS NULL THEN 9 ELSE 2 END) AS INTEGER) AS tier, CASE WHEN nt IS NULL THEN 'content' WHEN cp IS NULL THEN 'name' WHEN nt < 2 THEN 'name,content' ELSE 'content,name' END AS matched, quality, snippet FROM m ORDER BY 2, cp IS NULL, coalesce(cp, np), key LIMIT 40)
SELECT r.key, tier, matched, quality, w.title, w.modified_ms, w.size, r.snippet FROM r JOIN w ON w.key = r.key""",
)
over_index("term_snippet", lambda x: x.documents.select("key", search.term_snippet(F.col("body"), ["part"]).alias("snippet")), f"SELECT key, {_shown('part')} AS snippet FROM documents_")

from . import registry_work  # noqa: E402, F401  (registers the rest)

__all__ = ["ORACLES", "QUERIES", "journal"]
