"""Note-shaped tables derived from the given ones, by SQL that Spark and DuckDB both run.

documents become a vault of notes (frontmatter, headings, tags, links, some CJK, system keys, binaries), events a mutation journal.
Everything is integer arithmetic on ids, so the tables grow with the inputs and need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteloom.sources.io import spread

VAULT = """
SELECT doc_id AS id, key, md5(text) AS etag, CAST(bit_length(text) / 8 AS BIGINT) AS size, 1704067200000 + ((doc_id * 37) % 100000) * 60000 AS modified_ms, text FROM (
SELECT doc_id, key,
  CASE WHEN doc_id % 3 <> 2 THEN '---' || chr(10) || 'title: Note ' || doc_id || chr(10)
    || 'tags: [alpha, t' || (doc_id % 9) || ', area/a' || (doc_id % 4) || ']' || chr(10)
    || 'status: ' || CASE WHEN doc_id % 2 = 0 THEN 'draft' ELSE 'done' END || chr(10) || 'rank: ' || (doc_id % 6) || chr(10) || '---' || chr(10) ELSE '' END
  || '# Heading ' || doc_id || chr(10) || chr(10) || raw || chr(10) || chr(10) || '## Part b' || chr(10) || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'see [[p0/n' || ((doc_id * 7) % 50) || ']] and [[n' || ((doc_id * 3) % 40) || '|alias]] ' END
  || CASE WHEN doc_id % 10 = 1 THEN '[[missing' || (doc_id % 20) || ']] [[p0/n' || (doc_id % 30) || '.md#h]] ' ELSE '' END
  || '#t' || (doc_id % 9) || ' #t' || (doc_id % 9) || ' #Beta' || chr(10)
  || CASE WHEN doc_id % 6 = 0 THEN '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN '今天查看心率的工具。' || chr(10) WHEN doc_id % 4 = 1 THEN '麦理浩径徒步记录，心率稳定。' || chr(10) ELSE '' END AS text
FROM (SELECT doc_id, coalesce(text, '') AS raw, CAST(floor(doc_id / 200) AS BIGINT) AS p, doc_id % 200 AS n,
  CASE WHEN doc_id % 50 = 49 THEN '.mineral/versions/v' || doc_id || '/content/p' || CAST(floor(doc_id / 200) AS BIGINT) || '/n' || (doc_id % 200) || '.md'
       WHEN doc_id % 50 = 48 THEN 'assets/img' || doc_id || '.png'
       WHEN doc_id % 50 = 47 THEN 'ui/panel' || doc_id || '.ui.md'
       WHEN doc_id % 11 = 0  THEN 'root' || doc_id || '.md'
       ELSE 'p' || CAST(floor(doc_id / 200) AS BIGINT) || '/n' || (doc_id % 200) || CASE WHEN doc_id % 13 = 0 THEN '.mdx' WHEN doc_id % 17 = 0 THEN '.txt' ELSE '.md' END END AS key
  FROM documents) AS k) AS t
"""

JOURNAL = """
SELECT event_id + 1 AS seq, 'm' || (event_id - CASE WHEN event_id % 20 = 19 THEN 1 ELSE 0 END) AS mutation_id,
  CASE event_id % 4 WHEN 0 THEN 'obsidian' WHEN 1 THEN 'web' WHEN 2 THEN 'mcp' ELSE 'system' END AS source,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'put' END AS op,
  CASE WHEN event_type = 'purchase' THEN 'p1/n' ELSE 'p0/n' END || (user_id % 200) || '.md' AS path,
  CASE WHEN event_type = 'purchase' THEN 'p0/n' || (user_id % 200) || '.md' END AS from_path,
  CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN NULL ELSE md5('e' || event_id) END AS etag,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_id * 3 END AS size,
  1704067200000 + event_id * 1000 AS committed_at
FROM events
"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VAULT.replace("FROM documents)", "FROM {docs})"), docs=spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOURNAL.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id"))


#: DuckDB's view of the same: objects, notes and the index tables.
_INDEXABLE = r"regexp_matches(lower(key), '\.(md|txt|markdown|mdx)$') AND NOT starts_with(key, '.mineral/') AND NOT starts_with(key, '.mineral-sync/') AND NOT starts_with(key, '.system/') AND NOT starts_with(key, '.history/') AND NOT starts_with(key, '.trash/') AND NOT ends_with(key, '.ui.md')"
_BLOCK, _HEAD = r"'^---\r?\n([\s\S]*?)\r?\n---\r?\n?'", r"'^(#{1,6})\s+(.+?)\s*#*\s*$'"
BASE = rf"""WITH objects AS (SELECT * FROM ({VAULT}) AS v),
notes AS (SELECT id, key, etag, size, modified_ms, text, sha256(text) AS content_sha256, CASE WHEN regexp_matches(text, {_BLOCK}) THEN regexp_extract(text, {_BLOCK}, 1) END AS yaml,
  substr(text, length(regexp_extract(text, {_BLOCK}, 0)) + 1) AS body, regexp_replace(key, '(?i)\.(md|markdown|mdx|txt)$', '') AS bare FROM objects WHERE {_INDEXABLE}),
lines AS (SELECT id, k, xs[k] AS x FROM (SELECT id, string_split_regex(body, '\r?\n') AS xs FROM notes) AS s, unnest(range(1, len(xs) + 1)) AS u(k)),
fenced AS (SELECT id, k, x, regexp_matches(x, '^\s*(`{{3,}}|~{{3,}})') AS f, sum(CASE WHEN regexp_matches(x, '^\s*(`{{3,}}|~{{3,}})') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS n FROM lines),
headings AS (SELECT id AS document_id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS ordinal, CAST(length(regexp_extract(x, {_HEAD}, 1)) AS INTEGER) AS level, trim(regexp_extract(x, {_HEAD}, 2)) AS text, CAST(k AS INTEGER) AS line
  FROM fenced WHERE NOT f AND n % 2 = 0 AND regexp_matches(x, {_HEAD})),
front AS (SELECT id AS document_id, f.field, CASE f.field WHEN 'tags' THEN '["' || replace(regexp_extract(yaml, '(?m)^tags: \[(.*)\]$', 1), ', ', '","') || '"]' ELSE regexp_extract(yaml, '(?m)^' || f.field || ': (.*)$', 1) END AS value
  FROM notes, (VALUES ('title'), ('tags'), ('status'), ('rank')) AS f(field) WHERE yaml IS NOT NULL),
tags AS (SELECT document_id, tag, source, count(*) AS occurrences, min(o) AS o FROM (
  SELECT document_id, unnest(ts) AS tag, source, generate_subscripts(ts, 1) AS o FROM (SELECT id AS document_id, string_split(regexp_extract(yaml, '(?m)^tags: \[(.*)\]$', 1), ', ') AS ts, 'frontmatter' AS source FROM notes WHERE yaml IS NOT NULL
  UNION ALL SELECT id, list_transform(regexp_extract_all(body, '(?:^|\s)(#[\w一-龥/-]+)', 1), lambda t: ltrim(t, '#')), 'body' FROM notes) AS l) AS t WHERE tag <> '' GROUP BY document_id, tag, source),
links AS (SELECT DISTINCT document_id, to_key FROM (SELECT id AS document_id, trim(unnest(regexp_extract_all(body, '\[\[([^\]\n|#]+)(?:[#|][^\]\n]*)?\]\]', 1))) AS to_key FROM notes) AS l),
documents_ AS (SELECT n.*, coalesce(nullif(trim(regexp_extract(yaml, '(?m)^title: (.*)$', 1)), ''), (SELECT min_by(h.text, h.ordinal) FROM headings h WHERE h.document_id = n.id AND h.level = 1), regexp_extract(bare, '([^/]*)$', 1)) AS title,
  coalesce((SELECT string_agg(h.text, chr(10) ORDER BY h.ordinal) FROM headings h WHERE h.document_id = n.id), '') AS heading_text, coalesce((SELECT string_agg(t.tag, ' ' ORDER BY t.source DESC, t.o) FROM tags t WHERE t.document_id = n.id), '') AS tag_text FROM notes n),
names AS (SELECT DISTINCT key, alias FROM (SELECT key, key AS alias FROM notes UNION ALL SELECT key, bare FROM notes UNION ALL SELECT key, regexp_extract(bare, '([^/]*)$', 1) FROM notes) AS a),
aliases AS (SELECT alias, max(key) AS key FROM names GROUP BY alias),
edges AS (SELECT n.key AS from_key, l.to_key AS link, coalesce(a.key, b.key) AS to_key, a.key IS NULL AS dangling, coalesce(a.key, b.key) IS NULL AS unresolved FROM links l JOIN notes n ON n.id = l.document_id
  LEFT JOIN aliases a ON a.alias = l.to_key LEFT JOIN aliases b ON b.alias = regexp_replace(l.to_key, '(?i)\.(md|markdown|mdx|txt)$', '')),
degrees AS (SELECT d.key, d.title, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree FROM documents_ d LEFT JOIN (SELECT from_key, count(*) AS n FROM edges GROUP BY 1) o ON o.from_key = d.key
  LEFT JOIN (SELECT to_key, count(*) AS n FROM edges WHERE to_key IS NOT NULL GROUP BY 1) i ON i.to_key = d.key)
"""
JBASE = f"WITH journal AS (SELECT * FROM ({JOURNAL}) AS j)"
