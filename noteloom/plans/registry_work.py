"""Registered queries: journal, audit, vectors, recovery, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import keys, text
from noteloom.operators import audit, index, recovery, vector_index, vectors
from noteloom.operators import journal as J
from noteloom.sources import io, segments
from noteloom.sources.shared import folder, stored
from noteloom.streaming import journal as streams

from .derived import BASE, JBASE, VAULT, journal, vault
from .registry import over_objects, query, stamp

NOW = 1704067200000 + 4_000_000


def over_journal(name, f, sql=None):
    query(name, sql, JBASE)(lambda spark, sf: f(journal(spark, sf)))


# Journal
_SPOILED = lambda j: j.withColumn("mutation_id", F.when(F.col("seq") % 31 == 0, "").otherwise(F.col("mutation_id"))).withColumn("source", F.when(F.col("seq") % 29 == 0, "cli").otherwise(F.col("source"))).withColumn("path", F.when(F.col("seq") % 23 == 0, "../x").otherwise(F.col("path"))).withColumn("size", F.when(F.col("seq") % 19 == 0, -1).otherwise(F.col("size")))
over_journal("validate_events", lambda j: J.validate_events(_SPOILED(j)).select("seq", "error"), " SELECT seq, CASE WHEN seq % 31 = 0 THEN 'id' WHEN seq % 29 = 0 THEN 'source' WHEN seq % 23 = 0 THEN 'path' WHEN op = 'put' AND seq % 19 = 0 THEN 'revision' END AS error FROM journal")
_FIRST = ", f AS (SELECT * FROM journal QUALIFY row_number() OVER (PARTITION BY mutation_id ORDER BY seq) = 1)"
over_journal("record_mutations", lambda j: J.record_mutations(j.where("seq <= 1000"), j.where("seq > 500").withColumnRenamed("seq", "arrival")).select("seq", "mutation_id", "op", "path"), ", n AS (SELECT * FROM journal WHERE seq > 500 QUALIFY row_number() OVER (PARTITION BY mutation_id ORDER BY seq) = 1) SELECT (SELECT coalesce(max(seq), 0) FROM journal WHERE seq <= 1000) + row_number() OVER (ORDER BY seq) AS seq, mutation_id, op, path FROM n WHERE mutation_id NOT IN (SELECT mutation_id FROM journal WHERE seq <= 1000)")
_INTENTS = """, i AS (SELECT path, CASE WHEN op = 'delete' THEN 'remove' ELSE 'upsert' END AS action, CASE WHEN op <> 'delete' THEN etag END AS target_etag, source, committed_at + CASE WHEN source = 'obsidian' AND op = 'put' THEN 30000 ELSE 0 END AS not_before, committed_at AS "at", seq, CASE WHEN op = 'rename' THEN 1 ELSE 0 END AS part FROM journal
UNION ALL SELECT from_path, 'remove', NULL, source, committed_at, committed_at, seq, 0 FROM journal WHERE op = 'rename')"""
_DIRTY = _INTENTS + """, dirty AS (SELECT path, arg_max(action, seq * 2 + part) AS action, CASE WHEN arg_max(action, seq * 2 + part) = 'upsert' THEN arg_max(target_etag, seq * 2 + part) END AS target_etag, arg_max(source, seq * 2 + part) AS source, max(not_before) AS not_before, arg_min("at", seq * 2 + part) AS first_dirty_at, arg_max("at", seq * 2 + part) AS updated_at, max(seq) AS seq, 0 AS attempts FROM i GROUP BY path)"""
_dirty = lambda j: J.coalesce_intents(J.intents_for(j))
over_journal("intents_for", J.intents_for, _INTENTS + ' SELECT path, action, target_etag, source, not_before, "at", seq, part FROM i')
over_journal("coalesce_intents", _dirty, _DIRTY + " SELECT * FROM dirty")
over_journal("pending_summary", lambda j: J.pending_summary(_dirty(j), NOW), _DIRTY + f" SELECT count(*) FILTER (not_before <= {NOW}) AS due, count(*) FILTER (action = 'upsert') AS upserts, count(*) FILTER (action = 'remove') AS removes, min(not_before) AS earliest FROM dirty")
over_journal("due_paths", lambda j: J.due_paths(_dirty(j), NOW * 2), _DIRTY + " SELECT * FROM dirty ORDER BY updated_at, path LIMIT 16")


def _outcomes(d: DataFrame) -> DataFrame:
    return d.where("seq % 3 > 0").select("path", F.when(F.col("seq") % 11 == 0, "remove").otherwise(F.col("action")).alias("action"), "target_etag", (F.col("updated_at") - F.when(F.col("seq") % 7 == 0, 1).otherwise(0)).alias("started_at"), (F.col("seq") % 3 == 1).alias("ok"), F.repeat(F.lit("x"), F.lit(300)).alias("error"), (F.col("not_before") + 5000).alias("retry_at"))


over_journal(
    "settle_intents", lambda j: J.settle_intents(d := _dirty(j), _outcomes(d)),
    _DIRTY + """, s AS (SELECT *, seq % 3 > 0 AND NOT (seq % 11 = 0 AND action = 'upsert') AND seq % 7 <> 0 AS same FROM dirty)
SELECT path, action, target_etag, source, CASE WHEN same AND seq % 3 = 2 THEN not_before + 5000 ELSE not_before END AS not_before, first_dirty_at, updated_at, seq, CASE WHEN same AND seq % 3 = 2 THEN 1 ELSE 0 END AS attempts, CASE WHEN same AND seq % 3 = 2 THEN repeat('x', 200) END AS last_error FROM s WHERE NOT (same AND seq % 3 = 1)""",
)
over_journal("journal_state", J.journal_state, " SELECT count(*) AS total, count(*) AS pending, CAST(0 AS BIGINT) AS published, count(*) FILTER (source = 'mcp') AS from_mcp, count(*) FILTER (source = 'web') AS from_web, count(*) FILTER (source = 'obsidian') AS from_obsidian, count(*) FILTER (source = 'system') AS from_system, max(seq) AS last_seq, arg_max(mutation_id, seq) AS last_id FROM journal")
_LAST = ", e AS (SELECT path, op, etag, seq, committed_at FROM journal WHERE seq <= {0} UNION ALL SELECT from_path, 'renamed', NULL, seq, committed_at FROM journal WHERE op = 'rename' AND seq <= {0}), d AS (SELECT path, etag, seq, committed_at FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1 AND op = 'delete' AND etag IS NOT NULL)"
over_journal("deletion_index", J.deletion_index, _LAST.format(1 << 60) + " SELECT * FROM d")
over_journal("deletion_page", lambda j: J.deletion_index(j, 8000, "p0/n2", 5), _LAST.format(8000) + " SELECT *, (SELECT count(*) FROM d WHERE path > 'p0/n2') > 5 AS has_more FROM d WHERE path > 'p0/n2' ORDER BY path LIMIT 5")
_outbox = lambda j: j.select("seq", "mutation_id", "path", F.when(F.col("seq") % 4 == 0, "published").otherwise("pending").alias("broadcast"), F.when(F.col("seq") % 4 == 0, F.col("seq") * 10).alias("generation"), F.lit(1).alias("attempts"))
_OUT = ", o AS (SELECT seq, mutation_id, path, CASE WHEN seq % 4 = 0 THEN 'published' ELSE 'pending' END AS broadcast, CASE WHEN seq % 4 = 0 THEN seq * 10 END AS generation, 1 AS attempts FROM journal)"
over_journal("pending_broadcasts", lambda j: J.pending_broadcasts(_outbox(j)), _OUT + " SELECT * FROM o WHERE broadcast = 'pending' ORDER BY seq LIMIT 8")
over_journal("mark_broadcasts", lambda j: J.mark_broadcasts(_outbox(j), j.where("seq % 3 = 0").select("mutation_id", F.when(F.col("seq") % 2 == 0, F.col("seq") + 7).alias("generation"))), _OUT + ", r AS (SELECT mutation_id, min(CASE WHEN seq % 2 = 0 THEN seq + 7 END) AS g FROM journal WHERE seq % 3 = 0 GROUP BY 1), t AS (SELECT o.*, r.mutation_id IS NOT NULL AND broadcast = 'pending' AS tried, g FROM o LEFT JOIN r USING (mutation_id)) SELECT seq, mutation_id, path, CASE WHEN tried AND g IS NOT NULL THEN 'published' ELSE broadcast END AS broadcast, CASE WHEN tried AND g IS NOT NULL THEN coalesce(generation, g) ELSE generation END AS generation, attempts + CASE WHEN tried THEN 1 ELSE 0 END AS attempts FROM t")
_GEN = ", m AS (SELECT path AS channel, CASE WHEN seq % 13 > 0 THEN mutation_id END AS mutation_id, seq AS arrival FROM journal), k AS (SELECT *, min(arrival) OVER (PARTITION BY channel, coalesce(mutation_id, 'a' || arrival)) AS f FROM m)"
over_journal("assign_generations", lambda j: J.assign_generations(j.select(F.col("path").alias("channel"), F.when(F.col("seq") % 13 > 0, F.col("mutation_id")).alias("mutation_id"), F.col("seq").alias("arrival"))), _GEN + " SELECT channel, mutation_id, arrival, CAST(dense_rank() OVER (PARTITION BY channel ORDER BY f) AS BIGINT) AS generation FROM k")
_marks = lambda j: j.select(F.col("path").alias("channel"), F.when(F.col("seq") % 13 > 0, F.col("mutation_id")).alias("mutation_id"), F.col("seq").alias("arrival"))


def _generations_later(j: DataFrame) -> DataFrame:
    """The second half of the marks, after the first half was given its generations."""
    half = j.agg((F.max("seq") / 2).cast("long").alias("half"))  # one row
    marks = _marks(j).join(F.broadcast(half))
    before = J.assign_generations(marks.where("arrival <= half").drop("half"))
    return J.assign_generations(marks.where("arrival > half").drop("half"), before)


over_journal("assign_generations_later", _generations_later, _GEN + " SELECT channel, mutation_id, arrival, generation FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY channel ORDER BY f) AS BIGINT) AS generation FROM k) AS g WHERE arrival > (SELECT max(seq) // 2 FROM journal)")
over_journal("valid_report", lambda j: (e := _SPOILED(j)).select("seq", keys.valid_report({c: F.col(c) for c in e.columns}).alias("valid")), " SELECT seq, seq % 31 <> 0 AND seq % 23 <> 0 AND (op <> 'put' OR seq % 19 <> 0) AND op IN ('put', 'delete') AS valid FROM journal")
over_journal("gateway_changes", J.gateway_changes, " SELECT seq, mutation_id, CASE WHEN op = 'delete' THEN 'delete' ELSE 'put' END AS change, path, CASE WHEN op <> 'delete' THEN etag END AS etag FROM journal")
_digits = lambda c: F.when(F.col("seq") % 17 == 0, "01").when(F.col("seq") % 19 == 0, "x").otherwise(F.concat(F.lit("9007199254740993"), (F.col("seq") * c % 1000 + 1000).cast("string")))
_GENS = "CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 19 = 0 THEN NULL ELSE CAST('9007199254740993' || (seq * {} % 1000 + 1000) AS HUGEINT) END"
over_journal("fold_cursor", lambda j: J.fold_cursor(j.select(F.col("path").alias("client"), _digits(7).alias("generation")), j.where("seq % 2 = 0").select(F.col("path").alias("client"), _digits(3).alias("generation"))), f", a AS (SELECT path AS client, max({_GENS.format(7)}) AS a, max(CASE WHEN seq % 2 = 0 THEN {_GENS.format(3)} END) AS c FROM journal GROUP BY 1) SELECT client, CAST(coalesce(a, 0) AS VARCHAR) AS highest_announced, CAST(coalesce(c, 0) AS VARCHAR) AS last_reconciled, coalesce(a > coalesce(c, 0), FALSE) AS pending FROM a")
over_journal("drop_remote_apply", lambda j: J.drop_remote_apply(j.withColumn("origin", F.when(F.col("seq") % 5 == 0, "remote-apply"))).where(keys.ingress_allowed(F.col("source"))).select("seq", "source"), " SELECT seq, source FROM journal WHERE seq % 5 <> 0 AND source IN ('obsidian', 'web')")


@query(
    "verify_reports",
    ", j AS (SELECT * FROM (" + JBASE[len("WITH journal AS (SELECT * FROM (") :].rsplit(") AS j)", 1)[0] + """) AS j0), r AS (SELECT j.seq, j.mutation_id, j.op, CASE WHEN j.seq % 3 = 0 THEN o.etag ELSE j.etag END AS etag, o.etag AS now FROM j LEFT JOIN objects o ON o.key = j.path WHERE j.op <> 'rename'),
h AS (SELECT *, CASE WHEN op = 'delete' THEN now IS NULL ELSE coalesce(etag = now, FALSE) END AS holds FROM r), f AS (SELECT *, min(CASE WHEN holds THEN seq END) OVER (PARTITION BY mutation_id) AS first_ FROM h)
SELECT seq, CASE WHEN mutation_id IN (SELECT mutation_id FROM j WHERE seq <= 2000) OR coalesce(seq > first_, FALSE) THEN 'duplicate' WHEN holds THEN 'accepted' ELSE 'state-mismatch' END AS verdict FROM f""",
)
def _verify(spark: SparkSession, sf: str) -> DataFrame:
    o, j = vault(spark, sf), journal(spark, sf)
    now = o.select(F.col("key").alias("path"), F.concat(F.lit('"'), "etag", F.lit('"')).alias("quoted"))
    reports = j.where("op <> 'rename'").join(now, "path", "left").withColumn("etag", F.when(F.col("seq") % 3 == 0, F.col("quoted")).otherwise(F.col("etag"))).drop("quoted")
    return J.verify_reports(reports, o, j.where("seq <= 2000")).select("seq", "verdict")


# Audit: an index that has drifted from the listing
STARTED = 1704067200000 + 5_000_000


def drifted(o: DataFrame) -> DataFrame:
    notes = o.where(keys.is_indexable(F.col("key")))
    own = notes.where("id % 29 <> 0").select("key", F.when(F.col("id") % 23 == 0, "old").otherwise(F.col("etag")).alias("indexed_etag"), F.when(F.col("id") % 19 == 0, 0).otherwise(1).alias("index_version"), F.lit(STARTED - 1).alias("indexed_at"))
    gone = notes.where("id % 31 = 0").select(F.concat(F.lit("gone/"), "key"), "etag", F.lit(1), F.when(F.col("id") % 2 == 0, STARTED - 1).otherwise(STARTED + 1))
    return own.union(gone)


_DRIFT = f""", d AS (SELECT key, CASE WHEN id % 23 = 0 THEN 'old' ELSE etag END AS indexed_etag, CASE WHEN id % 19 = 0 THEN 0 ELSE 1 END AS index_version, {STARTED - 1} AS indexed_at FROM notes WHERE id % 29 <> 0
UNION ALL SELECT 'gone/' || key, etag, 1, CASE WHEN id % 2 = 0 THEN {STARTED - 1} ELSE {STARTED + 1} END FROM notes WHERE id % 31 = 0),
b AS (SELECT coalesce(n.key, d.key) AS key, n.key IS NOT NULL AS listed, d.key IS NOT NULL AS indexed, n.etag, d.indexed_etag, d.index_version, d.indexed_at FROM notes n FULL JOIN d ON d.key = n.key),
u AS (SELECT key AS path, CASE WHEN listed AND (NOT indexed OR etag <> indexed_etag) THEN 'upsert' WHEN NOT listed AND indexed_at < {STARTED} THEN 'remove' END AS action, etag FROM b)"""
over_objects("freshness_report", lambda o: audit.freshness_report(o, drifted(o)), _DRIFT + " SELECT key, CASE WHEN NOT indexed THEN 'missing' WHEN NOT listed THEN 'absent' WHEN etag <> indexed_etag THEN 'stale' WHEN index_version <> 1 THEN 'outdated' ELSE 'fresh' END AS state FROM b")
over_objects("audit_diff", lambda o: audit.audit_diff(o, drifted(o), STARTED), _DRIFT + f" SELECT path, action, CASE WHEN action = 'upsert' THEN etag END AS target_etag, 'system' AS source, {STARTED} AS not_before FROM u WHERE action IS NOT NULL")
over_objects("audit_report", lambda o: audit.audit_report(o, drifted(o), STARTED, worked=o.where("id % 3 = 0").select(F.col("key").alias("path"))), _DRIFT + " SELECT CAST(ceil((SELECT count(*) FROM objects) / 200.0) AS BIGINT) AS pages, (SELECT count(*) FROM notes) AS scanned, count(*) FILTER (action = 'upsert') AS enqueued, count(*) FILTER (action = 'remove') AS removed, count(*) FILTER (action IS NOT NULL AND path IN (SELECT key FROM objects WHERE id % 3 = 0)) AS applied, count(*) FILTER (action IS NOT NULL AND path NOT IN (SELECT key FROM objects WHERE id % 3 = 0)) AS pending FROM u")


@query("apply_index_intents", _DRIFT + ", j AS (" + JBASE[len("WITH journal AS (SELECT * FROM (") :].rsplit(") AS j)", 1)[0] + "), i AS (SELECT path, max(CASE WHEN op = 'delete' THEN 'remove' ELSE 'upsert' END) AS action FROM j GROUP BY 1) SELECT i.path, i.action, CASE WHEN n.key IS NULL AND d.key IS NULL THEN 'noop' WHEN n.key IS NULL THEN 'removed' WHEN n.etag = d.indexed_etag AND d.index_version = 1 THEN 'noop' ELSE 'indexed' END AS outcome FROM i LEFT JOIN notes n ON n.key = i.path LEFT JOIN d ON d.key = i.path")
def _apply(spark: SparkSession, sf: str) -> DataFrame:
    o, j = vault(spark, sf), journal(spark, sf)
    return audit.apply_index_intents(j.groupBy("path").agg(F.max(F.when(F.col("op") == "delete", "remove").otherwise("upsert")).alias("action")), o, drifted(o))


# Chunks and vectors
over_objects("path_digests", lambda o: o.select("key", text.path_digest(F.col("key")).alias("path_digest"), text.tombstone_name(F.col("key"), F.col("etag")).alias("tombstone")), " SELECT key, rtrim(replace(replace(to_base64(unhex(substr(sha256(key), 1, 16))), '+', '-'), '/', '_'), '=') AS path_digest, rtrim(replace(replace(to_base64(unhex(sha256(key || chr(0) || etag))), '+', '-'), '/', '_'), '=') AS tombstone FROM objects")
#: Chunks, by the rules of the chunker: sections between headings, paragraphs, windows of long ones, packs.
_CH = r""", marks AS (SELECT id AS document_id, 0 AS line, title AS heading FROM documents_ UNION ALL SELECT document_id, line, text FROM headings),
spans_ AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY document_id ORDER BY line), 1000000000) AS after FROM marks),
sections AS (SELECT s.document_id, s.line, heading, string_agg(l.x, chr(10) ORDER BY l.k) AS t FROM spans_ s JOIN lines l ON l.id = s.document_id AND l.k > s.line AND l.k < s.after GROUP BY 1, 2, 3),
paragraphs AS (SELECT document_id, line, heading, list_filter(list_transform(string_split_regex(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM sections),
pieces AS (SELECT document_id, line, heading, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 1500 THEN [p] ELSE list_transform(range(0, length(p), 1350), lambda i: substr(p, CAST(i AS BIGINT) + 1, 1500)) END)) AS ps FROM paragraphs WHERE len(ps) > 0),
packs AS (SELECT document_id, line, heading, list_reduce(list_transform(ps, lambda p: {'done': CAST([] AS VARCHAR[]), 'open': p}), lambda a, b: CASE WHEN length(a.open) + 2 + length(b.open) > 1000
  THEN {'done': list_append(a.done, a.open), 'open': substr(right(a.open, 150) || chr(10) || chr(10) || b.open, 1, 1500)} ELSE {'done': a.done, 'open': a.open || chr(10) || chr(10) || b.open} END) AS r FROM pieces),
cut AS (SELECT document_id, line, heading, i, regexp_replace(list_append(r.done, r.open)[i], '^\s+|\s+$', '', 'g') AS text FROM packs, unnest(range(1, len(r.done) + 2)) AS u(i)),
numbered AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY line, i) - 1 AS INTEGER) AS ordinal, heading, text FROM cut WHERE text <> ''
  UNION ALL SELECT id, 0, title, title FROM documents_ WHERE id NOT IN (SELECT document_id FROM cut WHERE text <> '')),
chunks AS (SELECT substr(replace(replace(to_base64(unhex(sha256('mineral-vector-chunk-v1|' || length(CAST(id AS VARCHAR)) || ':' || id || '|64:' || content_sha256 || '|1:1|10:hash-embed|1:1|' || length(CAST(ordinal AS VARCHAR)) || ':' || ordinal))), '+', '-'), '/', '_'), 1, 32) AS chunk_id,
  document_id, content_sha256, ordinal, heading, c.text, title FROM numbered c JOIN documents_ d ON d.id = c.document_id) """
over_objects("chunk_ids", lambda o: vectors.chunk_documents(index.parse_documents(o)).select("document_id", "ordinal", "chunk_id"), _CH + "SELECT document_id, ordinal, chunk_id FROM chunks")
over_objects("chunk_documents", lambda o: vectors.chunk_documents(index.parse_documents(o)).drop("tags"), _CH + "SELECT * FROM chunks")
over_objects("embedding_text", lambda o: vectors.chunk_documents(index.parse_documents(o)).select("chunk_id", F.sha2(vectors.embedding_text(F.col("title"), F.col("heading"), F.array_sort("tags"), F.col("text")), 256).alias("sha")), _CH + r", named AS (SELECT document_id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM tags GROUP BY 1) SELECT chunk_id, sha256('Title: ' || title || chr(10) || 'Heading: ' || heading || chr(10) || coalesce('Tags: ' || tags || chr(10), '') || chr(10) || text) AS sha FROM chunks LEFT JOIN named USING (document_id)")


def _chunked(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = index.parse_documents(o)
    documents = parsed.select("id", "key", F.col("etag").alias("indexed_etag"), "content_sha256", "title", "body")
    return documents, vectors.chunk_documents(parsed)


def _ledger(o: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, ledger, state: some documents published with an older text, a missing ledger row, or another chunker."""
    documents, chunks = _chunked(o)
    ledger = chunks.where("not (document_id % 29 = 0 and ordinal = 0)").withColumn("content_sha256", F.when(F.col("document_id") % 23 == 0, "old").otherwise(F.col("content_sha256")))
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("active_chunks"))
    state = documents.where("id % 31 <> 0").join(counted, F.col("id") == F.col("document_id")).select(
        "document_id", F.when(F.col("id") % 17 == 0, "pending").when(F.col("id") % 37 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("id") % 23 == 0, "old").otherwise(F.col("content_sha256")).alias("active_sha256"),
        F.when(F.col("id") % 19 == 0, 0).otherwise(1).alias("active_chunker"), F.lit(vectors.MODEL).alias("active_model"), F.lit(1).alias("active_version"), "active_chunks",
        F.when((F.col("id") % 17 != 0) & (F.col("id") % 37 == 0), F.concat(F.lit("model timed out on "), "id")).alias("last_error"), (F.col("id") * 7 % 1000).alias("updated_at"),
    )
    return documents, ledger.select("chunk_id", "document_id", "content_sha256", "ordinal", "heading", "text"), state


_STALE = "(id % 31 = 0 OR id % 17 = 0 OR id % 37 = 0 OR id % 23 = 0 OR id % 19 = 0)"
over_objects("stale_vectors", lambda o: vectors.stale_vectors((x := _ledger(o))[0], x[2]), f" SELECT id, key FROM notes WHERE {_STALE}")
_LEDGER = _CH + """, ledger AS (SELECT chunk_id, document_id, CASE WHEN document_id % 23 = 0 THEN 'old' ELSE content_sha256 END AS content_sha256, ordinal, heading, text FROM chunks WHERE NOT (document_id % 29 = 0 AND ordinal = 0)) """
_PLACE = "chunk_id, document_id, content_sha256, ordinal"
_placed = lambda df: df.select("chunk_id", "document_id", "content_sha256", "ordinal")
over_objects("stale_ledger", lambda o: _placed(vectors.stale_ledger((x := _ledger(o))[1], x[2])), _LEDGER + f"SELECT {_PLACE} FROM ledger WHERE document_id % 31 = 0")
over_objects("collect_garbage", lambda o: _placed(vectors.collect_garbage((x := _ledger(o))[1], x[2])), _LEDGER + f"SELECT {_PLACE} FROM ledger WHERE document_id % 31 <> 0")
over_objects("plan_vector_publish", lambda o: vectors.plan_vector_publish(o.select(F.col("key").alias("path"), F.when(F.col("id") % 13 == 0, "remove").otherwise("upsert").alias("action"), F.when(F.col("id") % 7 == 0, "moved").otherwise(F.col("etag")).alias("target_etag")), *(x := _ledger(o))[::2]), f" SELECT o.key AS path, CASE WHEN o.id % 13 = 0 THEN 'removed' WHEN n.key IS NULL OR o.id % 7 = 0 THEN 'deferred' WHEN NOT {_STALE.replace('id %', 'o.id %')} THEN 'noop' ELSE 'published' END AS outcome FROM objects o LEFT JOIN notes n ON n.key = o.key")
_published = lambda o: vectors.publish_vectors((x := _ledger(o))[1], x[2], _chunked(o)[1].where("document_id % 5 = 0"))  # noqa: E731  (what is published is the operator's argument)
over_objects("publish_vectors", lambda o: _published(o)[1].drop("last_error", "updated_at"), _CH + "SELECT document_id, CASE WHEN document_id % 5 <> 0 AND document_id % 17 = 0 THEN 'pending' WHEN document_id % 5 <> 0 AND document_id % 37 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN document_id % 5 <> 0 AND document_id % 23 = 0 THEN 'old' ELSE max(content_sha256) END AS active_sha256, CASE WHEN document_id % 5 <> 0 AND document_id % 19 = 0 THEN 0 ELSE 1 END AS active_chunker, 'hash-embed' AS active_model, 1 AS active_version, count(*) AS active_chunks FROM chunks WHERE document_id % 5 = 0 OR document_id % 31 <> 0 GROUP BY document_id")
over_objects("publish_ledger", lambda o: _placed(_published(o)[0]), _LEDGER + f"SELECT {_PLACE} FROM ledger WHERE document_id % 5 <> 0 UNION ALL SELECT {_PLACE} FROM chunks WHERE document_id % 5 = 0")
over_objects("vector_health", lambda o: vectors.vector_health((x := _ledger(o))[0], x[2], x[1]), _LEDGER + f"SELECT count(*) FILTER (id % 31 <> 0) AS tracked, count(*) FILTER (id % 31 <> 0 AND id % 17 <> 0 AND id % 37 <> 0) AS ready, count(*) FILTER (id % 31 <> 0 AND id % 17 = 0) AS pending, count(*) FILTER (id % 31 <> 0 AND id % 17 <> 0 AND id % 37 = 0) AS failed, count(*) FILTER ({_STALE}) AS outdated, (SELECT count(*) FROM ledger) AS ledger_chunks, 'model timed out on ' || arg_max(id, (id * 7 % 1000) * 1000000 + id) FILTER (id % 31 <> 0 AND id % 17 <> 0 AND id % 37 = 0) AS last_error FROM notes")
over_objects("accept_hits", lambda o: vectors.accept_hits((x := _ledger(o))[1].select("chunk_id"), x[1], x[2], x[0], "p").select("document_id", "ordinal", "chunk_id", "key", "title"), _LEDGER + f"SELECT document_id, ordinal, chunk_id, d.key, d.title FROM ledger l JOIN documents_ d ON d.id = l.document_id WHERE starts_with(lower(d.key), 'p') AND NOT {_STALE.replace('id %', 'd.id %')} AND d.id % 29 <> 0")
def _embedded(o: DataFrame) -> DataFrame:
    """What SQL can tell of each chunk's vector: how many places aren't 0, their sum, and their sum by place."""
    v = vectors.embed(_chunked(o)[1]).select("chunk_id", F.col("embedding").cast("array<int>").alias("e"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    return v.select("chunk_id", F.size(F.filter("e", lambda x: x != 0)).alias("places"), total(F.transform("e", lambda x: x.cast("long"))).alias("total"), total(F.transform("e", lambda x, k: x.cast("long") * k)).alias("by_place"))


_FNV = lambda codes: f"list_reduce({codes}, lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_CODES = "list_concat([CAST(2166136261 AS UBIGINT)], list_transform(range(1, length({0}) + 1), lambda i: CAST(unicode(substr({0}, i, 1)) AS UBIGINT)))"
_EMBEDDED = f""", said AS (SELECT chunk_id, text, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[㐀-鿿]')) AS t FROM chunks),
tokens_ AS (SELECT t, {_FNV(_CODES.format('t'))} AS h, {_FNV("list_concat(" + _CODES.format('t') + ", CAST([0, 115, 105, 103, 110] AS UBIGINT[]))")} AS s FROM (SELECT DISTINCT t FROM said) AS d),
places AS (SELECT chunk_id, CAST(h % 1024 AS BIGINT) AS place, CAST(sum(CASE WHEN s % 2 = 1 THEN -1 ELSE 1 END) AS BIGINT) AS v FROM said JOIN tokens_ USING (t) GROUP BY 1, 2 HAVING sum(CASE WHEN s % 2 = 1 THEN -1 ELSE 1 END) <> 0),
whole AS (SELECT chunk_id, place, v FROM places UNION ALL SELECT chunk_id, CAST({_FNV(_CODES.format('text'))} % 1024 AS BIGINT), 1 FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM places))
SELECT chunk_id, CAST(count(*) AS INTEGER) AS places, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * place) AS BIGINT) AS by_place FROM whole GROUP BY chunk_id"""
over_objects("embed", _embedded, _CH.rstrip() + _EMBEDDED)


def _semantic(o: DataFrame) -> DataFrame:
    """Notes are parsed and cut once; their chunks are all that is stored of the texts."""
    chunks = stored(vectors.chunk_documents(index.parse_documents(o), also=("key",)).drop("tags"), "semantic")
    documents = chunks.where("ordinal = 0").select(F.col("document_id").alias("id"), "key", "content_sha256", "title")
    ledger, state = chunks.select("chunk_id", "document_id", "content_sha256", "ordinal", "heading", "text"), _STATE(chunks)
    asked = vectors.embed(chunks.where("document_id % 20 = 0 and ordinal = 0").select(F.col("document_id").alias("query_id"), "text")).select("query_id", "embedding")
    return vectors.search_semantic(vectors.embed_packed(chunks), asked, ledger, state, documents, "p")


_STATE = lambda chunks: chunks.groupBy("document_id").agg(F.max("content_sha256").alias("active_sha256"), F.count("*").alias("active_chunks")).select("*", F.lit("ready").alias("status"), F.lit(1).alias("active_chunker"), F.lit(vectors.MODEL).alias("active_model"), F.lit(1).alias("active_version"))
over_objects("search_semantic", _semantic)
_EMB = "SELECT vec_id, embedding FROM embeddings"


@query("embedding_quality", "SELECT count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS min_width, CAST(max(len(embedding)) AS INTEGER) AS max_width, min(len(embedding)) = max(len(embedding)) AS uniform, TRUE AS finite, count(DISTINCT embedding) AS distinct_vectors FROM embeddings", "")
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.embedding_quality(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("similarity", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 5) AS cosine, round(list_inner_product(a.embedding, b.embedding), 4) AS dot, round(-list_distance(a.embedding, b.embedding), 4) AS euclidean FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) b ON b.vec_id = a.vec_id + 1", "")
def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x, y = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    s = lambda m, n: F.round(vectors.similarity(F.col("x"), F.col("y"), m), n).alias(m)
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", s("cosine", 5), s("dot", 4), s("euclidean", 4))


@query("top_k", "SELECT q AS query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS q, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) AS t WHERE rank <= 10", "")
def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(e, asked, 10, "vec_id").select("query_id", "vec_id", "rank")


_VECTORS: dict[tuple, vector_index.VectorIndex] = {}


def _indexed(spark: SparkSession, sf: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    """The index of the embeddings, built once a session, and every twentieth of them as queries."""
    e, key = spark.read.parquet(f"{sf}/embeddings.parquet"), stamp(spark, sf, "embeddings")
    if key not in _VECTORS:
        _VECTORS[key] = vector_index.build_vector_index(e, "vec_id")
    return _VECTORS[key], e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("top_k_twentieth", "SELECT q AS query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS q, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) AS t WHERE rank <= 10", "")
def _top_k_twentieth(spark: SparkSession, sf: str) -> DataFrame:
    """As top_k, from inverted lists, to the end."""
    return vector_index.nearest(*_indexed(spark, sf), 10).select("query_id", "vec_id", "rank")


@query("vector_recall", " SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, count(*) FILTER (vec_id % 20 = 0) * least(10, count(*)) AS nearest, TRUE AS enough FROM embeddings", "")
def _recall(spark: SparkSession, sf: str) -> DataFrame:
    """Queries, their nearest, and whether two thirds of the lists hold over nine tenths of them (the vectors are random, so lists prune little)."""
    x, asked = _indexed(spark, sf)
    some = vector_index.nearest(x, asked, 10, probes=2 * len(x.centers) // 3 + 1, exact=False).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = vectors.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), asked, 10, "vec_id").join(some, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("nearest"), (F.avg(F.coalesce("hit", F.lit(0))) > 0.9).alias("enough"))


# Recovery: a store of versions and deletion records made from the notes
def version_store(o: DataFrame) -> DataFrame:
    """The vault, with a manifest and a body for some notes (some damaged) and tombstones for others."""
    cols = ["key", "etag", "size", "modified_ms", "text"]
    n = o.where(keys.is_indexable(F.col("key")))
    v = n.where("id % 8 = 0").withColumn("vid", F.concat(F.lit("w"), "id")).withColumn("state", F.when(F.col("id") % 3 == 0, "delete-pending").otherwise("backup"))
    line = lambda k, x: F.concat(F.lit(f'{k} = "'), x, F.lit('"\n'))
    body = F.concat(
        line("version_id", F.col("vid")), line("path", F.col("key")), line("created_at", F.lit("2026-01-02T03:04:05.000Z")), line("deleted_etag", F.col("etag")), line("content_etag", F.when(F.col("id") % 5 == 0, "wrong").otherwise(F.col("etag"))),
        line("content_type", F.lit("text/markdown")), F.concat(F.lit("size = "), "size", F.lit("\n")), line("original_modified", F.lit("2026-01-01T00:00:00.000Z")), line("reason", F.when(F.col("id") % 3 == 0, "delete").otherwise("backup")),
        line("state", F.col("state")), line("original_metadata_json", F.lit("{}")), line("original_http_metadata_json", F.lit("{}")), line("anomaly", F.lit("")), F.when(F.col("id") % 7 == 0, "size = x\n").otherwise(""),
    )
    manifests = v.select(F.concat(F.lit(keys.VERSIONS), "vid", F.lit("/manifest.toml")).alias("key"), F.md5(body).alias("etag"), F.octet_length(body).cast("long").alias("size"), "modified_ms", body.alias("text"))
    bodies = v.where("id % 11 <> 0").select(keys.version_key(F.col("vid"), F.col("key")).alias("key"), "etag", "size", "modified_ms", "text")
    t = n.where("id % 12 = 0").withColumn("gone", F.when(F.col("id") % 24 == 0, F.col("etag")).otherwise("earlier"))
    record = F.to_json(F.struct(F.when(F.col("id") % 36 == 0, 2).otherwise(1).alias("protocol"), F.col("key").alias("path"), F.col("gone").alias("deletedRemoteETag"), F.lit("2026-02-03T04:05:06.000Z").alias("createdAt")))
    stones = t.select(F.concat(F.when(F.col("id") % 5 == 0, keys.OLD_TOMBSTONES).otherwise(keys.TOMBSTONES), text.tombstone_name(F.col("key"), F.col("gone")), F.lit(".json")).alias("key"), F.md5(record).alias("etag"), F.octet_length(record).cast("long").alias("size"), "modified_ms", record.alias("text"))
    return o.select(cols).where(~F.col("key").startswith(keys.VERSIONS)).unionByName(manifests).unionByName(bodies).unionByName(stones)


over_store = lambda name, f, sql=None: over_objects(name, lambda o: f(version_store(o)), sql)
_VKIND = "CASE WHEN id % 7 = 0 OR id % 5 = 0 OR id % 11 = 0 THEN 'invalid' ELSE 'version' END"
_MANIFEST = """concat('version_id = "w', id, '"', chr(10), 'path = "', key, '"', chr(10), 'created_at = "2026-01-02T03:04:05.000Z"', chr(10), 'deleted_etag = "', etag, '"', chr(10), 'content_etag = "', CASE WHEN id % 5 = 0 THEN 'wrong' ELSE etag END, '"', chr(10), 'content_type = "text/markdown"', chr(10), 'size = ', size, chr(10), 'original_modified = "2026-01-01T00:00:00.000Z"', chr(10),
  'reason = "', CASE WHEN id % 3 = 0 THEN 'delete' ELSE 'backup' END, '"', chr(10), 'state = "', CASE WHEN id % 3 = 0 THEN 'delete-pending' ELSE 'backup' END, '"', chr(10), 'original_metadata_json = "{}"', chr(10), 'original_http_metadata_json = "{}"', chr(10), 'anomaly = ""', chr(10), CASE WHEN id % 7 = 0 THEN 'size = x' || chr(10) ELSE '' END)"""
_VERSIONS = f""", mf AS (SELECT *, {_MANIFEST} AS manifest FROM notes WHERE id % 8 = 0), vi AS (SELECT {_VKIND} AS kind, '.mineral/versions/w' || id || '/manifest.toml' AS key, md5(manifest) AS etag, CASE WHEN {_VKIND} = 'version' THEN key ELSE 'w' || id END AS path,
  CASE WHEN {_VKIND} = 'version' THEN '2026-01-02T03:04:05.000Z' ELSE strftime(make_timestamp(modified_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS created_at, CASE WHEN {_VKIND} = 'version' THEN size ELSE CAST(bit_length(manifest) / 8 AS BIGINT) + CASE WHEN id % 11 <> 0 THEN size ELSE 0 END END AS size,
  CASE WHEN {_VKIND} <> 'version' THEN 'migration' WHEN id % 3 = 0 THEN 'delete' ELSE 'backup' END AS reason, CASE WHEN {_VKIND} = 'invalid' THEN 'invalid' WHEN id % 3 = 0 THEN 'delete-pending' ELSE 'backup' END AS state, CASE WHEN {_VKIND} = 'version' THEN etag END AS deleted_etag,
  CASE WHEN id % 7 = 0 THEN 'malformed manifest' WHEN {_VKIND} = 'invalid' THEN 'content and manifest differ' END AS error FROM mf) """
over_store("version_inventory", recovery.version_inventory, _VERSIONS + "SELECT * FROM vi")
_STONE = ", s AS (SELECT *, CASE WHEN id % 5 = 0 THEN '.mineral-sync/tombstones/' ELSE '.mineral/tombstones/' END || rtrim(replace(replace(to_base64(unhex(sha256(key || chr(0) || gone))), '+', '-'), '/', '_'), '=') || '.json' AS name, '{\"protocol\":' || CASE WHEN id % 36 = 0 THEN 2 ELSE 1 END || ',\"path\":\"' || key || '\",\"deletedRemoteETag\":\"' || gone || '\",\"createdAt\":\"2026-02-03T04:05:06.000Z\"}' AS record, id % 36 <> 0 AS ok, id % 24 = 0 AND id % 8 = 0 AND NOT (id % 7 = 0 OR id % 5 = 0 OR id % 11 = 0) AS kept FROM (SELECT *, CASE WHEN id % 24 = 0 THEN etag ELSE 'earlier' END AS gone FROM notes WHERE id % 12 = 0) AS g) "
_STONES = _STONE + ", ti AS (SELECT CASE WHEN ok THEN 'tombstone' ELSE 'invalid' END AS kind, name AS key, md5(record) AS etag, CASE WHEN ok THEN key ELSE name END AS path, CASE WHEN ok THEN '2026-02-03T04:05:06.000Z' END AS created_at, CASE WHEN NOT ok THEN CAST(bit_length(record) / 8 AS BIGINT) WHEN id % 24 = 0 THEN size ELSE -1 END AS size, ok AND NOT kept AND id % 24 = 0 AS recoverable, CASE WHEN NOT ok THEN 'invalid' WHEN id % 5 = 0 THEN 'legacy-read-only' ELSE 'tombstone' END AS state FROM s) "
over_store("tombstone_inventory", recovery.tombstone_inventory, _STONES + "SELECT * FROM ti")
over_store("recovery_list", recovery.recovery_list, _VERSIONS + _STONES + "SELECT kind, key, etag, path, created_at, size, state FROM vi UNION ALL SELECT kind, key, etag, path, created_at, size, state FROM ti")
over_store("read_tombstones", lambda s: recovery.read_tombstones(s).select("key", "valid"), _STONE + "SELECT name AS key, ok AS valid FROM s")
over_store("read_manifests", lambda s: recovery.read_manifests(s).select("key", F.col("m").isNotNull().alias("valid")), " SELECT '.mineral/versions/w' || id || '/manifest.toml' AS key, id % 7 <> 0 AS valid FROM notes WHERE id % 8 = 0")
over_store("logically_deleted", lambda s: recovery.logically_deleted(s).select("key"), " SELECT key FROM notes WHERE id % 24 = 0 AND id % 36 <> 0")
over_store("pending_deletes", lambda s: recovery.pending_deletes(s), " SELECT '.mineral/versions/w' || id || '/manifest.toml' AS key, key AS path, etag AS deleted_etag FROM notes WHERE id % 24 = 0 AND id % 7 <> 0")
over_objects("delete_outcomes", lambda o: recovery.delete_outcomes(o.where("id % 3 = 0").select(F.when(F.col("id") % 9 == 0, F.concat("key", F.lit(".gone"))).otherwise(F.col("key")).alias("path"), F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("etag")).alias("etag"), (F.col("modified_ms") + F.when(F.col("id") % 7 == 0, 500).otherwise(0)).alias("modified_ms"), (F.col("id") % 2 == 0).alias("backed_up")), o).select("path", "state"), " SELECT CASE WHEN id % 9 = 0 THEN key || '.gone' ELSE key END AS path, CASE WHEN id % 9 = 0 THEN 'deleted' WHEN id % 5 = 0 OR (id % 7 = 0 AND id % 2 = 1) THEN CASE WHEN id % 2 = 0 THEN 'anomaly' ELSE 'conflict' END ELSE 'delete-pending' END AS state FROM objects WHERE id % 3 = 0")
over_objects("absent_keys", lambda o: recovery.absent_keys(o.select(F.when(F.col("id") % 6 == 0, F.concat("key", F.lit(".x"))).otherwise(F.col("key")).alias("key")), o), " SELECT key || '.x' AS key FROM objects WHERE id % 6 = 0")


# Streams: the journal, written as files, run through to its end
def _streamed(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    at = folder(spark, "stream")
    journal(spark, sf).repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{at}/in")
    return at, io.journal_stream(spark, f"{at}/in", 2)


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _changes(spark: SparkSession, sf: str, f, schema: str) -> DataFrame:
    """What f makes of the journal's stream, as files."""
    at, stream = _streamed(spark, sf)
    _finished(streams.written_to(f(stream), f"{at}/out", f"{at}/checkpoint"))
    return spark.read.schema(schema).parquet(f"{at}/out")


_ONCE = JBASE.rsplit(") AS j)", 1)[0] + ") AS j QUALIFY row_number() OVER (PARTITION BY mutation_id ORDER BY seq) = 1)"
_LATEST = "(SELECT max(committed_at) FROM journal)"  # where the time of the events stands at the end


query("read_journal", " SELECT source, op, count(*) AS facts, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS bytes FROM journal GROUP BY 1, 2", JBASE)(
    lambda spark, sf: io.read_journal(spark, f"{_streamed(spark, sf)[0]}/in").groupBy("source", "op").agg(F.count("*").alias("facts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("size").alias("bytes"))
)


@query("stream_dirty_set", _DIRTY + " SELECT path, action, target_etag, source, not_before, first_dirty_at, updated_at, seq FROM dirty", _ONCE)
def _stream_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return streams.current_dirty(_changes(spark, sf, streams.stream_dirty_set, streams.DIRTY)).select("path", "action", "target_etag", "source", "not_before", "first_dirty_at", "updated_at", "seq")


@query("stream_debounce", _DIRTY + f" SELECT path, action, not_before < {_LATEST} AS emitted FROM dirty", _ONCE)
def _stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Each path in its last state, and whether its timer has gone off by the time of the last event."""
    return streams.current_dirty(_changes(spark, sf, streams.stream_dirty_set, streams.DIRTY)).select("path", "action", F.col("told").alias("emitted"))


@query(
    "stream_index",
    ", objects AS (SELECT * FROM (" + VAULT + ") AS v)" + _DIRTY + f" SELECT dirty.path, action, dirty.seq, CASE WHEN not_before >= {_LATEST} THEN 0 WHEN contains(path, '9.') THEN 2 ELSE 1 END AS attempts, CASE WHEN not_before < {_LATEST} THEN o.etag END AS indexed_etag FROM dirty LEFT JOIN (SELECT key, etag FROM objects) o ON o.key = dirty.path",
    _ONCE,
)
def _stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each path in its last state: how often it was worked on by the time of the last event, and what the index holds of it then. Paths with a 9 before the dot fail the first time."""
    at, stream = _streamed(spark, sf)
    objects, columns = stored(vault(spark, sf), "listing"), "path string, seq long"

    def apply(due: DataFrame, n: int) -> DataFrame:
        bad = F.col("path").contains("9.") & (F.col("attempts") == 0)
        due.select("path", "seq").write.mode("overwrite").parquet(f"{at}/worked/batch-{n}")
        there = objects.join(due.where(~bad).select("path").distinct(), F.col("key") == F.col("path"), "left_semi")
        segments.publish_changes(there, f"{at}/index", indexed_at=NOW)
        return due.select("path", "seq", (~bad).alias("ok"), (F.col("not_before") + 1).alias("retry_at"))

    _finished(streams.stream_index(stream, apply, f"{at}/retries", f"{at}/checkpoint", lambda: NOW))
    streams.work(spark.createDataFrame([], streams.DIRTY), apply, f"{at}/retries", 1_000_000, 1 << 60)  # what failed in the last batch is tried again
    worked = spark.read.schema(columns).option("recursiveFileLookup", "true").parquet(f"{at}/worked").groupBy("path", "seq").agg(F.count("*").cast("int").alias("attempts"))
    final = streams.current_dirty(_dirty_changes(spark, at)).select("path", "action", "seq", "told")
    indexed = segments.read_segments(spark, f"{at}/index").documents.select(F.col("key").alias("path"), "indexed_etag")
    rows = final.join(worked, ["path", "seq"], "left").join(indexed, "path", "left")
    return rows.select("path", "action", "seq", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(F.col("told"), F.col("indexed_etag")).alias("indexed_etag"))


def _dirty_changes(spark: SparkSession, at: str) -> DataFrame:
    """The changes of the dirty set of the same files."""
    _finished(streams.written_to(streams.stream_dirty_set(io.journal_stream(spark, f"{at}/in", 2)), f"{at}/dirty", f"{at}/dirty-checkpoint"))
    return spark.read.schema(streams.DIRTY).parquet(f"{at}/dirty")


@query("stream_deletions", _LAST.format(1 << 60) + " SELECT * FROM d", _ONCE)
def _stream_deletions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.current_deletions(_changes(spark, sf, streams.stream_deletions, streams.DELETION))


@query("stream_outbox", " SELECT seq, mutation_id, CASE WHEN op = 'delete' THEN 'delete' ELSE 'put' END AS change, path, CASE WHEN op <> 'delete' THEN etag END AS etag FROM journal", _ONCE)
def _stream_outbox(spark: SparkSession, sf: str) -> DataFrame:
    at, stream = _streamed(spark, sf)
    _finished(streams.stream_outbox(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/sent/batch={n}"), f"{at}/checkpoint"))
    return spark.read.schema(streams.OUTBOX).parquet(f"{at}/sent").select("seq", "mutation_id", "change", "path", "etag")


@query("stream_dedupe", " SELECT mutation_id, seq, source, op, path FROM journal", _ONCE)
def _stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf, streams.stream_dedupe, J.EVENT).select("mutation_id", "seq", "source", "op", "path")


__all__ = ["BASE"]
