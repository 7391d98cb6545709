"""Search, graph, journal, audit and recovery on the small cases that fix their rules."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_parsing import objects

from noteloom.operators import audit, index, links, recovery, search, stats, tags, vectors
from noteloom.operators import edits as E
from noteloom.operators import journal as J
from noteloom.sources import io


@pytest.mark.parametrize("query, match, runs", [
    ("心率 monitor", '"monitor"', ["心率"]), ("probe-tag", '"probe" AND "tag"', []), ("foo OR bar", '"foo" OR "bar"', []), ("NOT foo", '"foo"', []), ("foo AND", '"foo"', []), ("C++", '"C"', []),
    ("!!! ...", None, []), ("foo AND AND bar", '"foo" AND "bar"', []), ("foo or bar", '"foo" AND "or" AND "bar"', []), ("café", '"caf"', []),
])
def test_query_plans(query, match, runs):
    p = search.plan_text_query(query)
    assert (p.match, p.runs, p.empty) == (match, runs, match is None and not runs)


def test_anchor_is_the_longest_run():
    assert search.plan_text_query("心率 麦理浩径 徒步记录").anchor == "麦理浩径"


def test_latin_search(spark):
    x = index.build_index(objects(spark, {"a.md": "# Quartz\n\nabout quartz and mica", "b.md": "quartz once " + "filler " * 50, "c.md": "granite #probe-tag", "d.md": "mica a_b only", "e.md": "b a"}))
    keys_ = lambda q, **k: [r.key for r in search.search_bm25(x, q, **k).collect()]
    assert keys_("quartz") == ["a.md", "b.md"] and keys_("quartz NOT mica") == ["b.md"] and set(keys_("granite OR mica")) == {"a.md", "c.md", "d.md"}
    assert keys_("probe-tag") == ["c.md"] and keys_("a_b") == ["d.md"] and keys_("quartz", prefix="B") == ["b.md"] and keys_("...") == []
    assert all(r.score < 0 for r in search.search_bm25(x, "quartz").collect())


def test_phrase_search(spark):
    x = index.build_index(objects(spark, {"a.md": "今天查看心率的工具", "b.md": "# 心率训练\n\n正文心率", "c.md": "麦理浩径徒步记录", "d.md": "跑步"}))
    assert [r.key for r in search.search_phrase(x, "心率").collect()] == ["b.md", "a.md"]
    assert [r.key for r in search.search_phrase(x, "麦理浩径 徒步").collect()] == ["c.md"] and search.search_phrase(x, "徒步 心率").count() == 0
    assert [r.key for r in search.search(x, "心率").collect()] == ["b.md", "a.md"]


def test_names(spark):
    q = lambda s: spark.createDataFrame([("daily/2026-06-18.md",)], "k string").select(search.name_quality(F.col("k"), s)).first()[0]
    assert [q(s) for s in ("2026-06-18", "2026-06", "06-18", "daily", "zzz", " ")] == ["exact", "prefix", "substring", "path", None, None]
    df = spark.createDataFrame([("prefix", True), ("substring", True), ("exact", False), (None, True)], "q string, c boolean")
    tier, matched = search.tier_of(F.col("q"), F.col("c"))
    assert [tuple(r) for r in df.select(tier, matched).collect()] == [(1, "name,content"), (2, "content,name"), (0, "name"), (2, "content")]


def test_tags(spark):
    x = index.build_index(objects(spark, {"a.md": "---\ntags: [跑步, 训练/跑步, '100%', a_b]\n---\nx", "b.md": "#跑步 #骑行"}))
    assert [r.tag for r in tags.complete_tags(x, "步").collect()] == ["训练/跑步", "跑步"] and tags.complete_tags(x, "a%b").count() == 0
    assert tags.tag_list(x).where("tag = '跑步'").first().document_count == 2 and tags.tag_documents(x, "训练", "descendants").count() == 1
    assert [tuple(r) for r in tags.tag_suggest(x, "步").collect()] == [("训练/跑步", False), ("跑步", False)]


def test_suggestions_of_all_tags(spark):
    """Equal to tag_suggest of every tag, one by one."""
    words = ["a", "A", "ab", "abc", "ABCD", "xabcdx", "bcd", "area/a1", "area", "rea/a", "步", "跑步", "x/跑步/y", "100", "q"]
    x = index.build_index(objects(spark, {f"n{k}.md": "---\ntags: ['" + w + "', q]\n---\n" for k, w in enumerate(words)}))
    for limit in (2, 10):
        got = sorted((r.tag, r.suggested) for r in tags.tag_suggestions(x, limit).collect())
        fold = {w: w.lower() for w in words}
        near = {w: sorted(v for v in words if v != w and (fold[v] in fold[w] or fold[w] in fold[v]))[:limit] for w in words}
        assert got == sorted((w, v) for w, vs in near.items() for v in vs)
    assert [r.tag for r in tags.tag_suggest(x, "abc").collect()] == [v for w, v in got if w == "abc"]


def _plain_snippet(body, terms, width):
    words = body.split()
    hits = [(k, t) for k, w in enumerate(words, 1) for t in terms if re.match(rf"[^a-z0-9]*{t}\b", w.lower())]
    best = max(((len({t for _, t in near}), len(near), -k, near[-1][0]) for k, _ in hits if (near := [h for h in hits if k <= h[0] < k + width])), default=(0, 0, -1, width))
    at = max(1, -best[2] - (width - (best[3] + best[2] + 1)) // 2)
    return ("…" if at > 1 else "") + " ".join(words[at - 1 : at - 1 + width]) + ("…" if len(words) >= at + width else "")


def test_best_snippets(spark):
    """Against all windows that begin with a match: most different terms, then most matches, then the first."""
    rng = np.random.default_rng(3)
    bodies = ["", "none here", "alpha", "x " * 40 + "alpha", "alpha " + "x " * 30 + "alpha beta " + "y " * 30 + "alpha beta, beta"]
    bodies += [" ".join(rng.choice(["alpha", "Beta", "(gamma)", "betamax", "x", "y", "z", "w"], n, p=[0.04, 0.04, 0.04, 0.08, 0.2, 0.2, 0.2, 0.2])) for n in (5, 30, 80, 200, 400) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    for width in (4, 12):
        got = {r.id: r.s for r in df.select("id", search.term_snippet(F.col("body"), ["alpha", "Beta", "gamma"], width).alias("s")).collect()}
        assert got == {k: _plain_snippet(b, ["alpha", "beta", "gamma"], width) for k, b in enumerate(bodies)}
    long = spark.createDataFrame([("alpha x " * 200_000 + "alpha beta",)], "body string")
    assert long.select(search.term_snippet(F.col("body"), ["alpha", "beta"], 12)).first()[0].endswith("alpha beta")


def test_graph(spark):
    x = index.build_index(objects(spark, {"hub.md": "[[leaf]] [[nowhere]] [[d/deep.md]]", "leaf.md": "x", "lonely.md": "y", "d/deep.md": "[[deep.md]]", "e/deep.md": ""}))
    edges = {(r.from_key, r.link): (r.to_key, r.dangling) for r in links.resolve_edges(x).collect()}
    assert edges == {("hub.md", "leaf"): ("leaf.md", False), ("hub.md", "nowhere"): (None, True), ("hub.md", "d/deep.md"): ("d/deep.md", False), ("d/deep.md", "deep.md"): ("e/deep.md", True)}
    assert {r.key for r in links.orphans(x).collect()} == {"lonely.md"}
    near = lambda d: {(r.key, r.hops) for r in links.neighbors(x, spark.createDataFrame([("leaf.md",)], "key string"), d).collect()}
    assert near(1) == {("leaf.md", 0), ("hub.md", 1)} and near(2) == near(1) | {("d/deep.md", 2)} and near(3) == near(2) | {("e/deep.md", 3)}
    total = links.graph_totals(x, limit=1).first()
    assert (total.total_nodes, total.node_count, total.edge_count, total.dangling_count) == (5, 1, 4, 2)


def test_stats(spark):
    x = index.build_index(objects(spark, {"stats/a.md": "s", "stats/deep/b.md": "x" * 400}))
    s = stats.stats(x).first()
    assert (s["count"], s.largest, s.smallest) == (2, "stats/deep/b.md", "stats/a.md") and stats.folder_stats(x).first()["count"] == 2
    assert {r.folder for r in stats.folder_rollup(x).collect()} == {"stats", "stats/deep"}


EV = "seq long, mutation_id string, source string, op string, path string, from_path string, etag string, size long, committed_at long"


def test_intents(spark):
    j = spark.createDataFrame([(1, "a", "obsidian", "put", "x", None, "e1", 1, 100), (2, "b", "web", "rename", "y", "x", "e2", 1, 200), (3, "c", "obsidian", "put", "z", None, "e3", 1, 300), (4, "d", "web", "delete", "z", None, "e3", None, 400)], EV)
    got = {r.path: (r.action, r.target_etag, r.not_before, r.first_dirty_at) for r in J.coalesce_intents(J.intents_for(j)).collect()}
    assert got == {"x": ("remove", None, 30_100, 100), "y": ("upsert", "e2", 200, 200), "z": ("remove", None, 30_300, 300)}


def test_batches_fold_in_any_order(spark):
    j = spark.createDataFrame([(k, f"m{k}", ("obsidian", "web")[k % 2], ("put", "delete", "rename")[k % 3], f"p{k % 5}", f"p{(k + 2) % 5}" if k % 3 == 2 else None, f"e{k}", k, 1000 * k) for k in range(1, 60)], EV)
    c = lambda d: J.coalesce_intents(J.intents_for(d))
    whole = {tuple(r) for r in c(j).drop("first_dirty_at").collect()}
    cut = [c(j.where(f"seq % 3 = {k}")) for k in (2, 0, 1)]
    assert {tuple(r) for r in J.merge_dirty(J.merge_dirty(cut[0], cut[1]), cut[2]).select(c(j).drop("first_dirty_at").columns).collect()} == whole


def test_deletions(spark):
    rows = [(1, "a", "web", "delete", "a", None, "ea", None, 1), (2, "b", "web", "delete", "b", None, "eb", None, 2), (3, "c", "web", "put", "a", None, "e", 1, 3), (4, "d", "web", "delete", "c", None, "ec", None, 4), (5, "e", "web", "rename", "q", "b", "e", 1, 5), (6, "f", "web", "delete", "d", None, None, None, 6)]
    j = spark.createDataFrame(rows, EV)
    assert [r.path for r in J.deletion_index(j).collect()] == ["c"]
    assert [r.path for r in J.deletion_index(j, 2).orderBy("path").collect()] == ["a", "b"]
    assert [(r.path, r.has_more) for r in J.deletion_index(j, 2, limit=1).collect()] == [("a", True)] and [(r.path, r.has_more) for r in J.deletion_index(j, 2, "a", 1).collect()] == [("b", False)]


def test_settle(spark):
    d = spark.createDataFrame([("a", "upsert", "e1", "web", 5, 1, 10, 1, 0), ("b", "upsert", "e2", "web", 5, 1, 30, 1, 0), ("c", "remove", None, "web", 5, 1, 10, 1, 0)], "path string, action string, target_etag string, source string, not_before long, first_dirty_at long, updated_at long, seq long, attempts int")
    o = spark.createDataFrame([("a", "upsert", "e1", 20, True, None, None), ("b", "upsert", "e2", 20, True, None, None), ("c", "remove", None, 20, False, "x" * 300, 99)], "path string, action string, target_etag string, started_at long, ok boolean, error string, retry_at long")
    got = {r.path: (r.not_before, r.attempts, len(r.last_error or "")) for r in J.settle_intents(d, o).collect()}
    assert got == {"b": (5, 0, 0), "c": (99, 1, 200)}


def test_verdicts(spark):
    r = spark.createDataFrame([("m1", "put", "a", '"e1"'), ("m2", "put", "a", "e9"), ("m3", "delete", "gone", None), ("m4", "delete", "a", "e1"), ("m0", "put", "a", "zz")], "mutation_id string, op string, path string, etag string")
    o, j = spark.createDataFrame([("a", "e1")], "key string, etag string"), spark.createDataFrame([("m0",)], "mutation_id string")
    assert {x.mutation_id: x.verdict for x in J.verify_reports(r, o, j).collect()} == {"m1": "accepted", "m2": "state-mismatch", "m3": "accepted", "m4": "state-mismatch", "m0": "duplicate"}


def test_verdicts_of_repeats_in_one_batch(spark):
    rows = [(1, "m1", "a", "e9"), (2, "m1", "a", "e1"), (3, "m1", "a", "e1"), (4, "m1", "a", "e9"), (5, "m2", "a", "e9"), (6, "m2", "a", "e9"), (7, "m0", "a", "e1"), (8, None, "a", "e1"), (9, None, "a", "e1")]
    r = spark.createDataFrame(rows, "seq long, mutation_id string, path string, etag string").withColumn("op", F.lit("put")).repartition(3)
    o, j = spark.createDataFrame([("a", "e1")], "key string, etag string"), spark.createDataFrame([("m0",)], "mutation_id string")
    got = J.verify_reports(r, o, j)
    assert set(got.columns) == {*r.columns, "verdict"}
    verdicts = ["state-mismatch", "accepted", "duplicate", "duplicate", "state-mismatch", "state-mismatch", "duplicate", "accepted", "accepted"]
    assert [x.verdict for x in got.orderBy("seq").collect()] == verdicts


def test_broadcasts_reported_twice(spark):
    o = spark.createDataFrame([(1, "m1", "pending", None, 1), (2, "m2", "pending", None, 1), (3, "m3", "published", 5, 1), (4, "m4", "pending", None, 1)], "seq long, mutation_id string, broadcast string, generation long, attempts int")
    r = spark.createDataFrame([("m1", None), ("m1", 8), ("m1", 9), ("m2", None), ("m2", None), ("m3", 7), ("m3", 6)], "mutation_id string, generation long")
    got = [tuple(x) for x in J.mark_broadcasts(o, r).orderBy("seq").select("seq", "broadcast", "generation", "attempts").collect()]
    assert got == [(1, "published", 8, 2), (2, "pending", None, 2), (3, "published", 5, 1), (4, "pending", None, 1)]


def test_top_k_takes_a_table_of_queries(spark):
    """Every 20th vector asks, in several blocks against several parts; zero vectors and ties stay in order of the key."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 8)), 2)
    x[7] = 0
    x[50] = x[51]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    f = x.astype(np.float32).astype(np.float64)
    n = np.linalg.norm(f, axis=1, keepdims=True)
    s = np.round((f / np.maximum(n, 1e-300)) @ (f / np.maximum(n, 1e-300)).T, 9)
    want = {(q, int(i), r + 1) for q in range(0, 400, 20) for r, i in enumerate(np.lexsort((np.arange(400), -s[q]))[:10])}
    got = vectors.top_k(v, asked, 10, "vec_id", block=6, part=90)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want


def _shuffled(spark) -> int:
    """Bytes that the session's executors have written for exchanges."""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    told = spark._jsparkSession.sparkContext().statusStore().executorList(False)
    return sum(told.apply(k).totalShuffleWrite() for k in range(told.size()))


@pytest.mark.parametrize("whole", [False, True])
def test_top_k_copies_no_vector(spark, whole):
    """1,600 queries in blocks of 50 over 1,600 vectors, whole or not, one of which is there 300 times: what is exchanged is k rows a query and task, not vectors times blocks (4.9 and 3.9 MB before)."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (1600, 32)).astype(np.float64) if whole else rng.normal(size=(1600, 32)).astype(np.float32).astype(np.float64)
    x[100:400] = x[100]
    x[900] = 0
    v = spark.createDataFrame([(f"k{k:05d}", r.tolist()) for k, r in enumerate(x)], "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "query_id long, embedding array<float>")
    before = _shuffled(spark)
    got = vectors.top_k(v, asked, 3, block=50, part=70).collect()
    assert _shuffled(spark) - before < 3_000_000
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    assert {(r.query_id, int(r.chunk_id[1:]), r["rank"]) for r in got} == {(q, int(i), r + 1) for q in range(1600) for r, i in enumerate(np.lexsort((np.arange(1600), -s[q]))[:3])}


def test_embedded_and_packed_at_once(spark):
    """Blobs made straight from texts hold what embed() gives."""
    chunks = spark.createDataFrame([(k, " ".join(f"w{j * (k + 1) % 97}" for j in range(40)) if k % 50 else None) for k in range(1200)], "chunk_id long, text string").repartition(2)
    asked = vectors.embed(chunks.where("chunk_id < 30")).select(F.col("chunk_id").alias("query_id"), "embedding")
    one, two = (sorted(map(tuple, vectors.top_k(v, asked, 5).collect())) for v in (vectors.embed(chunks), vectors.embed_packed(chunks)))
    assert one == two and len(one) == 150


@pytest.mark.parametrize("cell", [40, 4096])
def test_backlinks_of_all_exchange_no_expanded_rows(spark, monkeypatch, cell):
    """700 notes share a name by which 2,000 link: 1.4 million rows, in cells or in one; without broadcasts, under 1 MB is exchanged (7.9 MB before)."""
    monkeypatch.setattr(links, "CELL", cell, raising=False)
    monkeypatch.setattr(links, "ROWS", 1 << 17, raising=False)
    notes = [(k, f"p{k}/same.md" if k < 700 else f"q/n{k}.md", k * 7) for k in range(2000)]
    said = [(k, "same") for k in range(2000)] + [(k, f"n{k + 1}") for k in range(0, 2000, 3)] + [(5, "q/n900.md"), (6, "nowhere")]
    x = index.Index(**{f: None for f in index.Index.__dataclass_fields__} | {"documents": spark.createDataFrame(notes, "id long, key string, modified_ms long"), "links": spark.createDataFrame(said, "document_id long, to_key string")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        links.backlinks(x).write.format("noop").mode("overwrite").save()
        assert _shuffled(spark) - before < 1_000_000
        rows = {r.via: (r.n, r.m, r.t) for r in links.backlinks(x).groupBy("via").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("|", "target", "key", "modified_ms")).alias("m"), F.min("target").alias("t")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {"same": (1_400_000, 1_400_000, "p0/same.md"), "q/n900.md": (1, 1, "q/n900.md")} | {f"n{k + 1}": (1, 1, f"q/n{k + 1}.md") for k in range(0, 2000, 3) if 700 <= k + 1 < 2000}


def test_suggestions_come_from_all_tags(spark):
    rows = [(k, f"a{k:05d}", "body", 1) for k in range(1500)] + [(1, "zebra", "body", 1), (2, "zebra/foal", "body", 1), (3, "zebra/foal", "body", 1)]
    x = index.Index(**{f: None for f in index.Index.__dataclass_fields__} | {"tags": spark.createDataFrame(rows, "document_id long, tag string, source string, occurrences long")})
    assert [tuple(r) for r in tags.tag_suggest(x, "zebra").collect()] == [("zebra/foal", True)]


def test_cursor(spark):
    rows = lambda xs: spark.createDataFrame([("c", x) for x in xs], "client string, generation string")
    got = J.fold_cursor(rows(["9007199254740993", "9007199254740992", "junk", "-1", "007", None]), rows(["9007199254740992"])).first()
    assert tuple(got) == ("c", "9007199254740993", "9007199254740992", True)


def test_generations(spark):
    m = spark.createDataFrame([("c", "a", 1), ("c", "a", 2), ("c", None, 3), ("c", "b", 4), ("c", None, 5), ("d", "a", 6)], "channel string, mutation_id string, arrival long")
    assert [r.generation for r in J.assign_generations(m).orderBy("arrival").collect()] == [1, 1, 2, 3, 4, 1]


def test_audit(spark):
    o = spark.createDataFrame([("a.md", "1"), ("new.md", "2"), ("img.png", "3"), ("old.md", "4")], "key string, etag string")
    d = spark.createDataFrame([("a.md", "1", 1, 5), ("gone.md", "9", 1, 5), ("late.md", "9", 1, 50), ("old.md", "4", 0, 5)], "key string, indexed_etag string, index_version int, indexed_at long")
    assert {(r.path, r.action) for r in audit.audit_diff(o, d, 10).collect()} == {("new.md", "upsert"), ("gone.md", "remove")}
    assert {r.path for r in audit.audit_diff(o, d, 10, include_outdated=True).collect()} == {"new.md", "gone.md", "old.md"}
    assert {r.key: r.state for r in audit.freshness_report(o, d).collect()} == {"a.md": "fresh", "new.md": "missing", "gone.md": "absent", "late.md": "absent", "old.md": "outdated"}
    i = spark.createDataFrame([("a.md", "remove"), ("gone.md", "remove"), ("new.md", "upsert"), ("never.md", "upsert")], "path string, action string")
    assert {r.path: r.outcome for r in audit.apply_index_intents(i, o, d).collect()} == {"a.md": "noop", "gone.md": "removed", "new.md": "indexed", "never.md": "noop"}


def test_manifests(spark):
    p = lambda t: spark.createDataFrame([(t,)], "x string").select(recovery.parse_manifest(F.col("x"))).first()[0]
    assert p('# c\na = "x\\"y"\nsize = 12\n\n') == {"a": 'x"y', "size": "12"}
    assert p('a = "1"\na = "2"') is None and p("a = 1") is None and p("size = 01") is None and p("nonsense") is None


def test_writes(spark):
    o = objects(spark, {"a.md": "x", "b.md": "y\n"})
    e = spark.createDataFrame([("a.md", "n"), ("b.md", "n"), ("c.md", "n")], "key string, new_text string")
    got = lambda m, **k: {r.key: (r.text, r.outcome) for r in E.apply_writes(o, e, m, **k).collect()}
    assert got("append") == {"a.md": ("x\n\nn", "appended"), "b.md": ("y\nn", "appended"), "c.md": ("n", "created")}
    assert got("append", create_if_missing=False)["c.md"] == (None, "missing") and got("create")["a.md"] == ("x", "exists")


def test_files_and_index_tables(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# Title\n\n[[b]] #t")
    (tmp_path / "in/d/b.bin").write_bytes(b"\xff\x00")
    o = io.read_objects(spark, str(tmp_path / "in"))
    assert {(r.key, r.content_type, r.text is None) for r in o.collect()} == {("a.md", "text/markdown; charset=utf-8", False), ("d/b.bin", "application/octet-stream", True)}
    io.write_index(index.build_index(o), str(tmp_path / "ix"), "r1")
    x = io.read_index(spark, str(tmp_path / "ix"), "r1")
    assert x.documents.first().title == "Title" and x.tags.first().tag == "t" and x.links.first().to_key == "b"


RUN_TEXTS = ["心率心率心率", "心心心心", "𠀀心率 x 心", "今天查看心率的工具。心率", "# 心率训练\n\n正文心率 monitor", "麦理浩径徒步记录", "", "率心", "日志 #标签/心率", "心\n率", "latin only monitor", "心率 a_b", "b a 心率"]


def _phrase_rows(rows, query):
    """Substring search by the plain way, over rows of documents."""
    plan, out = search.plan_text_query(query), []
    for r in rows:
        texts = [r.title or "", r.heading_text or "", r.tag_text or "", r.body or ""]
        if not all(any(run in t for t in texts) for run in plan.runs):
            continue
        if "monitor" in plan.parts and not any("monitor" in t for t in texts):
            continue
        if "a_b" in plan.parts and "a_b" not in texts[3]:
            continue
        out.append((r.key, sum(p for p, t in zip((100, 40, 30, 10), texts) if plan.anchor in t) + texts[3].count(plan.anchor)))
    return sorted(out)


@pytest.mark.parametrize("stored", [False, True])
def test_phrases_equal_a_plain_search(spark, tmp_path, stored):
    o = objects(spark, {f"n{k}.md": t for k, t in enumerate(RUN_TEXTS)} | {"心率/名.md": "x"})
    x = io.publish(o, str(tmp_path), "1") if stored else index.build_index(o)
    rows = x.documents.collect()
    for q in ["心", "心率", "心心", "心心心", "率心率", "心率 monitor", "麦理浩径 徒步", "心率 a_b", "名", "查看心率的工具", "无"]:
        got = search.search_phrase(x, q, limit=2000 if q == "心" else 100).collect()
        assert sorted((r.key, r.score) for r in got) == _phrase_rows(rows, q), q
        assert all(r.snippet == search_snippet(next(d.body for d in rows if d.key == r.key), search.plan_text_query(q).anchor) for r in got)
    assert search.search_phrase(x, "心率", prefix="N4").count() == 1  # and an operator that dangles is dropped:
    assert [[r.key for r in search.search_phrase(x, q).collect()] for q in ("心率 NOT monitor", "心率 zz OR x NOT monitor")] == [["n4.md"], ["n2.md"]]


def search_snippet(body, phrase):
    at = body.find(phrase) + 1
    start = max(1, at - 60)
    return ("…" if at > 60 else "") + body[start - 1 : start + 149]


@pytest.mark.parametrize("stored", [False, True])
def test_names_equal_a_plain_search(spark, tmp_path, stored):
    names = ["Daily/2026-06-18.md", "daily/aaa.md", "日志/心率.md", "x.md", "aAaA.md", "a%b_c.md", "p/Ünder.md"]
    o = objects(spark, {k: "x" for k in names})
    x = io.publish(o, str(tmp_path), "1") if stored else index.build_index(o)
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    for q in ["", "d", "DA", "aaa", "aaaa", "2026-06-18", "心", "心率.md", "%", "_c.", "nothing", ".md", "Ünd", "ünd", "daily/2026-06-18.mdx"]:
        assert sorted(r.key for r in search.search_filename(x, q).collect()) == sorted(k for k in names if low(q) in low(k)), q
    assert [r.key for r in search.search_filename(x, "aaa", prefix="DAILY").collect()] == ["daily/aaa.md"]


def test_searches_read_their_index(spark, tmp_path):
    """Filters reach the files of grams and names; a phrase search reads bodies by id alone."""
    x = io.publish(objects(spark, {f"n{k}.md": t for k, t in enumerate(RUN_TEXTS)}), str(tmp_path), "1")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    names = plan(search.search_filename(x, "n12.md"))
    assert "EqualTo(gram,12.)" in names and "/documents/" not in names
    assert "StringStartsWith(gram,n1)" in plan(search.search_filename(x, "n1"))
    phrase = plan(search.search_phrase(x, "心率"))
    assert "body" in phrase and "In(id, [" in phrase
    hits = plan(search._runs(x.grams, ["心率", "心"], "心率"))
    assert "EqualTo(token,心率)" in hits and "StringStartsWith(token,心)" in hits
