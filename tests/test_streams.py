"""Streams on Spark's keyed state: timers, late events, change output, restarts from a checkpoint."""

import pytest
from pyspark.sql import functions as F

from noteloom.operators import journal as J
from noteloom.sources import io
from noteloom.streaming import journal as S


def event(seq, path, op="put", at=None, source="web", id_=None, from_path=None, etag="e"):
    return (seq, id_ or f"m{seq}", source, op, path, from_path, None if op == "delete" and etag == "e" else f"{etag}{seq}", 1, 1000 * seq if at is None else at)


@pytest.fixture
def fed(spark, tmp_path):
    """Adds a file of events to the stream, and runs a function of the stream to its end from one checkpoint."""

    class Feed:
        at = str(tmp_path)

        def add(self, *events):
            spark.createDataFrame(list(events), J.EVENT).coalesce(1).write.mode("append").parquet(f"{self.at}/in")

        def stream(self):
            return io.journal_stream(spark, f"{self.at}/in", 1)

        def run(self, f, schema):
            q = S.written_to(f(self.stream()), f"{self.at}/out", f"{self.at}/checkpoint")
            q.awaitTermination()
            assert q.exception() is None
            return spark.read.schema(schema).parquet(f"{self.at}/out")

    return Feed()


def test_a_path_is_due_by_its_timer(fed):
    """30 s after the last obsidian put; edits in between put it off; what was told is told once for each new state."""
    fed.add(event(1, "a", source="obsidian"), event(2, "b"))
    got = fed.run(S.stream_dirty_set, S.DIRTY)
    due = lambda df: sorted((r.path, r.seq) for r in df.where("kind = 'due'").collect())
    assert due(got) == []  # b's time is that of the newest event, so it is not over
    fed.add(event(20, "a", source="obsidian"))
    assert due(fed.run(S.stream_dirty_set, S.DIRTY)) == [("b", 2)]
    fed.add(event(49, "c"))
    assert due(fed.run(S.stream_dirty_set, S.DIRTY)) == [("b", 2)]  # a waits until 50 s
    fed.add(event(51, "c"))
    got = fed.run(S.stream_dirty_set, S.DIRTY)
    assert due(got) == [("a", 20), ("b", 2)] or due(got) == [("a", 20), ("b", 2), ("c", 49)]
    assert {r.path: r.told for r in S.current_dirty(got).collect()} == {"a": True, "b": True, "c": False}
    fed.add(event(60, "b"), event(61, "d"))
    assert ("b", 60) in due(fed.run(S.stream_dirty_set, S.DIRTY))


def test_late_events_raise_the_wait_only(fed):
    late = lambda s: S.stream_dirty_set(s, "1 minute")
    fed.add(event(10, "a", op="delete"), event(10, "z", id_="z10"))
    fed.run(late, S.DIRTY)
    fed.add(event(5, "a", source="obsidian", etag="late"))
    r = {x.path: x for x in S.current_dirty(fed.run(late, S.DIRTY)).collect()}["a"]
    assert (r.action, r.target_etag, r.seq, r.not_before, r.first_dirty_at, r.updated_at) == ("remove", None, 10, 35_000, 5000, 10_000)


def test_repeats_are_known_after_a_restart(fed):
    fed.add(event(1, "a"), event(2, "b"))
    fed.run(S.stream_dirty_set, S.DIRTY)
    fed.add(event(3, "a", id_="m1", op="delete"), event(4, "c"))
    got = S.current_dirty(fed.run(S.stream_dirty_set, S.DIRTY))
    assert {r.path: (r.action, r.seq) for r in got.collect()} == {"a": ("upsert", 1), "b": ("upsert", 2), "c": ("upsert", 4)}


def test_streamed_equals_batch_at_each_restart(spark, fed):
    """Deletions as inserts and retractions, and the dirty set, against the batch operators over all events so far."""
    files = [
        [event(1, "a"), event(2, "b"), event(3, "a", "delete", etag="d")],
        [event(4, "c", "rename", from_path="a"), event(5, "b", "delete", etag="d"), event(6, "e", "delete")],
        [event(7, "b"), event(8, "c", "delete", etag="d"), event(9, "c", "delete", etag="f")],
    ]
    for n in range(3):
        fed.add(*files[n])
        so_far = spark.createDataFrame([e for f in files[: n + 1] for e in f], J.EVENT)
        changes = fed.run(S.stream_deletions, S.DELETION)
        assert sorted(map(tuple, S.current_deletions(changes).collect())) == sorted(map(tuple, J.deletion_index(so_far).collect()))
    told = [(r.change, r.etag) for r in changes.where("path = 'c'").orderBy("version").collect()]
    assert told == [("insert", "f9")]  # what one batch passes through isn't told
    fed.add(event(10, "c", "delete", etag="g"))
    told = [(r.change, r.etag) for r in fed.run(S.stream_deletions, S.DELETION).where("path = 'c'").orderBy("version").collect()]
    assert told == [("insert", "f9"), ("retract", "f9"), ("insert", "g10")]
    assert [(r.change, r.seq) for r in changes.where("path = 'b'").orderBy("version").collect()] == [("insert", 5), ("retract", 5)]


def test_failed_work_comes_back(spark, fed):
    """Once its time has come, unless a newer state of the path is due; a repeated piece of work reads what waited before it."""
    worked = []

    def apply(due, n):
        rows = due.collect()
        worked.append(sorted((r.path, r.seq, r.attempts) for r in rows))
        return due.select("path", "seq", F.when(F.col("path") == "a", F.col("attempts") > 1).otherwise(F.col("path") != "x").alias("ok"), (F.col("not_before") + 10_000).alias("retry_at"))

    due = lambda *xs: spark.createDataFrame([(p, "due", "upsert", "e", "web", 0, 0, 0, q, 0, 1) for p, q in xs], S.DIRTY)
    at = f"{fed.at}/retries"
    S.work(due(("a", 1), ("b", 2), ("x", 3)), apply, at, 0, 5000)
    S.work(due(), apply, at, 1, 5000)
    assert worked == [[("a", 1, 0), ("b", 2, 0), ("x", 3, 0)], []] and {r.path for r in S.put_off(spark, at).collect()} == {"a", "x"}
    for _ in range(2):
        S.work(due(("x", 9)), apply, at, 2, 20_000)
        assert worked[-1] == [("a", 1, 1), ("x", 9, 0)]
    S.work(due(), apply, at, 3, 20_000)
    assert worked[-1] == [("a", 1, 2), ("x", 9, 1)] and [(r.path, r.attempts) for r in S.put_off(spark, at).collect()] == [("x", 2)]
    fed.add(event(1, "m"), event(2, "n"))
    q = S.stream_index(fed.stream(), apply, f"{fed.at}/streamed", f"{fed.at}/checkpoint", lambda: 0)
    assert q.awaitTermination(100) and q.exception() is None and [w for w in worked[-2:] if w] == [[("m", 1, 0)]]


def test_generations_go_on(spark):
    marks = lambda xs: spark.createDataFrame(xs, "channel string, mutation_id string, arrival long")
    a = marks([("c", "m1", 1), ("c", None, 2), ("d", "m1", 1)])
    before = J.assign_generations(a)
    later = J.assign_generations(marks([("c", "m1", 3), ("c", "m2", 4), ("c", None, 5), ("c", "m2", 6), ("e", "m9", 1)]), before)
    assert {(r.channel, r.arrival): r.generation for r in later.collect()} == {("c", 3): 1, ("c", 4): 3, ("c", 5): 4, ("c", 6): 3, ("e", 1): 1}


def test_untouched_paths_keep_their_attempts(spark):
    schema = "path string, action string, target_etag string, source string, not_before long, first_dirty_at long, updated_at long, seq long, attempts int"
    dirty = spark.createDataFrame([("a", "upsert", "e", "web", 5, 1, 2, 3, 2, "late"), ("b", "upsert", "e", "web", 5, 1, 2, 3, 2, "late")], schema + ", last_error string")
    newer = spark.createDataFrame([("b", "remove", None, "web", 9, 8, 8, 7, 0)], schema)
    got = {r.path: (r.action, r.attempts, r.last_error, r.not_before, r.first_dirty_at) for r in J.merge_dirty(dirty, newer).collect()}
    assert got == {"a": ("upsert", 2, "late", 5, 1), "b": ("remove", 0, None, 9, 1)}
