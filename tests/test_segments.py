"""The index in segments: equal to a full rebuild after every step, and nothing unchanged is written."""

import os

import pytest

from noteloom.operators import links, search
from noteloom.sources import io, segments

NOTES = {1: "# One\n\nalpha beta [[n2]] #t", 2: "---\ntitle: Two\ntags: [x]\n---\nbeta gamma", 3: "gamma alpha alpha", 4: "", 5: "delta [[n1]]"}


def objects(spark, texts, suffix=".md"):
    return spark.createDataFrame([(i, f"n{i}{suffix}", f"e{hash(t)}", len(t or ""), 1000 + i, t) for i, t in texts.items()], segments.OBJECT)


def content(x):
    flat = lambda df: sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())
    return {n: flat(getattr(x, n)) for n in (*io.TABLES, "documents")}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_segments_equal_a_rebuild(spark, tmp_path):
    at, state = str(tmp_path / "s"), dict(NOTES)
    same = lambda n: content(segments.read_segments(spark, at)) == content(io.publish(objects(spark, state), str(tmp_path / f"full{n}"), "1"))
    with pytest.raises(ValueError, match="nothing is published"):
        segments.read_segments(spark, at)
    segments.publish_changes(objects(spark, state), at)
    assert same(0)
    before = files(at)
    for n, (changed, removed) in enumerate([({3: "# Three\n\nnew words"}, []), ({6: "epsilon #t"}, [1]), ({3: "once more", 1: "back again"}, [5]), ({}, [2, 99]), ({4: None}, [])], 1):
        state |= changed
        for k in removed:
            state.pop(k, None)
        gone = spark.createDataFrame([(k,) for k in removed], "id long")
        made = segments.publish_changes(objects(spark, changed), at, gone)
        own = spark.read.parquet(f"{at}/postings/segment={made.id}")
        assert {r.document_id for r in own.collect()} <= set(changed) and made.notes == len(changed)
        assert same(n)
    after = files(at)
    assert all(after[f] == t for f, t in before.items())  # what was there is as it was
    first = search.search_bm25(segments.read_segments(spark, at), "back OR epsilon")
    assert {r.key for r in first.collect()} == {"n1.md", "n6.md"}

    merged = segments.merge_segments(spark, at, 3)
    assert merged and merged.first > 1 and merged.upto == 6 and same("m")  # the first one is larger, and isn't read
    assert len(segments.segments(spark, at)) == 2
    dropped = segments.drop_merged(spark, at)
    assert dropped == [2, 3, 4, 5, 6] and same("d") and not os.path.exists(f"{at}/postings/segment=2")
    assert segments.merge_segments(spark, at, 3) is None


def test_what_is_not_committed_is_not_there(spark, tmp_path):
    at = str(tmp_path / "s")
    segments.publish_changes(objects(spark, NOTES), at)
    want = content(segments.read_segments(spark, at))
    broken = segments.publish_changes(objects(spark, {1: "half done"}), at)
    for d, _, names in os.walk(f"{at}/commits/commit={broken.id}"):
        for f in names:
            os.remove(os.path.join(d, f))
    assert content(segments.read_segments(spark, at)) == want
    again = segments.publish_changes(objects(spark, {1: "done"}), at)
    assert again.id == broken.id and {r.body for r in segments.read_segments(spark, at).documents.where("id = 1").collect()} == {"done"}


def test_notes_that_stop_being_notes_leave(spark, tmp_path):
    at = str(tmp_path / "s")
    segments.publish_changes(objects(spark, NOTES), at)
    segments.publish_changes(objects(spark, {1: "x"}, ".png"), at)
    x = segments.read_segments(spark, at)
    assert {r.id for r in x.documents.collect()} == {2, 3, 4, 5}
    assert {r.key: r.in_degree for r in links.degrees(x).collect()}["n2.md"] == 0


@pytest.mark.parametrize("tiers, want", [([5, 1, 1], []), ([5, 1, 1, 1], [1, 2, 3]), ([5, 2, 1, 1], [1, 2, 3]), ([2, 2, 2], [0, 1, 2]), ([1, 5, 1, 1], []), ([3, 2, 0, 0, 0], [2, 3, 4])])
def test_runs_to_merge(tiers, want):
    now = [segments.Segment(k, k, k, t, 1) for k, t in enumerate(tiers)]
    assert [s.id for s in segments.mergeable(now, 3)] == want
