"""Packing, phrases and resampling against plain versions, on awkward rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.llm import collocations, importance, packing, word_tokens

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{k % 997}" for k in range(40_000))
TEXTS = [None, "", "  \n\n ", "one", "Alpha, beta. ALPHA beta", "<|endoftext|> x<|startoftext|>", "É é ß ŒUVRE Ünïcode “quoted” – dash…", "naïve ́accent é", "日本語テキスト 😀 x", "a\x1cb c\x85d e", "it's they'll DON'T 12.5% a_b", LONG, LONG, "x" * 9000, "İstanbul ſ ª º ² ¿qué?"]
CLASHES = ["start", "length", "row", "rest", "group", "k", "h", "c", "rank", "score", "segment", "down", "id", "shard", "phrase", "bucket"]


def table(spark, texts, ids=None, langs=None):
    rows = [(i, t, g) for i, t, g in zip(ids or range(1, len(texts) + 1), texts, langs or [None] * len(texts), strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit("x") for c in CLASHES})


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(packing.default_path())


def check_packing(rows, docs, library, room):
    """Every id lies in one piece; sequences have no gap, and are full or a power of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, parts in by_doc.items():
        ids, at = [*library.encode(docs[i] or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == room or at & (at - 1) == 0
    return by_seq


@pytest.mark.parametrize("room, group", [(4096, 2048), (64, 3)])
def test_packing(spark, library, room, group):
    rows = packing.pack(table(spark, TEXTS), packing.default_path(), room=room, group_docs=group).collect()
    check_packing(rows, dict(enumerate(TEXTS, 1)), library, room)


def test_packing_of_a_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, packing.default_path(), group_docs=300).collect()
    by_seq = check_packing(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, library, 4096)
    short = {r.doc_id for r in rows if r.doc_tokens <= 4096}
    cut = {i for i in short if sum(r.doc_id == i for r in rows) > 1}
    assert len(cut) < 0.1 * len(short) and sum(len(p) > 0 for p in by_seq.values()) < 1.1 * sum(r.length for r in rows) / 4096 + 40


def test_packing_of_repeats_and_nothing(spark):
    twice = packing.pack(table(spark, ["a b", "a b", None], [7, 7, None]), packing.default_path()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 1), (7, 3), (7, 3)] or sum(r.length for r in twice) == 7
    assert packing.pack(table(spark, ["a"]).limit(0), packing.default_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_a_scan(sizes):
    """The tree finds the bin that a scan over all bins finds; all places are filled once."""
    got, bins = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = next((b for b, left in enumerate(bins) if left >= sizes[k]), len(bins))
        bins[at:] = [*bins[at:], *([50] if at == len(bins) else [])]
        bins[at] -= sizes[k]
        assert got[k] == at
    pieces = packing.laid_out(np.array(sizes, dtype=np.int64), 50)
    for k, n in enumerate(sizes):
        own = sorted((a, b) for i, a, b, _, _ in pieces if i == k)
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    fill = Counter()
    for _, a, b, s, o in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert o == fill[s]
        fill[s] += b - a
    assert all(n == 50 or n & (n - 1) == 0 for n in fill.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x1c.,'s’éÉßſİΣς<|>Aa0²ª")), max_size=30), max_size=5))
def test_word_tokens_equal_the_library(texts):
    enc = test_word_tokens_equal_the_library.__dict__.setdefault("enc", word_tokens.WordTokens(open(packing.default_path(), encoding="utf-8").read(), cached=50, longest=4))
    ids, first = enc.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == enc.whole.encode(t, add_special_tokens=False).ids


def brute_phrases(rows, least, first, longest=5):
    f, n = {}, Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(t)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in found.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows_)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("shards, slots", [(1, 1 << 15), (3, 1 << 15), (4, 1 << 20)])
def test_phrases(spark, shards, slots):
    """Repeats, overlaps, ties, words that come late, separators and odd blanks; a low threshold."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(9)] + ["É", "ab\x1cc", "日本"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 60, 60)] + ["a a a a a a a a", "New York, new york! NEW YORK city", "x\ty\x0bz x\ty", None, "", " . ,", "p q r s t u p q r s t u p q r s t u"]
    langs = [("en", "de", None)[k % 3] for k in range(len(texts))]
    got = collocations.collocations(table(spark, texts, langs=langs), least=3, first=25, shards=shards, slots=slots)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(list(zip(langs, texts, strict=True)), 3, 25)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 75


def test_phrases_with_a_full_array(spark, monkeypatch):
    """Where nearly every place of the array is taken, more is counted and the result is the same."""
    monkeypatch.setattr(collocations, "_mixed", lambda x: x % np.uint64(64))
    texts = [" ".join(f"t{k * j % 7}" for k in range(50)) for j in range(1, 12)]
    got = collocations.collocations(table(spark, texts, langs=["en"] * 11), least=4, first=40, shards=2, slots=1 << 15)
    assert sorted(map(tuple, got.collect())) == brute_phrases([("en", t) for t in texts], 4, 40)


def test_phrases_whose_places_are_set_early_by_others(spark):
    """A phrase's place is taken by another before its own words are reached: it is still counted over a full cycle, from where it is first seen."""
    rng, texts = np.random.default_rng(1), []
    p = 1 / np.arange(1, 3001)
    for _ in range(300):
        words = [f"w{k}" for k in rng.choice(3000, 120, p=p / p.sum())]
        for _ in range(6):
            k, at = int(rng.integers(0, 1500)), int(rng.integers(0, 115))
            words[at:at] = [f"{x}{k}" for x in "qrstu"]
        texts.append(" ".join(words))
    got = collocations.collocations(table(spark, texts, langs=["en", "de"] * 150), least=3, first=100_000, shards=4, slots=1 << 15)
    assert sorted(map(tuple, got.collect())) == brute_phrases(list(zip(["en", "de"] * 150, texts, strict=True)), 3, 100_000)


def test_phrases_of_a_table(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet")).collect())) == sorted(c.execute(collocations.ORACLE).fetchall())
    assert collocations.collocations(table(spark, ["a"]).limit(0)).count() == 0


def test_phrases_are_counted_by_words_only_once_reached():
    """Rows of what isn't reached hold a hash and a count; each word is there once, one way or the other."""
    w, words = collocations.words_of(b"a b a c.b a")
    reached = np.zeros(1 << 15, dtype=np.uint8)
    rows = [r for b in collocations.counted(w, words, "en", reached, 0, 4, 5) for r in b.to_pylist()]
    assert [(r["k"], r["c"]) for r in rows if r["act"] == collocations.NAMED] == [(0, 6)]
    left = [r for r in rows if r["act"] == 0]
    assert sorted(r["c"] for r in left) == [1, 2, 3] and all(r["phrase"] is None and r["lang"] is None for r in left)
    reached[[r["h"] & (len(reached) - 1) for r in left if r["c"] > 1]] = 1
    rows = [r for b in collocations.counted(w, words, "en", reached, 1, 4, 5) for r in b.to_pylist()]
    assert sorted((r["phrase"], r["c"]) for r in rows if r["k"] == 1) == [("a", 3), ("b", 2)]
    assert sorted((r["act"], r["c"]) for r in rows if r["h"] is not None) == [(0, 1), (1, 1), (1, 2)]


def test_long_pieces_are_cut_at_their_ends():
    data = b"aa bb.cc dd." + b"e" * 40 + b".f"
    assert b"".join(collocations._parts(data, 8)) == data and all(p.endswith(b".") for p in list(collocations._parts(data, 8))[:-1])
    w, words = collocations.words_of(b" a b.a")
    assert [words[k] if k >= 0 else None for k in w] == [None, "a", "b", None, "a"]


def brute_resample(docs, target, percent=25, least=20):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    rows, s, t = [(i, *feats(x)) for i, x in docs], Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for x in target:
        t.update(feats(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000)))) for k in range(10000)]
    out = []
    for i, n, f in rows:
        weight = math.floor(sum(gain[k] for k in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        drawn.setdefault(r, []).append(k)
    return sorted(((r[0], r[2], r[3], r[4], drawn[r].pop() if drawn.get(r) else None) for r in out), key=repr)


def test_resampling_of_a_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert sorted(map(tuple, importance.resample(docs, bench).collect()), key=repr) == want


def test_resampling_of_awkward_rows(spark):
    texts = [*TEXTS, *[" ".join(f"t{k * j % 23}" for k in range(30)) for j in range(40)], *["same words " * 15] * 12]
    ids = [None if k in (3, 20, 21) else 5 if k > 58 else k for k in range(len(texts))]
    got = importance.resample(table(spark, texts, ids), table(spark, [None, "t1 t2 t3", "Alpha beta"])).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resample(list(zip(ids, texts, strict=True)), [None, "t1 t2 t3", "Alpha beta"])
    assert importance.resample(table(spark, ["a"]).limit(0), table(spark, ["a"])).count() == 0
    assert [r["rank"] for r in importance.resample(table(spark, ["a b"]), table(spark, ["a"]).limit(0)).collect()] == [None]


@pytest.mark.parametrize("keep", [0, 1, 333, 5000, 9000])
def test_ranks_are_exact_whatever_the_ties(spark, keep):
    """A third of all rows share a score, and many an id too; segments stay of like size."""
    rng = np.random.default_rng(9)
    rows = [(int(i), 30, 1, 0, int(s)) for i, s in zip(rng.integers(0, 3000, 6000), np.where(rng.random(6000) < 0.35, 7, rng.integers(-50, 50, 6000)), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    got = importance.ranked(df, keep).collect()
    order = sorted(rows, key=lambda r: (-r[4], r[0]))[:keep]
    assert sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"]) == [(k, r[4], r[0]) for k, r in enumerate(order, 1)] and len(got) == 6000
    runs = df.withColumns({"down": -F.col("score"), "id": F.col("doc_id"), "row": F.monotonically_increasing_id()}).coalesce(4).sortWithinPartitions("down", "id", "row")
    samples = importance._regular_samples(runs, 16)
    at = np.arange(1, 8) * len(samples[0]) // 8
    sizes = [r["count"] for r in importance._segmented(runs, [c[at] for c in samples]).groupBy("segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 6000 / 8
