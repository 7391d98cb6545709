"""Keys, paths and note parsing on the small cases that fix their rules."""

import re

import pytest
from pyspark.sql import functions as F

from noteloom.functions import keys, text
from noteloom.functions.frontmatter import parse_yaml
from noteloom.operators import index, links, vectors


def col(spark, values, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(f(F.col("x"))).collect()]


def objects(spark, notes):
    """notes: key -> text, newest last."""
    rows = [(k, key, f"e{k}", len(t or ""), 1000 * k, t) for k, (key, t) in enumerate(notes.items())]
    return spark.createDataFrame(rows, "id long, key string, etag string, size long, modified_ms long, text string")


def test_key_rules(spark):
    assert col(spark, ["notes/plan.md", "../private.md", "notes//plan.md", "/a.md", "a/", " ", None], keys.key_error) == [None, "contains ..", "contains //", "leading or trailing /", "leading or trailing /", "blank", "blank"]
    assert col(spark, ["notes/plan.markdown", "a.MDX", "a.md.png", "x.txt\n"], keys.strip_extension) == ["notes/plan", "a", "a.md.png", "x.txt\n"]
    assert col(spark, [".mineral", ".mineral/x", ".trash/a.md", "mineral/a.md"], keys.is_system_key) == [True, True, True, False]
    assert col(spark, ["a.md", "a.ui.md", "a.png", ".system/a.md", "A.TXT"], keys.is_indexable) == [True, False, False, False, True]
    assert col(spark, ["\\a\\b", "//a/b", "a//b", "a/../b", "", "a\0b", "x" * 4097], keys.canonical_path) == ["a/b", "a/b", None, None, None, None, None]
    assert col(spark, ["", "/", "a/b/", "a//b"], keys.normalize_prefix) == ["", "", "a/b/", None]
    assert col(spark, [".mineral/versions/v1/content/a/b.md", ".history/t/a.md", ".trash/t/a/b.md", ".mineral/versions/v1/manifest.toml", ".mineral/versions/v1/a.md", "a.md"], keys.version_source_path) == ["a/b.md", "a.md", "a/b.md", None, "a.md", None]
    assert col(spark, ['"abc"', "abc", '"', ""], keys.normalize_etag) == ["abc", "abc", '"', ""]
    assert col(spark, ["daily/2026-06-18.md", "20260618.md", "x.md"], keys.date_from_key) == ["2026-06-18", "2026-06-18", None]
    assert col(spark, ["a/b/c.md", "d.md"], keys.ancestors) == [["a", "a/b"], []]
    assert col(spark, ["text/html; x=1", "application/ld+json", "image/png"], keys.is_text_content_type) == [True, True, False]


def test_case_folding_is_ascii(spark):
    assert col(spark, ["NOTES/É.md"], lambda x: keys.has_prefix(x, "notes/É")) == [True]
    assert col(spark, ["NOTES/É.md"], lambda x: keys.has_prefix(x, "notes/é")) == [False]
    assert col(spark, ["100%", "axb"], lambda x: keys.contains(x, "a%b")) == [False, False]


def test_wikilinks_and_tags(spark):
    t = "[[ a ]] [[b|x]] [[b#h]] [[c\nd]] [[]] [[ ]] #one #一/二\xa0#two x#no\n#three #one ##"
    assert col(spark, [t], text.extract_wikilinks) == [["a", "b", ""]]
    assert col(spark, [t], text.extract_body_tags) == [["one", "一/二", "two", "three", "one"]]


def test_headings(spark):
    t = "# One #\r\n~~~\n# no\n```\n~~~\n## Two　\n#three\n```x\n# no\n```\n####### seven\n ### not"
    assert [tuple(h) for h in col(spark, [t], text.extract_headings)[0]] == [(1, "One", 1), (2, "Two", 6)]


@pytest.mark.parametrize("block, want", [
    ("a: yes\nb: 012\nc: 1.0\nd: 2024-01-02\ne: 0o17\nf: null\ng: 1:30", '{"a":"yes","b":12,"c":1,"d":"2024-01-02","e":15,"f":null,"g":"1:30"}'),
    ("a: 1\na: 2", None), ("- x", None), ("a: [1", None), ("x: {y: [true, ~, 0x1F]}", '{"x":{"y":[true,null,31]}}'), ("x:", '{"x":null}'), ("1: a", '{"1":"a"}'),
])
def test_yaml_is_core_schema(block, want):
    assert parse_yaml(block)[0] == want


def test_derived_rows(spark):
    note = "---\ntitle: ' Derived '\ntags: 'alpha, #beta'\nn: 1.0\nok: true\n---\n# First\n\n## Second\n\n#alpha #alpha [[other-note]]"
    x = index.build_index(objects(spark, {"a/n.md": note, "b.md": "---\nbad: [\n---\nbody", "c.png": "x", "d.md": None}))
    assert {(r.key, r.title) for r in x.documents.collect()} == {("a/n.md", "Derived"), ("b.md", "b"), ("d.md", "d")}
    assert {(r.tag, r.source, r.occurrences) for r in x.tags.collect()} == {("alpha", "frontmatter", 1), ("beta", "frontmatter", 1), ("alpha", "body", 2)}
    assert [(r.ordinal, r.level, r.text, r.line) for r in x.headings.orderBy("ordinal").collect()] == [(0, 1, "First", 1), (1, 2, "Second", 3)]
    assert {(r.field, r.value) for r in x.front.collect()} == {("title", " Derived "), ("tags", "alpha, #beta"), ("n", "1"), ("ok", "true")}
    assert [r.to_key for r in x.links.collect()] == ["other-note"]
    assert x.documents.where("key = 'b.md'").first().body == "body"


def chunked(spark, texts):
    rows = vectors.chunk_documents(index.parse_documents(objects(spark, texts))).collect()
    ids = {r.id: r.key for r in objects(spark, texts).collect()}
    out = {k: [] for k in texts}
    for r in sorted(rows, key=lambda r: (r.document_id, r.ordinal)):
        assert r.ordinal == len(out[ids[r.document_id]])
        out[ids[r.document_id]].append((r.heading, r.text))
    return out


def test_chunks(spark):
    pages = {"T.md": "intro\n\n## A\ntext a\n\n## B\n```\n# no\n```\n", "E.md": "  \n", "L.md": "x" * 4000, "P.md": "\n\n".join(f"p{k} " + "y" * 300 for k in range(9)), "H.md": "# Only\n"}
    got = chunked(spark, pages)
    assert got["T.md"] == [("T", "intro"), ("A", "text a"), ("B", "```\n# no\n```")]
    assert got["E.md"] == [("E", "E")] and got["H.md"] == [("Only", "Only")]
    assert len(got["L.md"]) > 1 and all(len(t) <= 1500 for _, t in got["L.md"])
    assert len(got["P.md"]) > 2 and all(a[1][-150:] in b[1] for a, b in zip(got["P.md"], got["P.md"][1:], strict=False))


def test_chunks_cover_the_text(spark):
    """Whatever is in a section's paragraphs is in its chunks, in order, but for what an overlap pushes over the most a chunk may hold."""
    import random

    rng = random.Random(3)
    pages = {f"n{k}.md": "\n\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(1, 12))) for k in range(20)}
    for key, got in chunked(spark, pages).items():
        assert all(len(t) <= 1500 for _, t in got)
        words = [w for _, t in got for w in t.split()]
        assert set(pages[key].split()) <= set(words)


def test_digests(spark):
    assert col(spark, ["abc"], lambda x: text.base64url(F.sha2(x, 256))) == ["ungWv48Bz-pBQUDeXa4iI7ADYaOWF3qctBD_YfIAFa0"]
    ids = {col(spark, ["s"], lambda x, k=k: text.chunk_id(F.lit(1), x, F.lit(1), F.lit("m"), F.lit(1), F.lit(k)))[0] for k in range(3)}
    assert len(ids) == 3 and all(len(i) == 32 for i in ids)


def test_hash_embedding():
    a, b, c = (vectors.hash_embedding(x) for x in ("alpha beta gamma", "alpha beta delta", "zeta eta theta"))
    assert a @ b > a @ c and vectors.hash_embedding("").any() and vectors.hash_embedding("心率").any()
    texts = ["Alpha alpha_1 beta", "", "心率 x", "alpha", "!!!"]
    def fnv(x):
        h = 0x811C9DC5
        for c in x:
            h = (h ^ ord(c)) * 0x01000193 % (1 << 32)
        return h

    assert fnv("") == 0x811C9DC5 and fnv("a") == 0xE40C292C and fnv("foobar") == 0xBF9CF968  # published values of the hash
    for x, got in zip(texts, vectors.hash_embed(texts, 64), strict=True):  # the same, one token at a time; in company or alone
        want = [0.0] * 64
        for t in re.findall("[a-z0-9_]+|[㐀-鿿]", x.lower()):
            want[fnv(t) % 64] += -1.0 if fnv(t + "\0sign") & 1 else 1.0
        if not any(want):
            want[fnv(x) % 64] = 1.0
        assert got.tolist() == want and vectors.hash_embedding(x, 64).tolist() == want


def test_embed_checks_the_model(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="wrong number"):
        vectors.embed(df, lambda xs: [[1.0]]).collect()


def test_rewrite():
    assert links.rewrite_text("[[a]] [[ d/a |x]] [[b#h]] [[ab]]", {"a": "new", "d/a": "new"}) == "[[new]] [[new|x]] [[b#h]] [[ab]]"


def test_accents(spark):
    assert col(spark, ["Crème-BRÛLÉE a_b 心率 x2"], text.tokenize) == [["creme", "brulee", "a", "b", "心率", "x2"]]
