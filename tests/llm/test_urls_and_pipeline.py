"""The URL filter, the pipeline against a plain version, and life without the subpackage."""

import os
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noteloom.llm import bpe, decontaminate, line_dedup, quality, url_filter
from noteloom.llm.common import table as read

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "example.org/x", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=1", "http://notexample.org/es/1", "ftp://x.com/fr/a#b", "http://com/de/", "http://x.com/DE/", "http://a.org", "http://a.org?x/", "http://b.net/de/1", "http://x.com/fr/de/://y", "a://b://c.org/", "http:// s.com/de/\nx"]


def test_rules(spark):
    many = URLS + [f"http://h{k}.{s}/{p}/{k}" for k in range(40) for s, p in (("com", "fr"), ("com", "de"), ("org", "en"), ("net", "xx"))]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(many)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "score", "features", "label", "n")})
    for r in url_filter.judged(pages).collect():
        host, path, rule, verdict = brute_rule(many[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), many[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_trees_learn_what_rules_label(spark):
    """Held-out accuracy on URLs whose label the features carry."""
    urls = [(k, f"http://www.shop{k}.com/de/{k}{'9' * 30}?a=1&b=2&c=3" if k % 2 else f"http://site{k}.com/fr/story") for k in range(400)]
    other = [(1000 + k, f"http://www.mall{k}.net/x/{k}{'8' * 30}?a=1&b=2&c=3" if k % 2 else f"http://page{k}.net/fr/tale") for k in range(100)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(urls + other, "page_id long, url string")).collect()}
    assert sum(got[1000 + k].verdict == ("block" if k % 2 else "allow") for k in range(100)) >= 95


@pytest.mark.parametrize("urls", [[], [None, "x"], ["http://a.org/"], ["http://a.com/de/x"]])
def test_few_labels(spark, urls):
    got = url_filter.judged(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")).collect()
    assert len(got) == len(urls) and all(r.verdict for r in got)


def test_trees_agree_with_the_rules_on_urls_kept_apart(spark):
    got = url_filter.held_out_accuracy(read(spark, "/root/testdata/sf0.1", "pages")).first()
    assert got.n > 150 and got.right >= 0.9 * got.n


def test_long_and_repeated_urls(spark):
    long = "http://" + "a" * 50_000 + ".com/de/" + "x/" * 50_000
    rows = [(1, long), (1, long), (None, "http://a.org/"), (2, None), (3, "no scheme")]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string").withColumn("told", F.lit("x")).withColumn("host", F.lit("y"))).collect()
    assert len(got) == 5 and [len(r.path) for r in got if r.page_id == 1] == [100_004] * 2 and {(r.host, r.path) for r in got if r.page_id in (2, 3)} == {("", "")}
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_pipeline(spark):
    """The same decisions, taken one document at a time in plain Python; models are the stages' own."""
    docs = read(spark, SF, "documents")
    weights = quality.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}

    def good(t):
        n, f = quality.ratios(t)
        return weights[-1] + (sum(weights[k] * x for k, x in quality.hashed(t, n, f).items()) if n else 0) >= 0

    rows = {i: t for i, t in rows.items() if good(t)}
    seen, out = set(), {}
    for i in sorted(rows):
        lines, drop = line_dedup.lines_of(rows[i] or ""), set()
        for p in range(len(lines) - 2):
            w = tuple(x.strip() for x in lines[p : p + 3])
            drop |= set(range(p, p + 3)) if w in seen else set()
            seen.add(w)
        text = "".join(x for k, x in enumerate(lines) if k not in drop) if drop else rows[i]
        if not drop or text.strip(" "):
            out[i] = text
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    sets, root = [(i, grams(t)) for i, t in sorted(out.items())], {i: i for i in out}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    out = {i: t for i, t in out.items() if top(i) == i}
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]

    def leaks(t):
        w = decontaminate.words_of(t)
        have = {n: decontaminate.shingles(w, n) for n in range(1, 6)}
        for _, x in items:
            parts = decontaminate.question_answer(x)
            if all(len((s := decontaminate.shingles(p, min(5, len(p)))) & have[min(5, len(p))]) >= 0.8 * len(s) for p in parts):
                return True
        return False

    tok = __import__("tokenizers").Tokenizer.from_file(bpe.default_path())
    return {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in out.items() if not leaks(t)}


def test_pipeline_equals_the_plain_version(spark):
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == plain_pipeline(spark)


def test_stages_keep_the_columns(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_library_lives_without_the_subpackage(tmp_path):
    """Everything else imports, and no query of the subpackage is registered, once its folders are gone."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    # The copy comes first; what the environment has besides (it may be where installed packages come from) stays, but for this tree.
    others = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": ":".join([str(tmp_path / "r"), *others])}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
    rest = [sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider"]
    assert subprocess.run(rest, cwd=tmp_path / "r", env=env).returncode == 0
