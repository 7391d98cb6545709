"""URL filter: fixed rules first, else gradient-boosted trees on lexical features. Column expressions and Spark's ML only.

A rule (verdict, host, path) fits its host and all subdomains, for paths that start with the rule's; the longest fitting rule
wins. The URLs that a rule decides are the labels the trees are trained on; the trees decide the rest.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import entropy

# The rules as the contract fixes them.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_dots", "f_hyphens", "f_fragment", "f_suffix", "f_suffix_n", "f_segment", "f_segment_n"]


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def decided(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule, else nulls. A list of up to some hundreds becomes one CASE."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    n = F.greatest(F.length(url), F.lit(1))
    many = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    has = lambda sign: url.contains(sign).cast("int")
    figures = [F.length(url), F.length(host), F.length(path), many(path, "/"), F.length(F.regexp_replace(url, "[^0-9]", "")) / n, entropy(url), many(url, "&") + has("?"), many(host, "."), many(host, "-"), has("#")]
    return [F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for x, name in zip(figures, FEATURES, strict=False)]


FOLDS = 5  # the first is kept apart from the training


def scored(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, fit_rows: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, told, held_out, score) for every row: what the rules say, and the trees' probability of block.

    Suffix statistics (the last host label, and the first path segment: smoothed share of block, log of its labelled URLs) cover all labelled rows; a labelled row's own
    fold is left out of its figures, so that no label speaks for itself. fit_rows bounds (about) the labelled rows that train the trees.
    """
    rules = RULES if rules is None else rules
    pages = pages.select(F.col("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"))
    host, path = host_path(F.col("url"))
    parts = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("told", verdict).withColumn("suffix", F.regexp_extract("host", r"([^.]*)\z", 1)).withColumn("segment", F.regexp_extract("path", "^/([^/]*)", 1)).withColumn("fold", F.pmod(F.xxhash64("url", "page_id"), F.lit(FOLDS)).cast("int"))
    blocked = (F.col("told") == "block").cast("long")
    tally = lambda x: F.array(*[F.sum(F.when(F.col("fold") == k, x).otherwise(0)).cast("long") for k in range(FOLDS)])
    stats = {key: written(parts.where("told is not null").groupBy(F.col(key).alias("s")).agg(tally(F.lit(1)).alias("n"), tally(blocked).alias("b")), f"url-{key}") for key in ("suffix", "segment")}
    all_ = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    total = stats["suffix"].agg(F.coalesce(F.sum(all_(F.col("n"))), F.lit(0)), F.coalesce(F.sum(all_(F.col("b"))), F.lit(0))).first()
    full = parts.select("page_id", "url", "host", "path", "rule", "told", "suffix", "segment", "fold")
    named = ["page_id", "host", "path", "rule", "told", (F.col("fold") == 0).alias("held_out")]
    if not 0 < total[1] < total[0]:
        return full.select(*named, F.lit(float(bool(total[1]))).alias("score"))
    base = total[1] / total[0]
    own = lambda c: F.when(F.col("told").isNotNull(), F.get(F.col(c), F.col("fold"))).otherwise(0)
    for key, known in stats.items():
        full = full.join(known, F.col(key) == F.col("s"), "left")
        full = full.withColumn("__n", F.coalesce(all_(F.col("n")) - own("n"), F.lit(0))).withColumn("__b", F.coalesce(all_(F.col("b")) - own("b"), F.lit(0)))
        full = full.withColumn(f"f_{key}", (F.col("__b") + 10 * base) / (F.col("__n") + 10)).withColumn(f"f_{key}_n", F.log1p("__n")).drop("s", "n", "b", "__n", "__b")
    full = full.select("page_id", "url", "host", "path", "rule", "told", "fold", *[f"f_{key}{x}" for key in stats for x in ("", "_n")], *lexical(F.col("url"), F.col("host"), F.col("path")))
    full = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
    share = min(1.0, fit_rows / total[0])
    sample = full.where(F.col("told").isNotNull() & (F.col("fold") > 0) & (F.pmod(F.xxhash64(F.lit(1), "url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    sample = written(sample.select("features", (F.col("told") == "block").cast("double").alias("label")), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return full.select(*named, F.lit(base).alias("score"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.3).fit(sample)
    return model.transform(full).withColumn("score", vector_to_array("probability")[1]).select(*named, "score")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, fit_rows: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row: the rule's verdict, else block from a score of 0.5 on.

    Where labels have one class only, undecided URLs get that class; where there are none, allow. Null URLs, and those without ://, have empty host and path; rows alike get the same
    verdict, each its own row; very long URLs are read whole; an empty table gives an empty one; other columns of pages are never read.
    """
    other = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored(pages, rules, fit_rows, trees, depth).select("page_id", "host", "path", "rule", F.coalesce("told", other).alias("verdict"), "score")


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, **settings) -> DataFrame:
    """One row: labelled URLs kept apart from the training, and those that the trees judge as the rules do."""
    right = (F.col("score") >= 0.5) == (F.col("told") == "block")
    return scored(pages, rules, **settings).where("held_out and told is not null").agg(F.count("*").alias("n"), F.count_if(right).alias("right"))
