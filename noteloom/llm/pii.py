"""Personal data: base patterns, and candidates that boosted trees accept. Column expressions and Spark's ML only.

Generators of high recall propose overlapping spans: groups of digits of any punctuation and length, addresses with or without a
domain ending or written around "at" and "dot", account codes. Boosted trees score every candidate from format and context alone. What they learn
from: candidates that a strict pattern confirms are positive; those that have the shape of a strict pattern but fail its check (a check digit, a part over
255, too many digits) are unlabelled, as a mistyped or unlisted number is personal data too; all others are negative. Scores are calibrated on
documents kept apart (isotonic over steps of the score), and candidates clear of the base spans are redacted from the threshold on.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IDENTITY, identity, same_identity, written
from .spans import NO_SPANS, clear_of, count_of, digits, joined, luhn, matches

KINDS = ["email", "ip", "card", "phone", "likely"]
LIKELY = 4
# Fixed patterns of the contract, with possessive runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The loose generators.
NUMBERS = r"(?:\G|(?<![0-9A-Za-z]))\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9])++(?![0-9A-Za-z])"
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
WRITTEN = r"(?i)(?:\G|(?<![a-z0-9._-]))[a-z0-9._-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[a-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?)[a-z0-9-]++)*+"
ACCOUNT = r"(?:\G|(?<![0-9A-Za-z]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,8}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"
FEATURES = ["digits", "length", "plus", "parens", "dots", "hyphens", "spaces", "groups", "longest", "letters", "at", "named", "boxed"]


def base_spans(text: Column) -> Column:
    has = text.rlike("[0-9]")
    ip = F.filter(matches(text, IP, 1, has), lambda s: F.forall(F.split(s["found"], r"\."), lambda x: x.cast("double") <= 255))
    card = F.filter(matches(text, CARD, 2, has), lambda s: F.length(digits(s["found"])).between(14, 19) & luhn(digits(s["found"])))
    phone = F.filter(matches(text, PHONE, 3, text.contains("+")), lambda s: F.length(digits(s["found"])).between(10, 15))
    return F.array_sort(F.concat(matches(text, EMAIL, 0, text.contains("@")), ip, card, phone))


def loose_spans(text: Column) -> Column:
    """Every candidate; they may overlap."""
    found = [matches(text, NUMBERS, LIKELY, text.rlike("[0-9]")), matches(text, ADDRESS, LIKELY, text.contains("@")), matches(text, WRITTEN, LIKELY, text.rlike(r"(?i)[\[({]at[\])}]")), matches(text, ACCOUNT, LIKELY, text.rlike("[A-Z]{2}[0-9]{2}"))]
    return F.array_distinct(F.concat(*found))


def _features(span: Column, before: Column, after: Column) -> list[Column]:
    x = span["found"]
    many = lambda sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    runs = F.transform(F.split(x, "[^0-9]+"), lambda r: F.length(r))
    figures = [
        F.length(digits(x)), F.length(x), x.startswith("+").cast("int"), many("("), many("."), many("-"), many(" "), F.size(runs), F.array_max(runs), F.length(x) - F.length(F.regexp_replace(x, "[A-Za-z]", "")),
        x.rlike(r"(?i)@|[\[({]at[\])}]").cast("int"),
        F.lower(before).rlike("(?:phone|tel|call|mobile|fax|card|visa|ip|mail|ssn|iban|account)[^a-z]{0,4}$").cast("int"), (before.rlike(r"(?:^|\s)$") & after.rlike(r"^(?:$|\s|[.,;])")).cast("int"),
    ]
    return [f.cast("double").alias(n) for f, n in zip(figures, FEATURES, strict=True)]


def _label(span: Column, base: Column) -> Column:
    """1: a base span covers the candidate and is hardly longer. Null: it overlaps one otherwise, or has a strict pattern's shape and fails its check. Else 0."""
    x, n = span["found"], F.length(digits(span["found"]))
    covers, meets = F.exists(base, lambda o: (o["start"] <= span["start"]) & (o["end"] >= span["end"]) & (span["end"] - span["start"] >= 0.8 * (o["end"] - o["start"]))), F.exists(base, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
    shaped = x.rlike(r"^[0-9]++(?:\.[0-9]++){3}$") | (x.rlike(r"^[0-9](?:[\x20-]?[0-9])*+$") & (n >= 14)) | (x.startswith("+") & (n >= 10)) | x.rlike(r"(?i)@|[\[({]at[\])}]") | x.rlike("^[A-Z]{2}[0-9]{2}")
    return F.when(covers, 1.0).when(meets | shaped, F.lit(None)).otherwise(0.0)


def isotonic(steps: list[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """(step, n, positives) in rising order of step to (step, share), rising: neighbours that fall are pooled."""
    pools: list[list] = []
    for step, n, y in steps:
        pools.append([[step], n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return [(s, y / n) for at, n, y in pools for s in at]


def _calibrated(score: Column, steps: list[tuple[int, float]]) -> Column:
    """The share of the highest step at or below the score; below all of them, that of the lowest."""
    out = F.lit(steps[0][1]) if steps else score
    before = None
    for step, share in steps:
        out, before = (F.when(score >= step / STEPS, F.lit(share)).otherwise(out) if share != before else out), share
    return out


STEPS = 50


def scored(docs: DataFrame, fit_rows: int = 20_000, trees: int = 8, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Documents: identity, base spans. Candidates: identity, span, label, held_out, score (calibrated; null if nothing could be learned)."""
    text = F.col("text")
    rows = docs.select(*identity(docs), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select(*IDENTITY, "text", base_spans(text).alias("base"), loose_spans(text).alias("loose"))
    around = lambda s: F.struct(s.alias("span"), F.substring(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16))).alias("before"), F.substring(text, s["end"] + 1, F.lit(8)).alias("after"), _label(s, F.col("base")).alias("label"))
    found = written(rows.select(*IDENTITY, "base", F.transform("loose", around).alias("loose")), "pii")
    held = (F.pmod(F.xxhash64("k1", "k2"), F.lit(5)) == 0).alias("held_out")
    each = found.where("size(loose) > 0").select(*IDENTITY, held, F.explode("loose").alias("c")).select(*IDENTITY, "held_out", "c.span", "c.label", *_features(F.col("c.span"), F.col("c.before"), F.col("c.after")))
    each = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(each).drop(*FEATURES), "pii-candidates")
    known = each.where("label is not null")
    share = min(1.0, fit_rows / max(1, known.where("not held_out").count()))
    sample = written(known.where(~F.col("held_out") & (F.pmod(F.xxhash64(F.lit(2), "k1", "k2", "span.start"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("features", "label"), "pii-sample")
    if sample.select("label").distinct().count() < 2:
        return found.drop("loose"), each.drop("features").withColumn("score", F.lit(None).cast("double"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.3, maxBins=32).fit(sample)
    raw = written(model.transform(each).withColumn("raw", vector_to_array("probability")[1]).select(*IDENTITY, "span", "label", "held_out", "raw"), "pii-scores")
    steps = raw.where("held_out and label is not null").groupBy(F.floor(F.col("raw") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("step").collect()
    return found.drop("loose"), raw.withColumn("score", _calibrated(F.col("raw"), isotonic([tuple(r) for r in steps]))).drop("raw")


def personal_data(docs: DataFrame, fit_rows: int = 20_000, threshold: float = 0.9, trees: int = 8, depth: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, base spans, found (every candidate: span, score, redact), added spans (kind likely), all spans.

    fit_rows bounds (about) the candidates that train the trees. A candidate is redacted at a calibrated score of the threshold and above; redacted ones that are clear of
    all base spans, and of longer redacted ones, are added. With no candidates of one class nothing is added, and scores are null. Null and empty texts have no spans; rows
    that repeat a doc_id and text each get the same; an empty table gives an empty one; other columns are never read. Patterns take time in proportion to a
    text's length, so very long ones are read whole.
    """
    rows, each = scored(docs, fit_rows, trees, depth)
    told = each.groupBy(*IDENTITY).agg(F.array_sort(F.collect_set(F.struct("span", "score", (F.coalesce("score", F.lit(0.0)) >= threshold).alias("redact")))).alias("found"))
    out = rows.join(told.select(*[F.col(c).alias(f"t_{c}") for c in IDENTITY], "found"), same_identity("t_"), "left")
    nothing = F.array().cast(f"array<struct<span:{NO_SPANS[6:-1]},score:double,redact:boolean>>")
    out = out.select("doc_id", "base", F.coalesce("found", nothing).alias("found"))
    redacted = clear_of(F.transform(F.filter("found", lambda f: f["redact"]), lambda f: f["span"]), F.col("base"))
    alone = lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & ((o["end"] - o["start"] > s["end"] - s["start"]) | ((o["end"] - o["start"] == s["end"] - s["start"]) & (o["start"] < s["start"])))))
    return out.withColumn("redacted", redacted).withColumn("added", alone(F.col("redacted"))).drop("redacted").withColumn("spans", F.array_sort(F.concat("base", "added")))


def held_out_quality(docs: DataFrame, threshold: float = 0.9, fit_rows: int = 20_000) -> DataFrame:
    """One row: candidates kept apart from the training, those redacted, right ones among them, and all confirmed ones."""
    hit = F.coalesce("score", F.lit(0.0)) >= threshold
    return scored(docs, fit_rows)[1].where("held_out and label is not null").agg(F.count("*").alias("n"), F.count_if(hit).alias("redacted"), F.count_if(hit & (F.col("label") == 1)).alias("right"), F.count_if(F.col("label") == 1).alias("positive"))


def base_digests(found: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, and more columns."""
    counts = [count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), *more)


def digests(found: DataFrame) -> DataFrame:
    return base_digests(found, F.size("added").cast("long").alias("n_likely"), joined(F.col("spans"), KINDS).alias("spans"))
