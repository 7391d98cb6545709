"""The registered queries of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, exact_dedup, importance, line_dedup, packing, pii, quality, secrets, simhash, toxicity, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.default_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lines_total", "lines_removed", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.round(F.coalesce(F.array_max("scores"), F.lit(0.0)), 6).alias("score"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_path())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def secret_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op6 alone, as SQL can tell them too."""
    docs = table(spark, sf_dir, "documents")
    return secrets.base_digests(docs.select("doc_id", secrets.base_spans(F.coalesce("text", F.lit(""))).alias("base")))


def private_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op10 alone."""
    docs = table(spark, sf_dir, "documents")
    return pii.base_digests(docs.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("base")))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op9 alone."""
    host, path = url_filter.host_path(F.col("url"))
    parts = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = url_filter.decided(F.col("host"), F.col("path"), url_filter.RULES)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("told"))


def _found(kinds: list[tuple[str, str, str]]) -> str:
    """SQL of counts and digest by kind: (name, pattern, which matches stay). A match begins where the pieces and matches before it end."""
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, '{name}' AS name, unnest(list_transform(range(1, len(f) + 1), lambda k: {{'place': CAST(list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS BIGINT), 'found': f[k]}}), recursive := true) FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS b FROM d) AS m{n}"
        for n, (name, pattern, _) in enumerate(kinds)
    )
    keep = " OR ".join(f"(name = '{name}' AND {keep})" for name, _, keep in kinds)
    counts = ", ".join(f"count(*) FILTER (name = '{name}') AS n_{name}" for name, *_ in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT * FROM ({parts}) AS a WHERE {keep})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(name || ':' || place || ':' || (place + length(found)), ',' ORDER BY place, kind), '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FIGURES = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_FIGURES}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({_FIGURES}), k, 1) AS INTEGER) ELSE CAST(substr(reverse({_FIGURES}), k, 1) AS INTEGER) * 2 % 10 + CAST(substr(reverse({_FIGURES}), k, 1) AS INTEGER) * 2 // 10 END)) % 10 = 0"
_SECRETS = _found([("assign", _ASSIGN, f"length(regexp_extract(found, '{_ASSIGN}', 1)) >= 8"), ("access", "AKIA[A-Z0-9]+", "length(found) >= 16"), ("hex", "[0-9a-f]+", "length(found) >= 32")])
_PRIVATE = _found([
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "TRUE"), ("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(found, '.'), lambda p: CAST(p AS DOUBLE) > 255)) = 0"),
    ("card", "[0-9](?:[\\x20-]?[0-9])+", f"length({_FIGURES}) BETWEEN 14 AND 19 AND {_LUHN}"), ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_FIGURES}) BETWEEN 10 AND 15"),
])
_UNDER = lambda host: f"(host = '{host}' OR ends_with(host, '.{host}'))"
_RULE = lambda what: "CASE " + " ".join(f"WHEN {_UNDER(h)} AND starts_with(path, '{p}') THEN '{v if what else h + p}'" for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_URLS = f"SELECT *, {_RULE(0)} AS rule, {_RULE(1)} AS told FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages) AS p"

QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_toxicity, op4_exact, op5_lines, op6_secrets, op7_quality, op8_decontaminate, op9_urls, op10_pii, op11_packing, op12_collocations, op13_resampling, secret_bases, private_bases, url_rules)}
ORACLES = {"op4_exact": exact_dedup.ORACLE, "op12_collocations": collocations.ORACLE, "secret_bases": _SECRETS, "private_bases": _PRIVATE, "url_rules": _URLS}
