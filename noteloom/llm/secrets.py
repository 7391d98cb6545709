"""Secrets: base patterns, and a verdict on every candidate value by who has it. Column expressions only.

Candidates are the values that the base patterns caught, and wider tokens: quoted or assigned ones of 16 and more characters, and bare
random-looking ones of 24 and more. Over the whole corpus, each candidate's hash is counted by distinct owners and distinct repositories.
What many of them share is an example that was copied around, and so is what looks like one; what else one or two have is taken for live, and its place is added as a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IDENTITY, identity, same_identity, written
from .spans import NO_SPANS, clear_of, count_of, distinct, entropy, joined, matches, named

KINDS = ["assign", "access", "hex", "token", "live"]
ASSIGNED, ACCESSED, HEXED, TOKENS, LIVE = range(5)
# Fixed patterns of the contract, with possessive runs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
# The wider tokens: after a quote, "=" or ":", and bare.
TOLD = r"""(?<=["'=:]|[=:]\x20)[A-Za-z0-9+/_=-]{16,}+"""
#: What an example looks like, however few have it.
EXAMPLE = r"(?i)example|sample|dummy|placeholder|change[-_]?me|your[_-]|redacted|(?:x{4}|\*{4}|0123456789|123456789|abcdefgh)|(.)\1{7}"
BARE = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{24,}+"


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, ASSIGNED), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 8)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, ACCESSED, text.contains("AKIA")), matches(text, HEX, HEXED)))


def _values(base: Column) -> Column:
    """The value inside each base span: of an assignment what is assigned, else the whole match."""
    value = lambda s: F.when(s["kind"] == ASSIGNED, F.regexp_extract(s["found"], ASSIGN, 1)).otherwise(s["found"])
    return F.transform(base, lambda s: F.struct((s["end"] - F.length(value(s))).alias("start"), F.lit(LIVE).alias("kind"), s["end"].alias("end"), value(s).alias("found")))


def wide_tokens(text: Column, least_entropy: float = 3.0) -> Column:
    """Tokens beside the base patterns that mix letters and digits and look random: bits a character, over all characters."""
    mixed = lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]") & (entropy(s["found"]) >= least_entropy)
    bare = F.filter(matches(text, BARE, TOKENS), mixed)
    return named(F.filter(matches(text, TOLD, TOKENS), mixed), lambda told: F.concat(told, clear_of(bare, told)))


def secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, owners: int = 2, repositories: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, base spans, found (every candidate value: its span, n_owners, n_repositories, live), added spans, all spans.

    owner and repository default to the source, and the source with the language; a column that docs lacks counts as null, and null
    owners count as one. A candidate is live if at most `owners` owners and `repositories` repositories have its value, wherever in the corpus, and it doesn't look like an
    example (EXAMPLE: told words, runs of one sign, counting up).
    Live candidates are added: the values of base spans as kind live, wider tokens, which overlap no base span, as kind token.
    Null and empty texts have no spans; rows that repeat a doc_id and text each get all spans; two spans of one value are two candidates.
    An empty table gives an empty one; columns other than doc_id, text and those of owner and repository are never read. Very long texts are read whole: patterns take
    time in proportion to a text's length, and spans are held against spans by sorting and halving.
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    owner = has("source") if owner is None else F.coalesce(owner, F.lit(""))
    repository = F.concat_ws("/", has("source"), has("lang")) if repository is None else F.coalesce(repository, F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*identity(docs), text.alias("text"), owner.alias("owner"), repository.alias("repository"))
    rows = rows.select(*IDENTITY, "owner", "repository", base_spans(F.col("text")).alias("base"), wide_tokens(F.col("text")).alias("wide"))
    maybe = named(F.col("base"), lambda base: distinct(F.concat(_values(base), clear_of(F.col("wide"), base))))
    found = written(rows.withColumn("maybe", maybe).drop("wide"), "secrets")
    each = found.where("size(maybe) > 0").select(*IDENTITY, "owner", "repository", F.explode("maybe").alias("span")).withColumn("hash", F.sha2("span.found", 256))
    once = each.select("hash", "owner", "repository").distinct()
    # Written, so that the join has an exchange of its own on both sides and AQE can split a value that a great many texts hold.
    known = written(once.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories")), "secret-owners")
    live = (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories) & ~F.col("span.found").rlike(EXAMPLE)
    verdict = F.struct("span", "n_owners", "n_repositories", live.alias("live"))
    told = each.join(known, "hash").groupBy(*IDENTITY).agg(F.collect_set(verdict).alias("f")).select(*[F.col(c).alias(f"t_{c}") for c in IDENTITY], F.array_sort("f").alias("found"))
    out = found.drop("owner", "repository", "maybe").join(told, same_identity("t_"), "left")
    nothing = F.array().cast(f"array<struct<span:{NO_SPANS[6:-1]},n_owners:bigint,n_repositories:bigint,live:boolean>>")
    out = out.select("doc_id", "base", F.coalesce("found", nothing).alias("found"))
    return out.withColumn("added", F.transform(F.filter("found", lambda f: f["live"]), lambda f: f["span"])).withColumn("spans", F.array_sort(F.concat("base", "added")))


def base_digests(found: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, and more columns."""
    counts = [count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), *more)


def digests(found: DataFrame) -> DataFrame:
    verdicts = [F.size(F.filter("found", test)).cast("long").alias(name) for name, test in (("n_live", lambda f: f["live"]), ("n_copied", lambda f: ~f["live"]))]
    return base_digests(found, *verdicts, joined(F.col("spans"), KINDS).alias("spans"))
