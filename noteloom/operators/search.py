"""Text search: the query planner, postings, BM25, phrases, names and their merge."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import keys, text

from .index import Index

# Fixed weights of the ranked columns; the path isn't searched.
WEIGHTS = {"title": 10.0, "headings": 4.0, "tags": 2.0, "body": 1.0}
COLUMNS = {"title": "title", "headings": "heading_text", "tags": "tag_text", "body": "body"}
TIERS = {"exact": 0, "prefix": 1, "substring": 3, "path": 4}
CONTENT_TIER = 2
GRAM = 3
_SEGMENT = re.compile(rf"([{text.CJK}]+)|([A-Za-z0-9_]+)")


@dataclass
class Plan:
    """parts: quoted terms and operators in order; runs: CJK runs; anchor: the longest of them, the first of equals."""

    parts: list[str]
    runs: list[str]

    @property
    def match(self) -> str | None:
        return " ".join(p if p in ("AND", "OR", "NOT") else f'"{p}"' for p in self.parts) or None

    @property
    def anchor(self) -> str | None:
        return max(self.runs, key=len, default=None)

    @property
    def empty(self) -> bool:
        return not self.parts and not self.runs

    def terms(self) -> list[tuple[str, ...]]:
        """Each quoted term as the tokens it means: an underscore separates, so a_b is the phrase a b."""
        return list(dict.fromkeys(t for p in self.parts if p not in ("AND", "OR", "NOT") if (t := _tokens(p))))

    def predicate(self, has) -> Column | None:
        """NOT binds tighter than AND, AND tighter than OR. has(term) gives the column that says a document holds it."""
        ors: list[Column] = []
        at, ands, negated = 0, None, False
        while at < len(self.parts):
            p = self.parts[at]
            if p == "OR":
                ors, ands = [*ors, ands], None
            elif p in ("NOT", "AND"):
                negated = p == "NOT"
            else:
                one = has(_tokens(p))
                one = ~one if negated else one
                ands = one if ands is None else ands & one
                negated = False
            at += 1
        out = ands
        for x in ors:
            out = x if out is None else out | x
        return out


def _tokens(term: str) -> tuple[str, ...]:
    return tuple(t for t in term.lower().split("_") if t)


def plan_text_query(query: str) -> Plan:
    """Operators that dangle or repeat are dropped; terms side by side are joined by AND."""
    parts: list[str] = []
    runs: list[str] = []
    operand = False
    for run, word in _SEGMENT.findall(query.strip()):
        if run:
            runs.append(run)
        elif word in ("AND", "OR", "NOT"):
            if operand:
                parts.append(word)
                operand = False
        else:
            parts += ["AND"] * operand + [word]
            operand = True
    if parts and not operand:
        parts.pop()
    return Plan(parts, runs)


def build_postings(index: Index) -> DataFrame:
    """(document_id, column, token, n, positions) of every document."""
    return postings_of(index.documents.select(F.col("id").alias("document_id"), *tokens_by_column().values()))


def tokens_by_column() -> dict[str, Column]:
    return {n: text.tokenize(F.coalesce(F.col(c), F.lit(""))).alias(n) for n, c in COLUMNS.items()}


def postings_of(rows: DataFrame) -> DataFrame:
    """rows: document_id and an array of tokens for each ranked column. The tokens of one column of a document are grouped inside a batch, so nothing is shuffled."""
    names = list(COLUMNS)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for name in names:
                    yield _grouped(name, part.column("document_id"), part.column(name))

    return rows.mapInArrow(run, "document_id long, column string, token string, n long, positions array<int>")


def _grouped(name: str, ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    """The postings of one column of some documents."""
    size = np.diff(lists.offsets.to_numpy())
    tokens = lists.flatten().dictionary_encode()
    document, code = np.repeat(np.arange(len(size)), size), tokens.indices.to_numpy().astype(np.int64)
    return _cut(name, ids, document, code, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size), tokens.dictionary)


def _cut(name: str, ids: pa.Array, document: np.ndarray, code: np.ndarray, place: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    """Places, rising in each document, sorted by document and token and cut where either changes."""
    by = np.lexsort((code, document))
    document, code = document[by], code[by]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(by), 1), bool), (document[1:] != document[:-1]) | (code[1:] != code[:-1])]))
    ends = np.append(new, len(by)).astype(np.int32)
    cols = [ids.take(pa.array(document[new])), pa.array([name] * len(new), pa.string()), tokens.take(pa.array(code[new])), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[by].astype(np.int32)))]
    return pa.RecordBatch.from_arrays(cols, ["document_id", "column", "token", "n", "positions"])


def grams_of(documents: DataFrame) -> DataFrame:
    """Postings of CJK bigrams in the ranked columns of documents (id, title, ...): (document_id, column, token, n, positions).

    Each CJK character has one: with the CJK character after it, or alone where none follows. positions count characters from 0, so a run of
    characters stands where its bigrams do, each at its distance. Nothing is shuffled; null columns are empty.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for name in COLUMNS:
                    yield _bigrams(name, part.column("id"), part.column(name))

    rows = documents.select("id", *[F.coalesce(c, F.lit("")).alias(n) for n, c in COLUMNS.items()])
    return rows.mapInArrow(run, "document_id long, column string, token string, n long, positions array<int>")


def _bigrams(name: str, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One column's bigrams, for all texts of a batch at once."""
    strings = texts.to_pylist()
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    chars = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_cjk = (chars >= ord(text.CJK[0])) & (chars <= ord(text.CJK[-1]))
    at = np.flatnonzero(is_cjk)
    ends = np.cumsum(size)
    document = np.searchsorted(ends, at, "right")
    follows = at + 1 < ends[document]
    follows[follows] = is_cjk[at[follows] + 1]
    second = np.where(follows, chars[np.minimum(at + 1, max(len(chars) - 1, 0))], 0) if len(at) else at
    pairs, code = np.unique(chars[at] << 16 | second, return_inverse=True)
    tokens = pa.array([chr(p >> 16) + (chr(p & 0xFFFF) if p & 0xFFFF else "") for p in pairs.tolist()], pa.string())
    return _cut(name, ids, document, code, at - (ends - size)[document], tokens)


def names_of(documents: DataFrame) -> DataFrame:
    """(document_id, gram, key, modified_ms): the distinct three-character pieces of each key, A-Z folded, one from every place; those at the end are shorter.

    Rows hold what questions about names return, so that documents aren't read for them.
    """
    low = keys.ascii_fold(F.col("key"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.substring(low, k, F.lit(GRAM))))
    return documents.select(F.col("id").alias("document_id"), F.explode(grams).alias("gram"), "key", "modified_ms")


def names_holding(index: Index, part: str) -> DataFrame:
    """(key, modified_ms) of the notes whose key contains a part, whatever the case of A-Z.

    Parts of three characters and more read the rows of their rarest piece, shorter ones those whose piece begins so: both are filters on the sorted gram column.
    """
    if not part:
        return index.documents.select("key", "modified_ms")
    names, low = names_of(index.documents) if index.names is None else index.names, part.translate(str.maketrans(keys.UPPER, keys.LOWER))
    if len(low) < GRAM:
        return names.where(F.col("gram").startswith(low)).select("document_id", "key", "modified_ms").distinct().select("key", "modified_ms")
    grams = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    if len(grams) > 1:  # one row a piece of the question
        found = {r.gram: r["count"] for r in names.where(F.col("gram").isin(grams)).groupBy("gram").count().collect()}
        grams.sort(key=lambda g: found.get(g, 0))
    return names.where((F.col("gram") == grams[0]) & keys.contains(F.col("key"), part)).select("key", "modified_ms")


def _counts(postings: DataFrame, terms: list[tuple[str, ...]]) -> DataFrame:
    """(document_id, w0, w1, ...): weighted counts of each term (a token, or tokens in a row) in every document that has any. Only the terms' tokens are read."""
    rows = postings.where(F.col("token").isin(sorted({t for term in terms for t in term})))
    places = lambda t: F.coalesce(F.max(F.when(F.col("token") == t, F.col("positions"))), F.array().cast("array<int>"))
    tokens = sorted({t for term in terms for t in term})
    name = {t: f"p{k}" for k, t in enumerate(tokens)}
    by_column = rows.groupBy("document_id", "column").agg(*[places(t).alias(name[t]) for t in tokens])

    def times(term: tuple[str, ...]) -> Column:
        if len(term) == 1:
            return F.size(name[term[0]])
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col(name[t]), p + k) for k, t in enumerate(term) if k])
        return F.size(F.filter(F.col(name[term[0]]), follows))

    weight = F.element_at(F.create_map(*[F.lit(x) for n, w in WEIGHTS.items() for x in (n, float(w))]), F.col("column"))
    return by_column.groupBy("document_id").agg(*[F.sum(weight * times(t)).alias(f"w{k}") for k, t in enumerate(terms)])


def _of_prefix(index: Index, prefix: str) -> DataFrame:
    return index.documents.where(keys.has_prefix(F.col("key"), prefix)).select(F.col("id").alias("document_id"), "key", "title", "modified_ms", "size", "length")


def search_bm25(index: Index, query: str, prefix: str = "", limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, title, modified_ms, size, score, snippet), smaller scores first: ranked columns weigh 10, 4, 2 and 1, and the sum of all is negated.

    Of the postings only those of the query's tokens are read. Statistics are those of all documents, whatever the prefix. Bodies are read for the results alone.
    """
    plan = plan_text_query(query)
    terms = plan.terms()
    if not terms:
        return index.documents.select("key", "title", "modified_ms", "size", F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    postings = build_postings(index) if index.postings is None else index.postings
    counts = _counts(postings, terms)
    place = {t: k for k, t in enumerate(terms)}
    wanted = plan.predicate(lambda t: F.col(f"w{place[t]}") > 0 if t in place else F.lit(False))
    df = counts.agg(*[F.count_if(F.col(f"w{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    few = df.join(index.documents.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")))  # rows of one
    hits = counts.where(wanted).join(_of_prefix(index, prefix), "document_id").join(F.broadcast(few))
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.greatest(F.log((F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"w{k}") * (k1 + 1) / (F.col(f"w{k}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    best = hits.select("document_id", "key", "title", "modified_ms", "size", (-score).alias("score")).orderBy("score", "key").limit(limit)
    shown = term_snippet(F.col("body"), [t[0] for t in terms])
    return _with_bodies(index, best, limit).select("key", "title", "modified_ms", "size", "score", shown.alias("snippet")).orderBy("score", "key")


def _with_bodies(index: Index, best: DataFrame, limit: int) -> DataFrame:
    """best, of at most `limit` rows, with their bodies. The rows are fetched first, and their ids reach the scan of the documents as a filter, so other bodies aren't
    read. Over 1000 rows, which are no page of results any more, stay in Spark and are joined."""
    bodies = index.documents.select(F.col("id").alias("document_id"), F.coalesce("body", F.lit("")).alias("body"))
    if limit <= 1000:
        rows = best.collect()
        best, bodies = best.sparkSession.createDataFrame(rows, best.schema), bodies.where(F.col("document_id").isin([r.document_id for r in rows]))
    return bodies.join(best, "document_id")


def _runs(grams: DataFrame, runs: list[str], anchor: str) -> DataFrame:
    """Of the documents that hold every run somewhere: document_id, the ranked columns that hold the anchor (a boolean each), and times: how often the body does, without overlaps.

    A run is where its bigrams are, each at its distance; only their rows are read.
    """
    pieces = {r: {k: r[k : k + 2] for k in sorted({*range(0, len(r) - 1, 2), len(r) - 2})} for r in runs if len(r) > 1}
    tokens, single = sorted({t for p in pieces.values() for t in p.values()}), sorted({r for r in runs if len(r) == 1})
    wanted = reduce(lambda a, b: a | b, [F.col("token").startswith(c) for c in single], F.col("token").isin(tokens))
    nowhere = F.array().cast("array<int>")
    of = {t: F.coalesce(F.max(F.when(F.col("token") == t, F.col("positions"))), nowhere).alias(f"t{k}") for k, t in enumerate(tokens)}
    alone = {c: F.flatten(F.collect_list(F.when(F.col("token").startswith(c), F.col("positions")))).alias(f"c{k}") for k, c in enumerate(single)}
    by_column = grams.where(wanted).groupBy("document_id", "column").agg(*of.values(), *alone.values())

    def places(r: str) -> Column:
        if r in alone:
            return F.col(f"c{single.index(r)}")
        start = lambda t, k: F.transform(f"t{tokens.index(t)}", lambda p: p - k)
        return reduce(F.array_intersect, [start(t, k) for k, t in pieces[r].items()])

    step = lambda a, p: F.when(p >= a["next"], F.struct((a["n"] + 1).alias("n"), (p + len(anchor)).alias("next"))).otherwise(a)
    times = F.aggregate(F.array_sort("a"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("next")), step, lambda a: a["n"])
    found = by_column.select("document_id", "column", places(anchor).alias("a"), *[(F.size(places(r)) > 0).alias(f"r{k}") for k, r in enumerate(runs)])
    holds = lambda c: F.max((F.col("column") == c) & (F.size("a") > 0)).alias(f"{c}_")
    by_document = found.groupBy("document_id").agg(*[F.max(f"r{k}").alias(f"r{k}") for k in range(len(runs))], *map(holds, COLUMNS), F.max(F.when(F.col("column") == "body", times)).alias("times"))
    return by_document.where(reduce(lambda a, b: a & b, [F.col(f"r{k}") for k in range(len(runs))])).select("document_id", *[f"{c}_" for c in COLUMNS], F.coalesce("times", F.lit(0)).alias("times"))


def search_phrase(index: Index, query: str, prefix: str = "", limit: int = 20) -> DataFrame:
    """(key, title, modified_ms, size, score, snippet) for CJK queries: every run is a substring somewhere; words of other scripts must match too.

    Runs are found in the bigrams' places and words in the postings. Bodies are read for the results alone.
    """
    plan = plan_text_query(query)
    if not plan.runs:
        raise ValueError("a phrase search needs a CJK run")
    grams = grams_of(index.documents) if index.grams is None else index.grams
    hits = _runs(grams, list(dict.fromkeys(plan.runs)), plan.anchor).join(_of_prefix(index, prefix), "document_id")
    terms = plan.terms()
    if terms:
        postings = build_postings(index) if index.postings is None else index.postings
        hits = hits.join(_counts(postings, terms), "document_id", "left")
        place = {t: k for k, t in enumerate(terms)}
        hits = hits.where(plan.predicate(lambda t: F.coalesce(F.col(f"w{place[t]}"), F.lit(0.0)) > 0 if t in place else F.lit(False)))
    points = {"title": 100, "headings": 40, "tags": 30, "body": 10}
    score = reduce(lambda a, b: a + b, [F.when(F.col(f"{c}_"), p).otherwise(0) for c, p in points.items()]) + F.col("times")
    hits = hits.select("document_id", "key", "title", "modified_ms", "size", score.cast("long").alias("score"))
    order = [F.desc("score"), F.desc("modified_ms"), F.asc("key")]
    shown = phrase_snippet(F.col("body"), plan.anchor)
    return _with_bodies(index, hits.orderBy(*order).limit(limit), limit).select("key", "title", "modified_ms", "size", "score", shown.alias("snippet")).orderBy(*order)


def phrase_snippet(body: Column, phrase: str) -> Column:
    """150 characters from 60 before the phrase, with an ellipsis where the start is cut off."""
    pos = F.instr(body, phrase)
    return F.concat(F.when(pos > 60, "…").otherwise(""), F.substring(body, F.greatest(F.lit(1), pos - 60), F.lit(150)))


def term_snippet(body: Column, terms: list[str], width: int = 12) -> Column:
    """The `width` words of the body that show most, with ellipses where text is cut off.

    A word matches a term that it begins with, signs before it aside. Of the windows that begin with a match, the best holds most different terms,
    then most matches, and is the first of equals; what room is left after its last match is shared with the words before. Without a match: the first words.
    """
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    which = "^[^a-z0-9]*(" + "|".join(map(re.escape, map(str.lower, terms))) + ")\\b"
    matches = lambda ws: F.filter(F.transform(ws, lambda w, k: F.struct((k + 1).alias("at"), F.regexp_extract(F.lower(w), which, 1).alias("term"))), lambda h: h["term"] != "")
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  (evaluated once, however often f names it)

    def window(hits: Column, h: Column, j: Column) -> Column:
        near = F.filter(F.slice(hits, j + 1, F.lit(width)), lambda x: x["at"] < h["at"] + width)
        return bound(near, lambda n: F.struct(F.size(F.array_distinct(n["term"])).alias("terms"), F.size(n).alias("matches"), (-h["at"]).alias("at"), F.element_at(n, -1)["at"].alias("last")))

    def cut(ws: Column) -> Column:
        best = bound(matches(ws), lambda hits: F.array_max(F.transform(hits, lambda h, j: window(hits, h, j))))
        start = bound(best, lambda b: F.greatest(F.lit(1), F.coalesce(-b["at"] - F.floor((width - (b["last"] + b["at"] + 1)) / 2).cast("int"), F.lit(1))))
        return bound(start, lambda s: F.concat(F.when(s > 1, "…").otherwise(""), F.array_join(F.slice(ws, s, F.lit(width)), " "), F.when(F.size(ws) > s + width - 1, "…").otherwise("")))

    return bound(words, cut)


def search_filename(index: Index, query: str, prefix: str = "", limit: int = 20) -> DataFrame:
    """(key, modified_ms) of the notes whose key contains the query, newest first."""
    return names_holding(index, query).where(keys.has_prefix(F.col("key"), prefix)).orderBy(F.desc("modified_ms"), "key").limit(limit)


def name_quality(key: Column, query: str) -> Column:
    """exact, prefix, substring (of the stem or the basename), path, or null."""
    q = query.strip().lower()
    if not q:
        return F.lit(None).cast("string")
    low = F.lower(key)
    base = keys.basename(low)
    stem = keys.strip_extension(base)
    return F.when((stem == q) | (base == q), "exact").when(stem.startswith(q) | base.startswith(q), "prefix").when(stem.contains(q) | base.contains(q), "substring").when(low.contains(q), "path")


def tier_of(quality: Column, in_content: Column) -> tuple[Column, Column]:
    """(tier, matched): the strongest signal's tier, and the signals, strongest first."""
    name = F.when(quality.isNotNull(), F.element_at(F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (k, v)]), quality))
    body = F.when(in_content, F.lit(CONTENT_TIER))
    both = F.when(name.isNull(), "content").when(body.isNull(), "name").when(name < body, "name,content").otherwise("content,name")
    return F.coalesce(F.least(name, body), F.lit(CONTENT_TIER)), both


def _merged(content: DataFrame, names: DataFrame, query: str, limit: int) -> tuple[DataFrame, list[Column]]:
    a, b = content.select("key", F.col("place").alias("c")), names.select("key", F.col("place").alias("n"))
    both = a.join(b, "key", "full_outer")
    quality = F.when(F.col("n").isNotNull(), F.coalesce(name_quality(F.col("key"), query), F.lit("path")))
    tier, matched = tier_of(quality, F.col("c").isNotNull())
    order = ["tier", "__n", "__p", "key"]
    return both.select("key", tier.alias("tier"), matched.alias("matched"), quality.alias("quality"), F.col("c").isNull().alias("__n"), F.coalesce("c", "n").alias("__p")).orderBy(*order).limit(limit), order


def merge_search(content: DataFrame, names: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """One row a key with both signals. content: (key, place), names: (key, place), places from 1 in each one's own order."""
    return _merged(content, names, query, limit)[0].select("key", "tier", "matched", "quality")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds place, from 1; for the few rows of a result that is already limited."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def search(index: Index, query: str, prefix: str = "", limit: int = 20) -> DataFrame:
    """Content and names in one ranking: (key, tier, matched, quality, title, modified_ms, size, snippet); what only a name finds has no snippet."""
    plan = plan_text_query(query)
    found = search_phrase(index, query, prefix, limit) if plan.runs else search_bm25(index, query, prefix, limit)
    order = [F.desc("score"), F.desc("modified_ms")] if plan.runs else [F.asc("score")]
    merged, rank = _merged(placed(found, *order, F.asc("key")), placed(search_filename(index, query, prefix, limit), F.desc("modified_ms"), F.asc("key")), query, limit)
    known = index.documents.select("key", "title", "modified_ms", "size")
    rows = known.join(F.broadcast(merged), "key").join(F.broadcast(found.select("key", "snippet")), "key", "left")  # at most `limit` rows each
    return rows.orderBy(*rank).drop("__n", "__p")
