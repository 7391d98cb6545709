"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND for retrieval.

Items are the indexed side: postings lie in blocks of item numbers, each block with the largest impact of its term (as a
share of the item's score for itself, so one threshold holds for short and long items). Passages are the queries. A passage's terms are ordered by
their largest impact anywhere; the pivot is the first at which these bounds add up to the threshold. Items that have neither the pivot nor a term after
it can't reach the threshold, so the postings before the pivot are never walked. The blocks that the others reach are bounded by the block
maxima and by what lies before the pivot, and skipped below the threshold; in the rest, items are scored until what is left of their terms can't reach it.
All items at or above it are retrieved. A retrieved item counts where the document also holds most word shingles of its question and of its answer.
Document frequencies and the mean length are those of all items, however many passes they are indexed in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IDENTITY, identity, keyed, same_identity, written

_WORD = re.compile(r"\w+")
BLOCK = 2


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before its last sentence, and those of it. One sentence: its first two thirds, and the rest."""
    parts = [w for x in re.split(r"(?<=[.!?])\s+", text or "") if (w := words_of(x))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, 2 * len(words) // 3)
    return words[:cut], words[cut:] or words[:cut]


def shingles(words: list[str], n: int) -> set[tuple]:
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def segments(text: str | None, size: int) -> list[list[str]]:
    """An item's words; longer items are indexed in parts of so many."""
    words = words_of(text)
    return [words[k : k + size] for k in range(0, len(words), size)]


class ItemIndex:
    """Postings of a bounded number of items. df, count and mean describe all items; without them, these ones."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, n: int, overlap: float, segment: int = 256, k1: float = 1.2, b: float = 0.75, df: dict[str, int] | None = None, count: int = 0, mean: float = 0.0):
        self.threshold, self.n, self.overlap = threshold, n, overlap
        self.parts = [(item, w) for item, text in items for w in segments(text, segment)]
        self.qa = {item: question_answer(text) for item, text in items}
        if df is None:
            df, count, mean = Counter(t for _, w in self.parts for t in set(w)), len(self.parts), sum(len(w) for _, w in self.parts) / max(1, len(self.parts))
        self.span = max([8, *(len(w) for _, w in self.parts)])
        scored, top = [], {}
        for _, w in self.parts:
            score = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(w) / mean)) for t, f in Counter(w).items()}
            whole = sum(score.values())
            scored.append({t: s / whole for t, s in score.items()})
            for t, s in scored[-1].items():
                top[t] = max(top.get(t, 0.0), s)
        self.vocab = {t: k for k, t in enumerate(sorted(top, key=lambda t: (top[t], t)))}  # in rising order of the largest impact
        self.shares: list[list[tuple[int, float]]] = [sorted(((self.vocab[t], s) for t, s in own.items()), key=lambda x: (-x[1], x[0])) for own in scored]
        self.blocks = -(-len(self.parts) // BLOCK)
        tops: list[dict[int, float]] = [{} for _ in self.vocab]
        for k, shares in enumerate(self.shares):
            for t, s in shares:
                tops[t][k // BLOCK] = max(tops[t].get(k // BLOCK, 0.0), s)
        self.n_posts = np.array([len(x) for x in tops], dtype=np.int64)
        self.starts = np.cumsum(self.n_posts) - self.n_posts
        flat = [x for own in tops for x in sorted(own.items())]
        self.post_block = np.array([x[0] for x in flat], dtype=np.int64)
        self.post_max = np.array([x[1] for x in flat])
        self.term_max = np.array([max(x.values()) for x in tops])

    def retrieve(self, texts: list[list[str]]) -> list[dict[int, float]]:
        """For each list of words: item -> best score, of the items that some passage of the words scores at the threshold or above.

        Passages are twice the longest item's span, and start at each span: every run of a span's words is whole in one. STRIPES of them are taken at a time.
        """
        out: list[dict[int, float]] = [{} for _ in texts]
        if not self.parts:
            return out
        get, span = self.vocab.get, self.span
        ids = np.array([get(w, -1) for words in texts for w in words], dtype=np.int64)
        lengths = np.array([len(w) for w in texts], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        stripes = -(-lengths // span)
        owner = np.repeat(np.arange(len(texts)), stripes)
        begin = np.repeat(first, stripes) + (np.arange(len(owner)) - np.repeat(np.cumsum(stripes) - stripes, stripes)) * span
        end = np.minimum(begin + span, np.repeat(first + lengths, stripes))
        for a in range(0, len(owner), STRIPES):
            z = min(len(owner), a + STRIPES + 1)  # one stripe more, as passages take two
            own = np.repeat(np.arange(a, z), (end - begin)[a:z])
            term = ids[begin[a] : end[z - 1]]
            hit = term >= 0
            stripe, pair = own[hit], own[hit] * len(self.vocab) + term[hit]
            back = (stripe > a) & (owner[stripe] == owner[np.maximum(stripe - 1, 0)])
            pair = np.sort(np.concatenate([pair[stripe < a + STRIPES], pair[back] - len(self.vocab)]))
            for p, block in self._reached(pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair):
                has = set(ids[begin[p] : end[min(p + 1, len(owner) - 1)] if p + 1 < len(owner) and owner[p + 1] == owner[p] else end[p]].tolist())
                best = out[owner[p]]
                for item in range(block * BLOCK, min(len(self.parts), (block + 1) * BLOCK)):
                    if (score := self._score(item, has)) >= self.threshold:
                        best[self.parts[item][0]] = max(score, best.get(self.parts[item][0], 0.0))
        return out

    def _reached(self, pair: np.ndarray) -> Iterable[tuple[int, int]]:
        """(passage, block) whose bound reaches the threshold, from the distinct (passage, term) pairs in order, which is that of rising bounds inside a passage."""
        passage, term = pair // len(self.vocab), pair % len(self.vocab)
        top = self.term_max[term]
        at = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else passage
        each, size = passage[at], np.diff(np.append(at, len(passage)))
        sums = np.cumsum(top)
        inside = sums - np.repeat(sums[at] - top[at], size)
        walked = inside >= self.threshold - 1e-9  # the pivot and what comes after it
        before = np.bincount(np.repeat(np.arange(len(each)), size)[~walked], top[~walked], len(each))
        key, most = self._posted(passage[walked], term[walked])
        keys, where = np.unique(key, return_inverse=True)
        bound = np.bincount(where, most, len(keys))
        left = bound + before[np.searchsorted(each, keys // self.blocks)] >= self.threshold - 1e-9
        keys, bound = keys[left], bound[left]
        if not len(keys):
            return ()
        key, most = self._posted(passage[~walked], term[~walked])  # block maxima for what was a bound of the whole list, in the blocks left
        where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        met = keys[where] == key
        keys = keys[bound + np.bincount(where[met], most[met], len(keys)) >= self.threshold - 1e-9]
        return zip((keys // self.blocks).tolist(), (keys % self.blocks).tolist(), strict=True)

    def _posted(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passage and block as one number, and the block's maximum, for each block that a term is posted in."""
        n = self.n_posts[term]
        post = np.arange(n.sum()) + np.repeat(self.starts[term] - np.cumsum(n) + n, n)
        return np.repeat(passage * self.blocks, n) + self.post_block[post], self.post_max[post]

    def _score(self, item: int, has: set[int]) -> float:
        """The item's score, or 0 as soon as the impacts missed rule the threshold out. Impacts come in falling order and sum to 1."""
        left = 1.0
        for t, s in self.shares[item]:
            if t not in has and (left := left - s) < self.threshold - 1e-9:
                return 0.0
        return left

    def verified(self, words: list[str], found: dict[int, float]) -> list[tuple[int, float]]:
        """Those of the found items whose question and answer both overlap the words enough."""
        have: dict[int, set] = {}

        def share(part: list[str]) -> float:
            n = min(self.n, len(part))
            if n not in have:
                have[n] = shingles(words, n)
            own = shingles(part, n)
            return len(own & have[n]) / len(own)

        return [(i, s) for i, s in sorted(found.items()) if all(share(x) >= self.overlap for x in self.qa[i])]


    def hits(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """The items that each text holds, with their scores. Some texts are taken at a time: their words are many times as large as they are."""
        out = []
        for at in range(0, len(texts), TEXTS):
            words = [words_of(t) for t in texts[at : at + TEXTS]]
            out += [self.verified(w, found) if found else [] for w, found in zip(words, self.retrieve(words), strict=True)]
        return out


def indexes(items: DataFrame, threshold: float = 0.6, words: int = 5, overlap: float = 0.8, index_items: int = 20_000, segment: int = 256) -> Iterable[ItemIndex]:
    """Indexes of bounded size (index_items, about) that together hold all items, with one document frequency and one mean length for all of them.

    items: (item_id, text). Null and empty texts and null ids are left out; repeated item ids keep their largest text.
    """
    items = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where("item_id is not null and t is not null").groupBy("item_id").agg(F.max("t").alias("t")), "items")
    parts = max(1, math.ceil(items.count() / index_items))

    def terms(batches):
        for b in batches:
            rows = [(i, t, len(w)) for i, x in zip(b.column("item_id").to_pylist(), b.column("t").to_pylist(), strict=True) for w in segments(x, segment) for t in sorted(set(w))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.int64(), pa.string(), pa.int64()))], ["item_id", "term", "n"])

    def lengths(batches):
        for b in batches:
            n = [len(w) for x in b.column("t").to_pylist() for w in segments(x, segment)]
            yield pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([sum(n)])], ["parts", "words"])

    count, total = (x or 0 for x in items.select("t").mapInArrow(lengths, "parts long, words long").agg(F.sum("parts"), F.sum("words")).first())
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    own = items.mapInArrow(terms, "item_id long, term string, n long")
    frequency = written(own.groupBy("term").agg(F.count("*").alias("df")), "item-terms")
    for k in range(parts):
        rows = [(r[0], r[1]) for r in items.where(part == k).orderBy("item_id").toLocalIterator()]
        df = {r[0]: r[1] for r in frequency.join(own.where(part == k).select("term").distinct(), "term").toLocalIterator()}
        yield ItemIndex(rows, threshold, words, overlap, segment, df=df, count=count, mean=total / max(1, count))


STRIPES, TEXTS = 4096, 256


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.6, words: int = 5, overlap: float = 0.8, index_items: int = 20_000) -> DataFrame:
    """(doc_id, items, scores) for every row: the test items it holds, in order of id, and their BM25 shares; empty arrays if none.

    items: (item_id, text). The index is sent to the tasks, index_items at a time: a larger benchmark takes more passes over docs, with the same results. Null and
    empty texts of either table match nothing; rows that repeat a doc_id, or lack one, are judged each for itself; very long texts are read whole, some thousand
    passages at a time; an empty table of documents gives an empty result, one of items no hits. Other columns are never read.
    """
    found = [docs.sparkSession.sparkContext.broadcast(x) for x in indexes(items, threshold, words, overlap, index_items)]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.float64())]

    def searched(sent, keep: list[str], all_rows: bool):
        def run(batches):
            for b in batches:
                hits = sent.value.hits(b.column("text").to_pylist())
                at = [k for k, h in enumerate(hits) if h or all_rows]
                lists = [pa.array([[x[c] for x in hits[k]] for k in at], kinds[c]) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keep), *lists], [*keep, "items", "scores"])

        return run

    if len(found) == 1:
        return keyed(docs).mapInArrow(searched(found[0], ["doc_id"], True), "doc_id long, items array<long>, scores array<double>")
    own = docs.select(*identity(docs), F.coalesce("text", F.lit("")).alias("text"))
    rows = None
    for sent in found:
        one = own.mapInArrow(searched(sent, IDENTITY, False), "doc_id long, k1 long, k2 long, items array<long>, scores array<double>")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.distinct().groupBy(*IDENTITY).agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("items", "scores")))).alias("h"))
    out = own.drop("text").join(rows.select(*[F.col(c).alias(f"t_{c}") for c in IDENTITY], "h"), same_identity("t_"), "left")
    return out.select("doc_id", F.coalesce("h.items", F.array().cast("array<long>")).alias("items"), F.coalesce("h.scores", F.array().cast("array<double>")).alias("scores"))


def clean_only(docs: DataFrame, items: DataFrame, index_items: int = 20_000) -> DataFrame:
    """The rows of docs that hold no test item, with all columns. Each row is judged by its own text: null and empty texts stay, repeated and missing ids change nothing."""
    where = docs.columns.index("text")
    for k, index in enumerate(indexes(items, index_items=index_items)):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                yield b.filter(pa.array([not h for h in sent.value.hits(b.column(where).to_pylist())], pa.bool_()))

        docs = (written(docs, "clean") if k else docs).mapInArrow(run, docs.schema)  # written between passes, so that a task holds one index
    return docs
