"""Phrases that collocate, by dynamic itemset counting over shards of the documents.

Documents are dealt to shards once. The shards are scanned in a cycle, all lengths at a time: a phrase is counted from the step on at which both its subphrases
(without its last and without its first word) have reached the threshold, and for one full cycle from there, so that every shard is counted once. A phrase reaches it
early by the count of a single task, or when its cycle ends and its rows are added up. It ends when no phrase is inside its cycle: most phrases begin in the first few
shards, so there are far fewer scans than one for each length and shard.

Most of what is counted is rare, so it is counted by hash: two numbers a row, no text. What has reached the threshold by its hash is counted by its words for one more
cycle from there, in the same scans; these counts alone make the result, so phrases that share a hash can't change it.

What has reached the threshold is told to the tasks by an array of fixed size: the step from which a phrase's hash counts as reached. A place is set once and
never changed, so what shares a place with another begins early at the worst: it is counted over a full cycle all the same, and falls under the threshold if it
has to. The array costs `slots` bytes whatever the data; counts themselves stay in written tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

LONGEST, LEAST, FIRST, SHARDS, SLOTS = 5, 100, 2000, 4, 1 << 24
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
NAMED = -1  # instead of the step at which a phrase began: a row counted by its words; those of k = 0 count a language's words
_COUNTS = "act int, h long, lang string, k int, phrase string, c long"
_SCHEMA = pa.schema([("act", pa.int32()), ("h", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _parts(data: bytes, most: int) -> Iterator[bytes]:
    """data in parts of about so many bytes, cut at piece ends only."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > most:
            end = data.rfind(b".", at, at + most) + 1
            if end <= at:
                end = data.find(b".", at + most) + 1 or len(data)
        yield data[at:end]
        at = end


def words_of(data: bytes) -> tuple[np.ndarray, list[str]]:
    """(the number of each word in order, -1 where a piece ends; the distinct words)."""
    spaced = data.replace(b".", b" . ")
    text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(spaced)], dtype=np.int64)), pa.py_buffer(spaced)])
    coded = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    distinct, place = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    real = (distinct != ".") & (distinct != "")
    return np.where(real, np.cumsum(real) - 1, -1)[place], distinct[real].tolist()


def _coded(w: np.ndarray, at: np.ndarray, k: int, words: int) -> np.ndarray:
    """A number for each phrase of k words that begins at these places, the same for equal ones."""
    code = w[at]
    for j in range(1, k):
        code = pd.factorize(code * words + w[at + j])[0]
    return code


def _by_hash(hashes: np.ndarray, began: int) -> pa.RecordBatch:
    """Each hash once, with its count."""
    x = np.sort(hashes)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    n, none = len(first), (lambda t: pa.nulls(len(first), t))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, began, np.int32)), pa.array(x[first].view(np.int64)), none(pa.string()), none(pa.int32()), none(pa.string()), pa.array(np.diff(np.append(first, len(x))))], schema=_SCHEMA)


def _by_words(lang: str, k: int, phrases: list[str], counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, NAMED, np.int32)), pa.nulls(n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array(np.full(n, k, np.int32)), pa.array(phrases, pa.string()), pa.array(counts.astype(np.int64))], schema=_SCHEMA)


def counted(w: np.ndarray, words: list[str], lang: str, reached: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are inside a cycle at this step: by hash those that aren't reached, by words those that are. reached: by hash, the step from which a phrase is reached, or 0."""
    mask, seed = np.uint64(len(reached) - 1), xxhash.xxh32_intdigest(lang.encode())
    own = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in words], dtype=np.uint64)

    def named(k: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the phrases of k words at some places, each once with its count."""
        code = _coded(w, at, k, len(words))
        counts, one = np.bincount(code), np.zeros(int(code.max()) + 1, dtype=np.int64)
        one[code] = at
        there = np.flatnonzero(counts)
        for lo in range(0, len(there), 1 << 16):
            some = there[lo : lo + (1 << 16)]
            parts = [map(words.__getitem__, w[one[some] + j].tolist()) for j in range(k)]
            yield _by_words(lang, k, list(map(" ".join, zip(*parts, strict=True))), counts[some])

    at = np.flatnonzero(w >= 0)
    hashes = own[w[at]]
    last = np.zeros(len(w), dtype=np.uint64)  # each place's word, by its hash
    last[at] = hashes
    if step < shards:
        yield _by_words(lang, 0, [""], np.array([len(at)]))
    since = np.zeros(len(at), np.int32)  # the step from which a phrase is counted; its place may be another's, and set before that
    for k in range(1, longest + 1):
        known = reached[hashes & mask].astype(np.int32)
        open_ = (known == 0) & (step < since + shards)
        for began in np.unique(since[open_]).tolist():
            yield _by_hash(hashes[open_ & (since == began)], began)
        some = np.flatnonzero(known)
        at, hashes, known = at[some], hashes[some], np.maximum(known[some], since[some])
        now = at[step < known + shards]
        if len(now):
            yield from named(k, now)
        next_ = np.flatnonzero(at[1:] == at[:-1] + 1)  # both its subphrases are reached
        if not len(next_):
            return
        since = np.maximum(known[next_], known[next_ + 1])
        at = at[next_]
        hashes = _mixed(hashes[next_] * _ODD + last[at + k])


def _scan(shard: DataFrame, sent: Broadcast, step: int, shards: int, longest: int, most: int = 12 << 20) -> DataFrame:
    """Counts of one shard's phrases at this step. sent: the array of what is reached, compressed."""

    def flushed(lang: str, texts: list[bytes], reached: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in _parts(b"\n".join(texts).lower().translate(_ENDS), most):  # lower() of bytes changes A-Z alone
            w, words = words_of(part)
            if words:
                yield from counted(w, words, lang, reached, step, shards, longest)

    def run(batches):
        reached = np.frombuffer(zlib.decompress(sent.value), dtype=np.uint8)
        held: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > most:
                    for one, texts in held.items():
                        yield from flushed(one, texts, reached)
                    held, size = {}, 0
        for one, texts in held.items():
            yield from flushed(one, texts, reached)

    return shard.select("lang", "text").mapInArrow(run, _COUNTS)


def _newly(rows: DataFrame, reached: np.ndarray, step: int) -> bool:
    """Set the places of rows' hashes that aren't set yet. What comes to the driver is a bitmap: slots / 8 bytes at most."""
    slot = F.col("h").bitwiseAND(F.lit(len(reached) - 1)) + 1
    maps = rows.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    new = False
    for r in maps:
        at = (r.b - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little"))
        at = at[reached[at] == 0]
        reached[at] = step
        new |= len(at) > 0
    return new


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, c): every word and phrase of up to `longest` words that occurs `least` times or more; (lang, n): the words of each language).

    docs: lang and text; null lang counts as und, null text as empty. slots: bytes of the array of what is reached, a power of two of 32,768 or more; with more phrases
    reached than it has places, more is counted than need be, and the result is the same.
    """
    if slots & (slots - 1) or slots < 1 << 15 or longest * shards > 250:
        raise ValueError("slots must be a power of two of 32768 or more, and longest * shards at most 250")
    spark: SparkSession = docs.sparkSession
    dealt = docs.select(F.coalesce(F.col("`lang`").cast("string"), F.lit("und")).alias("lang"), F.col("`text`").alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    table = written(dealt.where("text <> ''"), "phrase-shards", "shard")
    reached = np.zeros(slots, dtype=np.uint8)
    counts: list[DataFrame] = []  # a table for each step; what is counted by hash lies under the step it began at
    step = last = 0
    while step < shards or step < last + shards:
        sent = spark.sparkContext.broadcast(zlib.compress(reached.tobytes(), 1))
        counts.append(written(_scan(table.where(F.col("shard") == step % shards), sent, step, shards, longest), "phrase-counts", "act"))
        sent.destroy()  # what was read with it is written
        # Reached by the count of one task alone: less than its count, so it holds; all others are told when their cycle ends.
        found = counts[-1].where((F.col("act") != NAMED) & (F.col("c") >= least)).select("h")
        if step >= shards - 1:
            ended = reduce(DataFrame.unionByName, [t.where(F.col("act") == step - shards + 1).select("h", "c") for t in counts[-shards:]])
            found = found.unionByName(ended.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h"))
        if _newly(found, reached, step + 1):
            last = step + 1
        step += 1
    named = reduce(DataFrame.unionByName, [t.where(F.col("act") == NAMED).select("lang", "k", "phrase", "c") for t in counts])
    total = written(named.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")).where((F.col("k") == 0) | (F.col("c") >= least)), "phrases")
    for t in (*counts, table):
        dropped(t)
    return total.where("k > 0"), total.where("k = 0").select("lang", F.col("c").alias("n"))


def _cut(k: int) -> list[Column]:
    """The first k words of a phrase, and the others."""
    return [F.substring_index("phrase", " ", k), F.expr(f"substring_index(phrase, ' ', {k} - k)")]


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `longest` words by the score of their weakest cut.

    a, l, r are exact counts of the phrase and of its two parts, n of the language's words. score: floor(1000 a n / (l r)) in decimals of 38 digits. A phrase goes
    if a longer one that holds it occurs as often. Null lang counts as und, null and empty texts have no words, rows alike count each; an empty table gives an
    empty one; columns other than lang and text are never read. Very long texts are cut at piece ends; one piece is held whole. Equal scores go by a, then by the phrase's bytes.
    """
    found, sizes = frequent_phrases(docs, least, longest, shards, slots)
    wanted = found.where("k > 1")
    cuts = wanted.select("lang", "k", "phrase", F.col("c").alias("a"), F.explode(F.array(*[F.when(F.col("k") > cut, F.struct(F.lit(cut).alias("cut"), *[x.alias(n) for x, n in zip(_cut(cut), ("head", "rest"), strict=True)])) for cut in range(1, longest)])).alias("x"))
    cuts = cuts.where("x is not null").select("lang", "phrase", "a", "x.*")
    known = found.select("lang", "phrase", "c")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(sizes, "lang")
    wide = both.withColumns({c: F.col(c).cast("decimal(17,0)") for c in ("l", "r")}).withColumn("top", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)"))
    each = wide.select("lang", "phrase", "a", "n", F.struct(F.expr("top div (l * r)").alias("score"), "cut", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")).alias("s"))
    lowest = each.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("s").alias("s"))
    # Counts don't rise from a phrase to one that holds it, so it is enough to look at those one word longer.
    inside = wanted.where("k > 2").select("lang", F.explode(F.array(*[F.expr(x) for x in ("substring_index(phrase, ' ', k - 1)", "substring_index(phrase, ' ', 1 - k)")])).alias("phrase"), "c")
    widest = inside.groupBy("lang", "phrase").agg(F.max("c").alias("c"))
    kept = lowest.join(widest, ["lang", "phrase"], "left").where("c is null or c < a")
    out = kept.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = out.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_TEXT = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')"
ORACLE = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest({_TEXT}) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, phrase, count(*) AS c FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(ws) >= {k}) AS g{k} GROUP BY lang, phrase HAVING count(*) >= {LEAST}" for k in range(1, LONGEST + 1))}),
p AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
s AS (SELECT p.lang, p.phrase, p.c AS a, cut, h.c AS l, t.c AS r, n.n, CAST(CAST(1000 AS HUGEINT) * p.c * n.n // (CAST(h.c AS HUGEINT) * t.c) AS BIGINT) AS score
  FROM p, unnest(range(1, p.k)) AS u(cut) JOIN g h ON h.lang = p.lang AND h.phrase = array_to_string(p.ws[1:cut], ' ') JOIN g t ON t.lang = p.lang AND t.phrase = array_to_string(p.ws[cut + 1:], ' ') JOIN n ON n.lang = p.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
k AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.lang = b.lang AND len(q.ws) > len(string_split(b.phrase, ' ')) AND q.c >= b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k)
SELECT * FROM o WHERE rank <= {FIRST}"""
