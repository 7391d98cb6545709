"""Repeated passages, found as windows of three consecutive lines.

A line is a physical line, cut further after the end of a sentence, so that a paragraph written as one line has lines too. A
sentence of under SHORT units (words; characters where words aren't spaced) stays with the next one; one of over WHOLE units is cut where its words
themselves say so, at most 2 * NEAR - 1 units apart. Every cut depends on what is near it only, so a passage of over 50 words is cut alike wherever it
begins and ends. Windows of three lines are hashed (96 bits; the first 64 find candidates, all of them decide), counted over the
whole corpus, and every occurrence but the first in order of (doc_id, position) is covered. A document's covered positions merge, and those lines go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, written

_digest = xxhash.xxh3_128_digest
WINDOW = 3
STEP = 1 << 18
TEXTS = 512  # so many are cut at a time, as each text gives some hundred rows
SHORT, WHOLE, NEAR = 5, 9, 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANKS = bytes([*range(9, 14), *range(28, 33)])
_BLANK, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[list(_BLANKS)], _STOP[list(b".!?")] = True, True
_BYTE = np.arange(1, 257, dtype=np.uint64) * _MIX[0]
_BYTE = np.where(_BLANK, np.uint64(0), (_BYTE ^ _BYTE >> np.uint64(29)) * _MIX[1])
_WIDE_BLANKS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_STOPS = re.compile(rb"\xe3\x80\x82|\xef\xbc[\x81\x9f]")
# Bytes that some such blank or stop begins with; most texts hold none, and a look for them is far quicker than the patterns.
_BLANK_MARKS, _STOP_MARKS = (b"\xe2\x80", b"\xe2\x81\x9f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe3\x80\x80"), (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")


def _holds(raw: bytes, marks: tuple[bytes, ...]) -> bool:
    return any(m[:1] in raw and m in raw for m in marks)  # a single byte is looked for quickest


def _chosen(score: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Places among the free ones, NEAR or more apart and with no free one left between: the least score around goes first."""
    out, n = np.zeros(len(score), dtype=bool), len(score)
    s = np.full(n + 2 * NEAR, _NEVER)
    for _ in range(12):
        at = np.flatnonzero(free)
        if not len(at):
            return out
        s[NEAR : NEAR + n] = np.where(free, score, _NEVER)
        mid, now = score[at], np.ones(len(at), dtype=bool)
        for k in range(1, NEAR):
            now &= (mid < s[at + NEAR - k]) & (mid <= s[at + NEAR + k])
        at = at[now]
        out[at] = True
        for k in range(1 - NEAR, NEAR):
            free[at + k] = False  # free places keep NEAR - 1 from both ends
    last = -NEAR
    for at in np.flatnonzero(free):  # long runs of few words
        if at - last >= NEAR:
            out[at], last = True, at
    return out


def _unit_cuts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, in bytes, and whether a line ends with them."""
    stops = np.empty(0, dtype=np.int64)
    if not raw.isascii():
        if _holds(raw, _BLANK_MARKS):
            raw = _WIDE_BLANKS.sub(lambda m: b" " * len(m[0]), raw)
        if _holds(raw, _STOP_MARKS):
            stops = np.array([m.start() for m in _WIDE_STOPS.finditer(raw)], dtype=np.int64)
    x = np.frombuffer(raw, dtype=np.uint8)
    blank = _BLANK[x]
    first = ~blank
    first[1:] &= blank[:-1]
    if not raw.isascii():
        wide = (x >= 0xE3) & (x <= 0xE9)
        wide[:-1] |= (x[:-1] == 0xE0) & (x[1:] >= 0xB8) & (x[1:] <= 0xBB)
        wide[stops] = False
        after = stops[stops + 3 < len(x)] + 3
        wide[after] |= ~blank[after]
        wide[stops] = False
        first |= wide
    at = np.flatnonzero(first)
    n = len(at)
    if not n:
        return at, np.zeros(0, dtype=bool)
    unit = lambda places: np.searchsorted(at, places, "right") - 1
    newline, mark = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    newline[(k := unit(np.flatnonzero(x == 10)))[k >= 0]] = True
    mark[unit(np.flatnonzero(_STOP[x[:-1]] & (x[1:] == 32)))] = True
    mark[unit(stops)] = True
    newline[-1] = True
    ends = np.flatnonzero(mark | newline)
    ends = ends[newline[ends] | (np.diff(ends, prepend=-1) >= SHORT)]
    size = np.diff(ends, prepend=-1)
    cut = np.zeros(n, dtype=bool)
    if (size > WHOLE).any():
        sizes = np.repeat(size, size)
        place = np.arange(n) - np.repeat(ends - size + 1, size)
        free = (sizes > WHOLE) & (place >= NEAR - 1) & (place < sizes - NEAR)
        h = np.add.reduceat(_BYTE[x], at)
        score = h * _MIX[0] + np.roll(h, -1) * _MIX[1]
        cut = _chosen((score ^ score >> np.uint64(31)) * _MIX[2], free)
    cut[ends] = True
    return at, cut


def _line_starts(raws: list[bytes]) -> list[np.ndarray]:
    """Where the lines of each text begin, in bytes. Blanks stay with the line before; blanks alone are one line.

    Texts are cut together, joined by newlines, as short ones would cost a call each; about STEP bytes at a time.
    """
    out, group, held = [], [], 0
    for k, raw in enumerate(raws):
        group.append(raw)
        held += len(raw)
        if held < STEP and k + 1 < len(raws):
            continue
        begins = np.cumsum([0, *[len(r) + 1 for r in group]])
        at, cut = _unit_cuts(b"\n".join(group))
        lines = at[np.flatnonzero(np.append(True, cut[:-1]))] if len(at) else at
        places = np.searchsorted(lines, begins).tolist()
        for r, begin, lo, hi in zip(group, begins.tolist(), places, places[1:]):
            starts = lines[lo:hi] - begin if hi > lo else np.zeros(min(len(r), 1), dtype=np.int64)
            starts[:1] = 0
            out.append(starts)
        group, held = [], 0
    return out


def _bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _slices(raw: bytes, starts: np.ndarray) -> list[bytes]:
    s = [*starts.tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(s, s[1:])]


def cut_lines(text: str) -> tuple[list[str], list[int]]:
    """The text cut into lines, and their sizes (UTF-8 bytes without blanks at the ends). The lines' concatenation is the text; blank ones stay with the line before."""
    raw = _bytes_of(text)
    out = [x.decode() for x in _slices(raw, _line_starts([raw])[0])]
    return out, [len(_bytes_of(x.strip())) for x in out]


def lines_of(text: str) -> list[str]:
    return cut_lines(text)[0]


def window_hashes(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Hashes (n, 2) of the windows, by their first line: every three consecutive lines, however short."""
    n = len(starts) - WINDOW + 1
    if n < 1:
        return np.empty((0, 2), np.uint64)
    lines = _slices(raw, starts)
    if not _holds(raw, _BLANK_MARKS):
        lines = [x.strip(_BLANKS) for x in lines]
    else:
        lines = [_bytes_of(x.decode().strip()) for x in lines]
    h = np.frombuffer(b"".join(map(_digest, lines)), dtype="<u8").reshape(-1, 2)
    return h[:n] * _MIX[0] + h[1 : n + 1] * _MIX[1] + h[2 : n + 2] * _MIX[2]


WHO = ["id", "k"]


def _identity(docs: DataFrame) -> list[Column]:
    """A document is its id and 32 bits of its text, which tell the few rows that share an id apart. Without an id, 64 other bits of the text stand for it, in the order of documents too."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)), F.hash(text)]


def windows(docs: DataFrame) -> DataFrame:
    """(id, k, h1, h2, pos, starts): a row for each window of each document, and one more a document that has the places of its lines alone."""

    def run(batches):
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            raws = [_bytes_of(t) for t in b.column("text").to_pylist()]
            starts = _line_starts(raws)
            hashes = [window_hashes(r, s) for r, s in zip(raws, starts)]
            n, m = [len(h) for h in hashes], len(raws)
            if not m:
                continue
            total, one = sum(n), pa.array(np.concatenate([np.repeat(np.arange(m), n), np.arange(m)]))
            own = np.arange(total + m) >= total
            h = np.concatenate([*hashes, np.zeros((m, 2), np.uint64)]).view(np.int64)
            pos = np.concatenate([*map(np.arange, n), np.zeros(m, np.int64)]).astype(np.int32)
            ends = np.concatenate([np.zeros(total + 1, np.int64), np.cumsum(list(map(len, starts)))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~own, False)), pa.array(np.concatenate(starts).astype(np.int32)))
            cols = [*(b.column(c).take(one) for c in WHO), pa.array(h[:, 0], mask=own), pa.array(h[:, 1].astype(np.int32), mask=own), pa.array(pos, mask=own), places]
            yield pa.RecordBatch.from_arrays(cols, [*WHO, "h1", "h2", "pos", "starts"])

    rows = docs.select(*[c.alias(n) for c, n in zip(_identity(docs), WHO, strict=True)], F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, k int, h1 long, h2 int, pos int, starts array<int>")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(id, k, starts, at) for each document: where its lines begin, and the first lines of its windows that repeat an earlier one."""
    # All tables are written: texts are cut and hashed once, and the joins have exchanges of their own on both sides, so that AQE can split a very frequent window's rows.
    # The smaller sides, which are a fraction of a partition's rows, are hashed: the windows needn't be sorted.
    every = written(windows(docs), "line-hashes")
    own = written(every.where("h1 is null").select(*WHO, "starts", F.lit(None).cast("int").alias("pos")), "line-starts")
    many = written(every.where("h1 is not null").groupBy("h1").count().where("count > 1").select("h1"), "line-repeats")
    found = written(every.where("h1 is not null").select("h1", "h2", *WHO, "pos").join(many.hint("shuffle_hash"), "h1", "left_semi"), "line-windows").withColumn("place", F.struct(*WHO, "pos")).select("h1", "h2", "place")
    dropped(every)
    dropped(many)
    first = written(found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-firsts")
    later = found.join(first.hint("shuffle_hash"), ["h1", "h2"]).where("place > first").select(*[f"place.{c}" for c in WHO], F.lit(None).cast("array<int>").alias("starts"), "place.pos")
    return later.unionByName(own).groupBy(*WHO).agg(F.first("starts", True).alias("starts"), F.collect_set("pos").alias("at"))


def count_names(columns: list[str]) -> list[str]:
    """What the two added columns are called: a name that the table has already gets underscores."""
    out = []
    for name in ("lines_total", "lines_removed"):
        while name.lower() in map(str.lower, columns):
            name += "_"
        out.append(name)
    return out


def _without(raw: bytes, starts: np.ndarray, at: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside of the windows that begin at these lines, and how many lines the windows hold."""
    gone = np.zeros(len(starts), dtype=bool)
    for k in range(WINDOW):
        gone[at + k] = True
    edge = np.flatnonzero(np.diff(gone, prepend=True, append=True))  # where what stays begins and ends, in turn
    cut = np.append(starts, len(raw))[edge].tolist()
    return b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2])), int(gone.sum())


def line_dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, text without its later repeats, and two columns more: lines_total, lines_removed (see count_names for clashes).

    A null text stays null with 0 lines; rows alike in doc_id and text count as one document, so all of them keep or lose the same lines; a row
    without an id is placed by a hash of its text. Documents of under three lines, empty ones too, have no window and stay as they are. A text whose every line repeats an
    earlier one becomes empty. A very long text is cut in one task, as all its windows are its own. An empty table gives an empty one.
    """
    where, names = docs.columns.index("text"), count_names(docs.columns)
    covered = covered_lines(docs).select(*[F.col(c).alias(f"__covered_{c}") for c in [*WHO, "starts", "at"]])
    same = [one == covered[f"__covered_{c}"] for one, c in zip(_identity(docs), WHO, strict=True)]
    joined = docs.join(covered, same, "left").select(*[docs[c] for c in docs.columns], covered["__covered_starts"], covered["__covered_at"])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.IntegerType()) for n in names]])

    def run(batches):
        for b in batches:
            text, starts, at = b.column(where), b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            total, n = (pc.fill_null(pc.list_value_length(x), 0) for x in (starts, at))
            gone, fresh = np.zeros(len(n), dtype=np.int32), []
            for k in np.flatnonzero(n):
                left, gone[k] = _without(_bytes_of(text[k].as_py()), *(x[k].values.to_numpy() for x in (starts, at)))
                fresh.append(left.decode())
            if fresh:
                text = pc.replace_with_mask(text, pc.greater(n, 0), pa.array(fresh, text.type))
            cols = [text if k == where else b.column(k) for k in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*cols, total.cast(pa.int32()), pa.array(gone)], schema.fieldNames())

    return joined.mapInArrow(run, schema)
