"""Packing of documents into sequences: first-fit decreasing over a tournament tree of bin capacities, inside randomised groups of documents.

A document's ids are cut into whole sequences first; what remains (less than one) is dealt, as are those whole pieces, to groups by a hash of the row's number. In a
group, remainders are packed in order of decreasing length into the first bin that has room, found by walking down a tree whose nodes hold the largest
capacity below them. Then gaps are closed: as many bins as the group's tokens fill are kept, the fullest ones, and the documents of the other bins are poured
into their gaps, cut where a gap ends. What is left at last, less than one sequence, is laid out as sequences of powers of two. So nothing is padded, and
only the documents of the emptiest bins are cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .word_tokens import WordTokens

ROOM, END_ID, GROUP = 4096, 2, 2048
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64()), ("rest", pa.binary())])
_PLACED = pa.schema([*list(_PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Tournament:
    """Bins with some room each, as the leaves of a tree whose inner nodes hold the larger capacity of their two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put something of this size into the first bin that has room for it."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            at += most[at] < size
        bin_, left = at - self.leaves, most[at] - size
        most[at] = left
        while at > 1:
            at //= 2
            a, b = most[2 * at], most[2 * at + 1]
            most[at] = a if a > b else b
        return bin_


def first_fit_decreasing(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item; equal sizes are taken in the order they have."""
    tree, bins = Tournament(len(sizes), room), np.zeros(len(sizes), dtype=np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        bins[k] = tree.place(int(sizes[k]))
    return bins


def laid_out(sizes: np.ndarray, room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """(item, from, to, sequence, offset) of every piece of the items, each at most `room` long. Sequences are full, or as long as a power of two."""
    bins = first_fit_decreasing(sizes, room)
    fill = np.bincount(bins, weights=sizes).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    whole, spare = divmod(int(sizes.sum()), room)
    by_fill = np.argsort(-fill, kind="stable")
    number = np.full(len(fill), -1, dtype=np.int64)
    number[by_fill[:whole]] = np.arange(min(whole, len(fill)))
    out, used = [], [0] * whole
    for k in np.lexsort((-sizes, bins)).tolist():
        seq = int(number[bins[k]])
        if seq >= 0:
            out.append((k, 0, int(sizes[k]), seq, used[seq]))
            used[seq] += int(sizes[k])
    # Sequences with a gap, widest first, then new ones of powers of two, are filled by the rest, longest first.
    open_ = [(room - used[s], s, used[s]) for s in sorted(range(whole), key=lambda s: used[s]) if used[s] < room]
    open_ += [(1 << b, whole + n, 0) for n, b in enumerate(b for b in reversed(range(room.bit_length())) if spare >> b & 1)]
    open_.reverse()
    for k in sorted(np.flatnonzero(number[bins] < 0).tolist(), key=lambda k: -sizes[k]):
        at, size = 0, int(sizes[k])
        while at < size:
            gap, seq, offset = open_.pop()
            take = min(gap, size - at)
            out.append((k, at, at + take, seq, offset))
            at += take
            if take < gap:
                open_.append((gap - take, seq, offset + take))
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_loaded: dict[str, WordTokens] = {}


def _encoder(key: str, data: str) -> WordTokens:
    """One for each Python worker, kept between tasks."""
    if key not in _loaded:
        _loaded[key] = WordTokens(data)
    return _loaded[key]


def _slices(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many bytes each; a longer text is alone."""
    size = np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    at, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > at and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(size):
        yield at, len(size)


def _pieces(docs: DataFrame, tokenizer_path: str, room: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row, rest): the whole pieces of each document, and what remains, with its ids (rest)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data.encode()).hexdigest()

    def run(batches):
        enc, row = _encoder(key, sent.value), TaskContext.get().partitionId() << 40
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi in _slices(b.column("text")):
                ids, first = enc.encode(b.column("text").slice(lo, hi - lo))
                rows = []
                for k in range(hi - lo):
                    own = np.append(ids[first[k] : first[k + 1]], enc.kind.type(end_id))
                    n = len(own)
                    for at in range(0, n, room):
                        part = own[at : at + room]
                        rows.append((doc_ids[lo + k], at, len(part), _crc(part), n, row, None if len(part) == room else part.tobytes()))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    return keyed(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, rest binary")


def _packed(g: pa.Table, group: int, room: int, kind: np.dtype) -> pa.RecordBatch:
    cols = {c: g.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest")}
    whole = [k for k, x in enumerate(cols["rest"]) if x is None]
    part = [k for k, x in enumerate(cols["rest"]) if x is not None]
    places = [(k, 0, room, s, 0) for s, k in enumerate(whole)]
    places += [(part[i], a, b, len(whole) + s, o) for i, a, b, s, o in laid_out(np.array([cols["length"][k] for k in part], dtype=np.int64), room)]
    crc = lambda k, a, b: cols["ids_crc32"][k] if b - a == cols["length"][k] else _crc(np.frombuffer(cols["rest"][k], dtype=kind)[a:b])
    rows = [(cols["doc_id"][k], cols["start"][k] + a, b - a, crc(k, a, b), cols["doc_tokens"][k], group << 32 | s, o) for k, a, b, s, o in places]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLACED.types, strict=True)], schema=_PLACED)


def pack(docs: DataFrame, tokenizer_path: str, room: int = ROOM, end_id: int = END_ID, group_docs: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row of docs.

    A document is its ids and end_id; null and empty texts are that id alone. Every id lies in one piece, a sequence's pieces follow each other from
    offset 0, and each sequence is `room` long or as long as a power of two, so none needs padding. Groups hold about group_docs documents whatever the size of
    the table (their number grows with its rows), so a task holds some MB of ids. They are drawn by row number, so copies and repeated rows spread over all
    groups; each row is packed for itself, null ids too. A very long text is encoded whole in one task, and its whole pieces spread over groups. An empty table gives
    an empty one; other columns are never read. Row numbers follow the order of the scan: docs should be a table, not the result of an unordered shuffle.
    """
    pieces = _pieces(docs, tokenizer_path, room, end_id)
    groups = max(1, -(-docs.count() // group_docs))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).repartition("group").sortWithinPartitions("group", "row")
    with open(tokenizer_path, encoding="utf-8") as f:
        kind = WordTokens(f.read()).kind

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            number = t.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:]):
                yield _packed(t.slice(lo, hi - lo), int(number[lo]), room, kind)
            held = t.slice(cuts[-1]).to_batches() if len(t) else []
        if held:
            t = pa.Table.from_batches(held)
            yield _packed(t, t.column("group")[0].as_py(), room, kind)

    return dealt.drop("row").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
