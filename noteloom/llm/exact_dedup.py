"""Exact duplicates by Grace hashing.

Two passes of the same table. The first runs inside each input partition and leaves one partial for each distinct text there,
so a group of copies, however large, reaches the shuffle as one row a partition. The second gets the partials dealt out
by a hash of the whole text. Within a task, records are partitioned recursively to spill files until a bucket's distinct texts
fit the memory given, then an open-addressing table compares complete contents. Spill files live in the task's own
scratch folder and go when the task ends; a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
Record = tuple[bytes, object]


class OpenTable:
    """Open addressing with linear probing; keys are compared in full."""

    def __init__(self) -> None:
        self.slots, self.keys, self.values, self.bytes = [-1] * 1024, [], [], 0

    def add(self, key: bytes, value) -> None:
        mask = len(self.slots) - 1
        at = xxhash.xxh3_64_intdigest(key) & mask
        while (k := self.slots[at]) >= 0:
            if self.keys[k] == key:
                self.values[k].append(value)
                self.bytes += 64
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.keys)
        self.keys.append(key)
        self.values.append([value])
        self.bytes += len(key) + 200
        if 2 * len(self.keys) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, key in enumerate(self.keys):
            at = xxhash.xxh3_64_intdigest(key) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace_groups(records: Iterable[Record], memory: int = 64 << 20, fanout: int = 16, level: int = 0) -> Iterator[tuple[bytes, list]]:
    """(key, its values) for each distinct key, in no order. memory bounds what a table holds before its bucket is split."""
    table, records = OpenTable(), iter(records)
    for key, value in records:
        table.add(key, value)
        if table.bytes > memory and len(table.keys) > 1 and level < 12:
            break
    else:
        yield from zip(table.keys, table.values, strict=True)
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(f"{folder}/{k}", "wb") for k in range(fanout)]  # noqa: SIM115

        def spill(key: bytes, values: list) -> None:
            pickle.dump((key, values), files[xxhash.xxh3_64_intdigest(key, level + 1) % fanout], protocol=5)

        for key, values in zip(table.keys, table.values, strict=True):
            spill(key, values)
        del table
        for key, value in records:
            spill(key, [value])
        for f in files:
            f.close()
        for f in files:
            yield from grace_groups(_reread(f.name), memory, fanout, level + 1)


def _reread(name: str) -> Iterator[Record]:
    with open(name, "rb") as f:
        while True:
            try:
                key, values = pickle.load(f)
            except EOFError:
                return
            for v in values:
                yield key, v


def _id(x) -> tuple:
    """Ids in order, a null id below all others."""
    return (x is not None, x or 0)


def exact_duplicates(docs: DataFrame, memory: int = 64 << 20) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays; of rows
    that repeat that doc_id as well, one stays, and a null doc_id is below all others. memory is in bytes, for each task.
    Empty texts are a group like any other; a text longer than the memory is a bucket of its own, held whole in one task, and only ever once a partition; an empty table gives an
    empty one; columns other than doc_id and text are never read, so their names can't clash. Rows alike in all columns are told apart by their place in a partition.
    """

    def local(batches):
        part = TaskContext.get().partitionId() << 36
        rows = ((t.encode("utf-8", "replace").translate(_LOWER), i) for b in batches for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
        yield from _batches(_local_rows(grace_groups(rows, memory), part), LOCAL)

    def merge(batches):
        rows = ((t, (i, n, g)) for b in batches for t, i, n, g in zip(*(b.column(c).to_pylist() for c in ("text", "doc_id", "n", "part")), strict=True))
        yield from _batches(_merged_rows(grace_groups(rows, memory)), MERGED)

    found = written(keyed(docs).mapInArrow(local, "doc_id long, part long, n long, text binary"), "exact-local")
    groups = found.where("n is not null").repartition(F.xxhash64("text")).mapInArrow(merge, "g long, keep_id long, group_size long, winner boolean, text_sha256 string")
    return found.select("doc_id", "part", F.col("n").isNotNull().alias("first")).join(groups, F.col("part") == F.col("g")).select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("winner")).alias("kept"), "text_sha256")


LOCAL = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])
MERGED = pa.schema([("g", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("winner", pa.bool_()), ("text_sha256", pa.string())])


def _local_rows(groups, part: int):
    """A row for each record; only the one with the largest id carries the text and the count."""
    for k, (text, ids) in enumerate(groups):
        best = max(range(len(ids)), key=lambda j: _id(ids[j]))
        for j, i in enumerate(ids):
            yield (i, part + k, len(ids), text) if j == best else (i, part + k, None, None)


def _merged_rows(groups):
    for text, partials in groups:
        keep, total, sha = max(partials, key=lambda p: (_id(p[0]), p[2])), sum(p[1] for p in partials), hashlib.sha256(text).hexdigest()
        for _, _, g in partials:
            yield g, keep[0], total, g == keep[2], sha


def _batches(rows, schema: pa.Schema, most: int = 8 << 20):
    """Record batches of about `most` bytes."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
