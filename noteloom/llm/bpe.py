"""Byte-level BPE over a pair occurrence index.

A batch's distinct pieces (pre-tokens) lie one after another in one array of symbols. An index maps each pair of neighbours
to all places where it occurs. Ranks are taken in ascending order from a heap of the pairs present; a merge visits
exactly the places listed for its pair, and puts the new pairs it makes into their lists. Pieces seen before come from a bounded
cache, so the index holds what is new in the batch. Decoding maps ids back to bytes, and bytes to text with U+FFFD for
what is no UTF-8.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Tokenizer:
    """Encodes and decodes with a tokenizer file's vocabulary and merges."""

    def __init__(self, data: dict, cached: int = 1_000_000):
        letters = byte_letters()
        back, vocab = {c: b for b, c in letters.items()}, data["model"]["vocab"]
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 20 | b for a, b, _ in self.rules], dtype=np.int64)
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        known = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.bytes_of = [known.get(i, b"") for i in range(max(known) + 1)]
        self.name_of = list(map(str, range(len(self.bytes_of))))
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = cached  # pieces, in two generations: what was not used in the last one goes

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where no rule merges it."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], -1)

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as packed 32-bit numbers. All places of one pair merge in one go, lowest rank first."""
        if not pieces:
            return []
        raw = [p.encode("utf-8") for p in pieces]
        ends = np.cumsum([len(x) for x in raw])
        first = np.concatenate([[0], ends[:-1]])
        symbol = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        nxt, prev = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        nxt[ends - 1], prev[first] = -1, -1
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Put places, each the left one of a pair, into the lists of their pairs."""
            rank = self.ranks(symbol[places], symbol[nxt[places]])
            kept = rank >= 0
            places, rank = places[kept], rank[kept]
            if not len(rank):
                return
            by = np.argsort(rank, kind="stable")
            places, rank = places[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, at, to in zip(rank[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=True):
                if r in where:
                    where[r].append(places[at:to])
                else:
                    where[r] = [places[at:to]]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(nxt >= 0))
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = self.rules[rank]
            i = where.pop(rank)
            i = i[0] if len(i) == 1 else np.concatenate(i)
            i = i[(symbol[i] == a) & (nxt[i] >= 0)]
            i = i[symbol[nxt[i]] == b]  # the others merged meanwhile
            if a == b:
                i = _apart(np.unique(i), nxt)
            if not len(i):
                continue
            j = nxt[i]
            k = nxt[j]
            symbol[i], symbol[j], nxt[i] = new, -1, k
            prev[k[k >= 0]] = i[k >= 0]
            left = prev[i]
            note(np.unique(np.concatenate([i[k >= 0], left[left >= 0]])))
        alive = symbol >= 0
        ids, n = symbol[alive].astype(np.int32).tobytes(), (4 * np.cumsum(np.add.reduceat(alive, first, dtype=np.int64))).tolist()
        return [ids[at:to] for at, to in zip([0, *n[:-1]], n, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; a special token's string becomes its id."""
        cut = [self._cut(t) for t in texts]
        if len(self.cache) > self.cached // 2:
            self.cache, self.older = {}, self.cache
        cache, older, special = self.cache, self.older, {t: np.int32(i).tobytes() for t, i in self.special.items()}
        new = set(chain.from_iterable(cut)).difference(cache, special)
        for p in [p for p in new if p in older]:
            cache[p] = older[p]
            new.remove(p)
        new = list(new)
        cache.update(zip(new, self.merged(new), strict=True))
        cache.update(special)
        return [np.frombuffer(b"".join(map(cache.__getitem__, t)), dtype=np.int32).tolist() for t in cut]

    def _cut(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        return [p for part in self.split.split(text) for p in ([part] if part in self.special else self.pieces.findall(part))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _apart(places: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, in order, those that merge from left to right: in a run, every other one."""
    kept, taken = [], -1
    for i, j in zip(places.tolist(), nxt[places].tolist(), strict=True):
        if i != taken:
            kept.append(i)
            taken = j
    return np.array(kept, dtype=np.int64)


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(key: str, data: str) -> Tokenizer:
    """One for each Python worker, kept between tasks."""
    if key not in _loaded:
        _loaded[key] = Tokenizer(json.loads(data))
    return _loaded[key]


def _groups(items: list[str], most: int = 1 << 22):
    """Runs of texts with about `most` characters each, so that one batch's index stays small; a longer text is alone."""
    run, size = [], 0
    for x in items:
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row; null text counts as empty, and an empty one has no tokens.

    Rows alike each get their row, in no order; an empty table gives an empty one; other columns are never read, so their names can't clash. A very long text is
    encoded whole in one task, as a batch of its own, with memory in proportion to its pieces. Of pairs of one rank, the leftmost merge first, as in the library.
    tokenizer_path is read on the driver; its content (a few MB whatever the data) goes to the tasks as a broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data.encode()).hexdigest()
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids)

    def run(batches):
        tok = _tokenizer(key, sent.value)
        for b in batches:
            doc_ids = iter(b.column("doc_id").to_pylist())
            for texts in _groups(b.column("text").to_pylist()):
                rows = []
                for ids in tok.encode(texts):
                    text = tok.decode(ids)
                    row = (next(doc_ids), len(ids), hashlib.sha256(",".join(map(tok.name_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest())
                    rows.append(row + ((ids, text) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return keyed(docs).mapInArrow(run, ddl)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def n_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return encode_decode(docs, tokenizer_path).agg(F.sum("n_tokens").alias("n_tokens"))
