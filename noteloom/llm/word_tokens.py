"""Ids of texts by a tokenizer file whose pre-tokenizer drops white space, as the tokenizers library gives them.

Such a tokenizer treats what stands between blanks by itself, so a batch is cut at ASCII blanks and coded by its distinct words (Arrow), and only words not seen
before reach the library. Words of plain signs are cut further by the file's own pattern, so that "Heat," and "heat" share a piece; all others, and those that may
hold a special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_letters

# The parts of a tokenizer file for which the short way holds.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
# Signs whose composed form, lower case and kind (letter, digit, other) are the same in every Unicode version: printable ASCII, Latin-1 letters, some punctuation.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ–—‘-‟…]+\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordTokens:
    """Encodes batches of texts; words and pieces seen before come from bounded caches."""

    def __init__(self, data: str, cached: int = 1_000_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        told = json.loads(data)
        self.whole = Tokenizer.from_str(data)
        self.whole.no_padding()
        self.whole.no_truncation()
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.suffix = told["model"].get("end_of_word_suffix")
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.short = (told["normalizer"] or {}).get("normalizers") == NORMALIZER and (told["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZER and bool(self.suffix)
        if not self.short and not _drops_blanks(told):
            raise ValueError("the tokenizer keeps white space, so words can't be encoded one by one")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = bool(self.suffix) and token.endswith(self.suffix)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in byte_letters().items()}
        self.cached, self.longest = cached, longest  # words and pieces kept, and signs of the longest of them
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            line = " ".join(p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(self.letters) for p in part)
            ids = np.array(self.single.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = (self.kind.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            for piece, lo, hi in zip(part, [0, *cuts[:-1]], cuts, strict=True):
                self.pieces[piece] = raw[lo:hi]

    def _learn(self, new: list[str]) -> None:
        special = self.special
        plain = [w for w in new if _PLAIN.match(w) and not any(s in w for s in special)] if self.short else []
        cut = [_PIECES.findall(w.lower()) for w in plain]
        if len(self.pieces) > self.cached:
            self.pieces = {}
        pieces = self.pieces
        self._learn_pieces(list(set(chain.from_iterable(cut)).difference(pieces)))
        for word, parts in zip(plain, cut, strict=True):
            self.words[word] = pieces[parts[0]] if len(parts) == 1 else b"".join(map(pieces.__getitem__, parts))
        for parts in cut:
            for piece in parts:
                if len(piece) > self.longest:
                    pieces.pop(piece, None)
        if len(plain) < len(new):
            rest = list(set(new).difference(plain))
            for word, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.words[word] = self._packed(e.ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids begin, and the end). Null counts as empty."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) > self.cached:
            self.words = {"": b""}
        words = self.words
        new = [w for w in distinct if w not in words]
        self._learn(new)
        own = list(map(words.__getitem__, distinct))
        for w in new:
            if len(w) > self.longest:
                del words[w]
        size = np.array([len(x) for x in own], dtype=np.int64) // self.kind.itemsize
        all_ids, at = np.frombuffer(b"".join(own), dtype=self.kind), coded.indices.to_numpy()
        first, length = (np.cumsum(size) - size)[at], size[at]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        ids = all_ids[np.repeat(first - (end - length), length) + np.arange(total)]
        return ids, np.concatenate([[0], end])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def _drops_blanks(told: dict) -> bool:
    kinds = [told["pre_tokenizer"] or {}, *((told["pre_tokenizer"] or {}).get("pretokenizers") or [])]
    return any(k.get("type") in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") for k in kinds)
