"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of vote
patterns (at most 3^9 of them, whatever the corpus) estimates the accuracy of each labeller, and with that each
pattern's posterior. The posteriors of a bounded sample train a linear scorer on hashed features, which scores all
documents. Gold labels are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed

DIMS = 1 << 12
PRIOR = 0.8  # the share of good documents assumed where nothing speaks for or against
BIAS = math.log(PRIOR / (1 - PRIOR))
GOOD, BAD, NONE = 1, 0, 2
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes([*range(97, 123), *range(128, 256)]), bytes(range(48, 58))
_SHAPE = bytes(65 if c in _UPPER else 97 if c in _LOWER else 48 if c in _DIGIT else c for c in range(256))
_RUNS = re.compile(rb"([Aa0])\1+")


def ratios(text: str | None) -> tuple[int, list[float]]:
    """Words, and the figures that the labellers look at."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, [0.0] * len(FIGURES)
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper, lower, digits = left(_UPPER), left(_LOWER), left(_DIGIT)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, [
        upper / max(1, upper + lower),
        left(b"#$%&*~^") / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        math.log(len(set(words)) + 1) / math.log(n + 1),
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n,
        (upper + lower + digits) / sum(map(len, words)),
        digits / max(1, upper + lower + digits),
        len(set(lines)) / max(1, len(lines)),
    ]


FIGURES = ["upper", "symbols", "bars", "exclaims", "variety", "ends", "letters", "digits", "lines"]
#: Name, least words for a vote, when it votes bad, when it votes good. Defects only ever vote bad: their absence says nothing.
LABELLERS = [
    ("shouting", 5, lambda x: x["upper"] > 0.5, None),
    ("symbols", 5, lambda x: x["symbols"] > 0.2, None),
    ("bars", 5, lambda x: x["bars"] > 0.1, None),
    ("exclaiming", 5, lambda x: x["exclaims"] > 0.2, None),
    ("numbers", 5, lambda x: x["digits"] > 0.4, None),
    ("repeated lines", 20, lambda x: x["lines"] < 0.4, None),
    ("variety", 50, lambda x: x["variety"] < 0.6, None),
    ("prose", 5, lambda x: x["letters"] < 0.9, lambda x: x["letters"] >= 0.95 and x["upper"] < 0.2 and x["variety"] >= 0.6),
    ("sentences", 30, lambda x: x["ends"] < 0.005, lambda x: 0.03 <= x["ends"] < 0.5 and not x["bars"] and x["variety"] >= 0.6),
]


def votes(n: int, figures: list[float]) -> list[int]:
    x = dict(zip(FIGURES, figures, strict=True))
    return [NONE if n < least else BAD if bad(x) else GOOD if good and good(x) else NONE for _, least, bad, good in LABELLERS]


def posteriors(patterns: np.ndarray, counts: np.ndarray, prior: float = PRIOR, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each pattern, and each labeller's accuracy, by expectation-maximisation.

    Accuracy is how often a vote, where one is given, agrees with the truth; an abstention says nothing. It stays between
    0.6 and 0.99, as a labeller is taken to be better than chance and never certain. prior: the share of good documents
    assumed where nobody votes.
    """
    accuracy = np.full(patterns.shape[1], 0.9)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        z = math.log(prior / (1 - prior)) + (patterns == GOOD) @ weight - (patterns == BAD) @ weight
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        agree = (counts * p) @ (patterns == GOOD) + (counts * (1 - p)) @ (patterns == BAD)
        after = np.clip((agree + 9) / (counts @ (patterns != NONE) + 10), 0.6, 0.99)
        if np.abs(after - accuracy).max() < 1e-9:
            break
        accuracy = after
    return p, accuracy


def hashed(text: str | None, n: int, figures: list[float]) -> dict[int, float]:
    """Hashed features: the shares of word shapes (runs of letters and digits made one), and steps of the figures, which say little in a short text."""
    shapes = Counter(_RUNS.sub(rb"\1", (text or "").encode("utf-8", "replace").translate(_SHAPE)).split())
    out: dict[int, float] = {}
    for s, k in shapes.items():
        at = zlib.crc32(s) % DIMS
        out[at] = out.get(at, 0.0) + (k / n) ** 0.5
    for name, x in zip(FIGURES, figures, strict=True):
        at = zlib.crc32(f"{name} {int(min(x, 40) * 10)}".encode()) % DIMS
        out[at] = out.get(at, 0.0) + min(1.0, n / 30)
    return out


def fit_linear(rows: list[tuple[list[int], list[float]]], target: np.ndarray, steps: int = 400, rate: float = 1.0, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by full gradient steps with momentum. The last weight, the bias, stays at the prior: a text that shows nothing scores as that."""
    n = [len(i) for i, _ in rows]
    at, of = np.concatenate([np.asarray(i, dtype=np.int64) for i, _ in rows]), np.repeat(np.arange(len(rows)), n)
    x = np.concatenate([np.asarray(v) for _, v in rows])
    w, move = np.append(np.zeros(DIMS), BIAS), np.zeros(DIMS + 1)
    for _ in range(steps):
        z = np.bincount(of, x * w[at], len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(at, x * err[of], DIMS) / len(rows) + l2 * w[:-1], 0.0)
        move = 0.9 * move - rate * g
        w = w + move
    return w


def fit(docs: DataFrame, fit_rows: int = 8000) -> np.ndarray:
    """The scorer's weights. Votes of all documents are counted; fit_rows bounds (about) the rows that train the scorer."""
    docs = keyed(docs)

    def vote(batches):
        for b in batches:
            found = Counter(bytes(votes(*ratios(t))) for t in b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k.decode("latin-1") for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return np.append(np.zeros(DIMS), BIAS)
    patterns = np.array([list(r["pattern"].encode("latin-1")) for r in counted], dtype=np.int64)
    counts = np.array([r["n"] for r in counted], dtype=float)
    p = posteriors(patterns, counts)[0]
    of = {bytes(x.tolist()): float(y) for x, y in zip(patterns, p, strict=True)}
    share = min(1.0, fit_rows / counts.sum())
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                n, figures = ratios(t)
                if n:
                    f = hashed(t, n, figures)
                    rows.append((list(f), list(f.values()), of[bytes(votes(n, figures))]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows])], ["at", "x", "p"])

    rows = sample.mapInArrow(features, "at array<int>, x array<double>, p double").toLocalIterator()
    rows = [(np.array(r["at"], dtype=np.int32), np.array(r["x"], dtype=np.float32), r["p"]) for r in rows]
    if not rows:
        return np.append(np.zeros(DIMS), BIAS)
    return fit_linear([(a, x) for a, x, _ in rows], np.array([p for *_, p in rows]))


def score(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    """The probability of good of each text. One without words has the score of the bias."""
    z = []
    for t in texts:
        n, figures = ratios(t)
        z.append(w[-1] + (sum(w[k] * x for k, x in hashed(t, n, figures).items()) if n else 0.0))
    return 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(b.column("text").to_pylist(), sent.value))], ["doc_id", "score"])

    return keyed(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, threshold: float = 0.5, fit_rows: int = 8000) -> DataFrame:
    """(doc_id, score, kept) for every row. Null and empty texts have no word to vote on and are kept.

    Each row is judged by its own text, whatever its id; rows alike get one verdict each. Very long texts are read whole, in time in proportion to their length. An empty table gives
    an empty one; ties at the threshold are kept; other columns are never read.
    """
    out = scores(docs, fit(docs, fit_rows))
    return out.select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.5, fit_rows: int = 8000) -> DataFrame:
    """The rows of docs that are not rejected, with all columns: each is judged by its own text, so repeated and missing ids change nothing. Nothing is shuffled."""
    sent, where = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows)), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score(b.column(where).to_pylist(), sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
