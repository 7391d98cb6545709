"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads the letters of a word and writes what it can be: an insult or a threat, at the weight of its arcs, a target, a negation, reported speech,
or just a word. Three transducers read what it writes, a clause at a time: negation damps what comes within three words, reported speech damps its whole
clause, a target makes threats count and insults count more. They are composed into one machine, whose best accepted path is the clause's score. Insult arcs (whole
words, and stems of three to eight letters) and their weights are learned from labelled documents, as log-odds; the closed classes are fixed.
Clauses are scored, not words; a document's score is a logistic function of its strongest clause and of all of them, fitted on the same labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

_WORD, _CLAUSE = re.compile(r"\w+"), re.compile(r"[.,;:!?\n|。！？，；]+")
# Fixed closed classes of the grammar: English, French, German, Spanish. Threats are stems.
TARGETS = frozenset("you your yours yourself u he she they them him her his their tu toi te vous votre vos il elle ils elles du dich dir ihr euch sie usted ustedes ti vosotros ellos".split())
NEGATIONS = frozenset("not never no isn aren wasn don doesn didn won nicht kein keine nie niemals pas jamais ne nunca jamás".split())
REPORTS = frozenset("said says saying claimed called calls quoted reported wrote writes sagte sagt schrieb schreibt behauptete dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill killing kills killed hurt destroy stab shoot strangle tuer tuerai frapper étrangler égorger töten umbringen erschießen erwürgen verprügeln matar mataré golpear apuñalar estrangular".split())
THREAT_WEIGHT, NEGATED, REPORTED, AIMED = 2.5, 0.4, 0.6, 1.2
SIZES = range(3, 9)
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2: such rows are never learned from. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(4)) == 2


@dataclass
class Transducer:
    """arcs[state][label] = (next state, label written, factor of its weight); a label without an arc has no path. Several starts are several guesses."""

    starts: list
    finals: set
    arcs: dict[object, dict[int, tuple[object, int, float]]] = field(default_factory=dict)

    def composed(self, after: Transducer) -> Transducer:
        """What this one writes, the other reads; factors multiply. Only states that can be reached are built."""
        out = Transducer([(a, b) for a in self.starts for b in after.starts], set())
        todo = list(out.starts)
        while todo:
            a, b = state = todo.pop()
            if state in out.arcs:
                continue
            out.arcs[state] = {}
            if a in self.finals and b in after.finals:
                out.finals.add(state)
            for label, (to, middle, factor) in self.arcs[a].items():
                if found := after.arcs[b].get(middle):
                    out.arcs[state][label] = ((to, found[0]), found[1], factor * found[2])
                    todo.append((to, found[0]))
        return out


def _same(state, change: dict | None = None, factors: dict | None = None) -> dict[int, tuple[object, int, float]]:
    """Arcs that write what they read: to the state named for a label, else back; with the factor named for it, else 1. None as a state is no arc."""
    change, factors = change or {}, factors or {}
    return {k: (change.get(k, state), k, factors.get(k, 1.0)) for k in range(6) if change.get(k, state) is not None}


def negation() -> Transducer:
    """States are the words that a negation still covers."""
    low = {INSULT: NEGATED, THREAT: NEGATED}
    return Transducer([0], {0, 1, 2, 3}, {k: _same(max(0, k - 1), {NEGATION: 3}, low if k else {}) for k in range(4)})


def reported() -> Transducer:
    """Two guesses: no reporting word in the clause, or one that comes."""
    low = {INSULT: REPORTED, THREAT: REPORTED}
    return Transducer(["plain", "to come"], {"plain", "seen"}, {"plain": _same("plain", {REPORT: None}), "to come": _same("to come", {REPORT: "seen"}, low), "seen": _same("seen", factors=low)})


def target() -> Transducer:
    """Two guesses: no target in the clause, so that threats don't count, or one that comes."""
    more = {INSULT: AIMED, THREAT: AIMED}
    return Transducer(["none", "to come"], {"none", "seen"}, {"none": _same("none", {TARGET: None}, {THREAT: 0.0}), "to come": _same("to come", {TARGET: "seen"}, more), "seen": _same("seen", factors=more)})


class Lexicon:
    """A trie: at its end a word's own readings, on the way those of stems. A reading is (label, weight)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[tuple[int, float]]] = {}
        self.passes: dict[int, tuple[int, float]] = {}
        for label, weight, found in ((TARGET, 0.0, TARGETS), (NEGATION, 0.0, NEGATIONS), (REPORT, 0.0, REPORTS), (THREAT, THREAT_WEIGHT, THREATS)):
            for w in sorted(found):
                self.ends.setdefault(self._path(w), []).append((label, weight))
        for w, x in words.items():
            self.ends.setdefault(self._path(w), []).append((INSULT, x))
        for w, x in stems.items():
            self.passes[self._path(w)] = (INSULT, x)

    def _path(self, word: str) -> int:
        at = 0
        for c in word:
            at = self.next[at].setdefault(c, len(self.next))
            if at == len(self.next):
                self.next.append({})
        return at

    def read(self, word: str) -> list[tuple[int, float]]:
        """What the word can be. A word of a closed class is nothing else beside insults and threats."""
        at, out = 0, []
        for k, c in enumerate(word):
            at = self.next[at].get(c)
            if at is None:
                break
            if at in self.passes and k + 1 < len(word):
                out.append(self.passes[at])
        else:
            out += self.ends.get(at, ())
        return out if any(label in (TARGET, NEGATION, REPORT) for label, _ in out) else [*out, (WORD, 0.0)]


class Grammar:
    """words and stems: the insult arcs and their weights. fit: bias and the factors of the features."""

    CACHED = 1 << 17

    def __init__(self, words: dict[str, float], stems: dict[str, float], fit: tuple[float, ...] = (-4.0, 1.0, 1.0, 0.0)):
        self.lexicon, self.fit = Lexicon(words, stems), fit
        self.machine = negation().composed(reported()).composed(target())
        self.seen: dict[str, list[tuple[int, float]]] = {}

    def readings(self, word: str) -> list[tuple[int, float]]:
        if (out := self.seen.get(word)) is None:
            if len(self.seen) >= self.CACHED:
                self.seen.clear()
            out = self.seen[word] = self.lexicon.read(word)
        return out

    def clause(self, words: list[list[tuple[int, float]]]) -> float:
        """The weight of the best path that ends in a final state."""
        best = {s: 0.0 for s in self.machine.starts}
        for readings in words:
            after: dict = {}
            for state, total in best.items():
                for label, weight in readings:
                    if (arc := self.machine.arcs[state].get(label)) and (x := total + weight * arc[2]) > after.get(arc[0], -1.0):
                        after[arc[0]] = x
            best = after
        return max((x for s, x in best.items() if s in self.machine.finals), default=0.0)

    def clauses(self, text: str | None) -> list[float]:
        """The scores above 0. Only clauses with a word that can pay are run."""
        out, low = [], (text or "").lower()
        pays = lambda w: any(x for _, x in self.readings(w))
        if any(map(pays, set(_WORD.findall(low)))):
            for c in _CLAUSE.split(low):
                words = _WORD.findall(c)
                if any(map(pays, words)) and (x := self.clause([self.readings(w) for w in words])):
                    out.append(x)
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Logs of the strongest clause, of all clauses' sum, and of the words they are spread over; zeros if no clause scores."""
        each = self.clauses(text)
        return (math.log1p(max(each)), math.log1p(sum(each)), math.log1p(len(_WORD.findall(text.lower())))) if each else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        z = self.fit[0] + sum(a * x for a, x in zip(self.fit[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _grams(text: str) -> set[str]:
    """Whole words, and stems followed by a blank; each counts once in a document."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + " " for w in words for n in SIZES if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, support: float = 0.02, least: int = 5, odds: float = 2.0) -> Grammar:
    """Learn arcs and the final logistic from labelled rows that are not held out; fit_rows bounds (about) how many.

    An arc is learned from `least` toxic rows on, and a share `support` of them; so there are at most the sample's words over that many. A document with several labels is toxic if one says so.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("y")).where("l is not null and y is not null").groupBy("l").agg(F.max("y").alias("y"))
    rows = keyed(docs).where(~held_out()).join(known, F.col("doc_id") == F.col("l")).select("doc_id", "text", "y")
    total = known.where(~held_out("l")).count()
    share = min(1.0, fit_rows / max(1, total))
    rows = written(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "toxicity-sample")
    of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = of.get(1, 0), sum(n for y, n in of.items() if y != 1)
    if not pos or not neg:
        return Grammar({}, {})

    def count(batches):
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                g = list(_grams(t))
                if g:
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), y == 1))], ["gram", "toxic"])

    grams = rows.select("text", "y").mapInArrow(count, "gram string, toxic boolean").groupBy("gram").agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum((~F.col("toxic")).cast("long")).alias("n"))
    weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 3) / (neg + 3))
    found = grams.where(F.col("p") >= max(least, support * pos)).withColumn("w", weight).where(F.col("w") >= odds).collect()
    grammar = Grammar({r["gram"]: r["w"] for r in found if " " not in r["gram"]}, {r["gram"].strip(): r["w"] for r in found if " " in r["gram"]})
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def features(batches):
        for b in batches:
            f = [sent.value.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in f], pa.float64()) for k in range(3)), b.column("y")], ["top", "sum", "size", "y"])

    seen = rows.select("text", "y").mapInArrow(features, "top double, sum double, size double, y int").groupBy(*[F.round(c, 1).alias(c) for c in ("top", "sum", "size")], "y").count().collect()
    grammar.fit = _logistic(np.array([[1.0, r["top"], r["sum"], r["size"]] for r in seen]), np.array([float(r["y"] == 1) for r in seen]), np.array([float(r["count"]) for r in seen]))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (n * (p - y)) + ridge * w)
    return tuple(float(v) for v in w)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Null and empty texts score as a text without toxic clauses does.

    Rows that repeat a doc_id are scored each by its text; a null id is not held out and has no label. Very long texts are read whole, clause by
    clause. Without labels of both classes there are no insult arcs, and the logistic keeps its initial weights. An empty table gives an empty one; other columns are never read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    def run(batches):
        for b in batches:
            s = [sent.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = keyed(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
