"""Matches of patterns with their places, as column expressions only.

A span is a struct (start, kind, end, found): code points, end exclusive. Patterns are written so that a long text
costs time in proportion to its length: runs are possessive, and start where the run starts or the match before ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"


STEP = 256


def matches(text: Column, pattern: str, kind: int, only_if: Column | None = None) -> Column:
    """All leftmost matches, none overlapping. kind is the number that breaks ties in order.

    Pieces between matches and the matches themselves give the places: their lengths add up. They are added up STEP at a time, so
    that a text with very many matches doesn't copy all found so far for each one more.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = F.array().cast(NO_SPANS)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["0"])
        end = at + F.length(x["1"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["1"].alias("found"))
        return F.struct(F.coalesce(end, at).alias("at"), F.when(x["1"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def block(acc: Column, first: Column, all_: Column) -> Column:
        part = F.aggregate(F.slice(all_, first, F.lit(STEP)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NO_SPANS}>").alias("out"))
    found = F.transform(F.array(pairs), lambda p: F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(p), F.lit(STEP)), start, lambda acc, k: block(acc, k, p), lambda acc: acc["out"])))[0]
    hit = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(hit, found).otherwise(none)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, by start, then kind as listed."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") * 2 / 10).cast("int")))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use reads it: lambdas don't share what they are handed as an expression."""
    return F.transform(F.array(value), use)[0]


def _highest(numbers: Column) -> Column:
    """The largest of each number and those before it, STEP at a time."""
    none = F.array().cast("array<int>")

    def block(acc: Column, first: Column) -> Column:
        grown = lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), F.concat(a["out"], F.array(F.greatest(a["top"], x))).alias("out"))
        part = F.aggregate(F.slice(numbers, first, F.lit(STEP)), F.struct(acc["top"].alias("top"), none.alias("out")), grown)
        return F.struct(part["top"].alias("top"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    start = F.struct(F.lit(-1).alias("top"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(STEP)), start, block, lambda acc: acc["out"]))


def _below(sorted_: Column, limit: Column) -> Column:
    """How many of the sorted numbers are below the limit, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = (acc["lo"] < acc["hi"]) & (F.get(sorted_, mid) < limit)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(up | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_) + F.lit(1.0))).cast("int")), start, halve, lambda acc: acc["lo"])


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.

    Others are sorted by start, with the highest end so far beside each. A span is clear if the last of those that start before its end, and all before
    that one, end by its start. So the time is that of a sort, and a search by halving for each span.
    """

    def told(own: Column, rest: Column) -> Column:
        starts = F.transform(rest, lambda o: o["start"])
        ends = lambda s: named(s, lambda st: named(_highest(F.transform(rest, lambda o: o["end"])), lambda top: F.filter(own, lambda x: named(_below(st, x["end"]), lambda n: (n == 0) | (F.get(top, n - 1) <= x["start"])))))
        return F.when((F.size(own) == 0) | (F.size(rest) == 0), own).otherwise(ends(starts))

    return named(spans, lambda own: named(F.array_sort(others), lambda rest: told(own, rest)))


def distinct(spans: Column) -> Column:
    """Sorted, without repeats."""
    return named(F.array_sort(spans), lambda all_: F.filter(all_, lambda s, k: (k == 0) | (s != F.get(all_, k - 1))))


def entropy(text: Column) -> Column:
    """Bits a character, over lower-cased ASCII letters, digits and URL punctuation; other characters count towards the length."""
    low, n = F.lower(text), F.greatest(F.length(text), F.lit(1))
    signs = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789-._/:?&=%#+~@"])
    share = lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))) / n
    return F.aggregate(F.transform(signs, share), F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
