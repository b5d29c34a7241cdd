"""Text helpers on columns: slices by offset, regular-expression scans with offsets, case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x02"  # one ASCII character: texts stay in one byte a character, and split() needs no regular expression
_FOLD = 128


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points, 0-based and half open."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, pattern: str | Column) -> Column:
    """What lies between matches of the pattern, and the matches, in turn; the text alone where there is none. The
    pattern is looked for once, and the text is cut at a control character around each match, or by two searches where
    a text has that character."""
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    marked = F.regexp_replace(text, regex, F.lit(f"{_MARK}$0{_MARK}"))
    once = let(marked, lambda t: F.when(F.contains(t, F.lit(_MARK)), F.split(t, _MARK, -1)).when(t.isNotNull(), F.array(t)))
    found, gaps = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1)
    twice = F.slice(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.array(x["g"], x["m"]))), F.lit(1), 2 * F.size(found) + 1)
    return F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(once)


def _starts(pieces: Column) -> Column:
    """Where each piece starts, and the end. Only numbers are gathered: a fold's array is copied each time that it
    grows, so long lists are summed some pieces at a time, each part from the length of all before."""

    def sums(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def many(sizes: Column) -> Column:
        part = lambda i: F.slice(sizes, i * _FOLD + 1, F.lit(_FOLD))
        numbers = F.sequence(F.lit(0), ((F.size(sizes) - 1) / _FOLD).cast("int"))
        total = F.transform(numbers, lambda i: F.aggregate(part(i), F.lit(0), lambda n, m: n + m))
        each = lambda at: F.flatten(F.transform(numbers, lambda i: F.slice(sums(part(i), F.get(at, i)), F.lit(2), F.lit(_FOLD))))
        return F.concat(F.array(F.lit(0)), let(sums(total, F.lit(0)), each))

    return let(F.transform(pieces, F.length), lambda sizes: F.when(F.size(sizes) <= 2 * _FOLD, sums(sizes, F.lit(0))).otherwise(many(sizes)))


def scan(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,text>> of all matches (which must not be empty), left to right: gaps and matches
    alternate, so a match starts after the gaps up to it and the matches before it."""
    kind = "array<struct<start:int,end:int,text:string>>"

    def of(pieces: Column) -> Column:
        one = lambda at, i: F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(pieces, i).alias("text"))
        found = let(_starts(pieces), lambda at: F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), lambda i: one(at, i)))
        one_match = let(F.length(F.get(pieces, F.lit(0))), lambda n: F.array(F.struct(n.alias("start"), (n + F.length(F.get(pieces, F.lit(1)))).alias("end"), F.get(pieces, F.lit(1)).alias("text"))))
        return F.when(F.size(pieces) == 3, one_match).when(F.size(pieces) > 1, found).when(pieces.isNotNull(), F.array().cast(kind))

    return let(text, lambda t: let(_pieces(t, pattern), of))


def replaced(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern as new(match)."""
    return let(text, lambda t: F.when(t.rlike(pattern), F.array_join(F.transform(_pieces(t, pattern), lambda x, i: F.when(i % 2 == 1, new(x)).otherwise(x)), "")).otherwise(t))


def titled(word: Column) -> Column:
    """Every run of letters with a capital first, as Python's title() does."""
    runs = F.regexp_extract_all(word, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def like_case(model: Column, word: Column) -> Column:
    """word in the case of model: all capitals, all small, capitalised, or as it is."""
    letters = model.rlike(r"\p{L}")
    return F.when(letters & (model == F.upper(model)), F.upper(word)).when(letters & (model == F.lower(model)), F.lower(word)).when(letters & (model == titled(model)), titled(word)).otherwise(word)


def token_count(text: Column) -> Column:
    """Words and marks, the unit in which chunks are measured where no model's tokenizer is plugged in."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0)))


def masked(word: Column) -> Column:
    return F.concat(F.substring(word, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(word) - 1, F.lit(0))))
