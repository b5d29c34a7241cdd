"""Draws that depend on a key alone: the same for any order of rows and any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(*parts) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def number(k: Column) -> Column:
    """0 to 2^32 - 1, from the first 8 hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint")


def below(k: Column, n) -> Column:
    return F.pmod(number(k), F.lit(n) if isinstance(n, int) else n)


def between(k: Column, low: int, high: int) -> Column:
    return below(k, high - low + 1) + low


def pick(k: Column, pool: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (below(k, len(pool)) + 1).cast("int"))


def chars(k: Column, n: Column, alphabet: str = "0123456789") -> Column:
    """n characters, each drawn by the key and its place."""
    each = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(each, lambda i: F.substring(F.lit(alphabet), (below(F.concat_ws("|", k, i.cast("string")), len(alphabet)) + 1).cast("int"), F.lit(1))), "")
