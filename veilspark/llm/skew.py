"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HEAVY = 1 << 11  # keys that are broadcast, at most: one that has more than this part of all rows


def joined(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows joined with keys (key, n, and what else they bring) on key; n is left out.

    keys is a written table of different keys, n the number of rows of each. A key that has over 1 / MOST_HEAVY of
    the rows counted is heavy, so there are fewer than MOST_HEAVY of them: these go to all tasks, and their rows are
    not moved. The other keys are joined by a shuffle, in which no key has a large part.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > total / MOST_HEAVY
    k = F.broadcast(keys.filter(heavy).select(F.col(key).alias("_heavy")))
    marked = rows.join(k, F.col(key) == F.col("_heavy"), "left")
    light = marked.filter("_heavy is null").drop("_heavy").join(keys.filter(~heavy).drop("n").hint("merge"), key)
    hot = marked.filter("_heavy is not null").drop("_heavy").join(F.broadcast(keys.filter(heavy).drop("n")), key)
    return light.unionByName(hot)
