"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 20
MOST_CLASSES = 1000


def fold(ident: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a null id counts as the text 'null')."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary")) % 3


def held_out(ident: Column) -> Column:
    return fold(ident) == 1


def sample_by_class(rows: DataFrame, ident: str, label: str, each: int, most_classes: int = MOST_CLASSES) -> DataFrame:
    """About each rows of every class of rows (all of a class that has fewer), by a hash of the id: the share of a
    class is fixed by its count, so the sample's size does not grow with the table. Rows without a label take no
    part. More than most_classes classes are an error: labels of that kind name no classes."""
    found = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).limit(most_classes + 1).collect()
    if len(found) > most_classes:
        raise ValueError(f"{label} has over {most_classes} values")
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(ident)), F.lit(_STEPS))
    keep = F.lit(False)
    for r in sorted(found, key=lambda r: r[label]):
        keep = F.when(F.col(label) == r[label], place < max(1, round(_STEPS * min(1.0, each / r["n"])))).otherwise(keep)
    return rows.filter(F.col(label).isNotNull() & keep)


def slices(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time: texts may be long, and Python holds a slice's texts at once."""
    for p in parts:
        for i in range(0, max(p.num_rows, 1), rows):
            yield p.slice(i, rows)
