"""Overlapping pieces of long notes, for detectors that read a bounded number of tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import scan, token_count

LIMIT, SIZE, OVERLAP, RANGE = 4096, 3500, 256, 200
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"


def boundary(text: Column, target: Column, reach: int = RANGE) -> Column:
    """The sentence or paragraph end nearest to target within reach, else the nearest line end, else target."""
    low = F.greatest(target - reach, F.lit(0))
    window = F.substring(text, low + 1, F.least(target + reach, F.length(text)) - low)

    def nearest(pattern: str) -> Column:
        near = F.transform(scan(window, pattern), lambda m: F.struct(F.abs(low + m["end"] - target).alias("d"), (low + m["end"]).alias("p")))
        return F.array_min(near)["p"]

    return F.coalesce(nearest(P.SENTENCE), nearest(r"\n"), target)


PIECES = "array<struct<chunk_id:int,text:string,start_char:int,end_char:int>>"


def pieces(text: Column, limit: int, size: int, overlap: int) -> Column:
    """The pieces of chunk() as an array, over Arrow batches: one pass over the text's tokens, and boundary() looked for
    in the window of a piece alone. run() needs nothing of this package where it runs."""
    token_, sentence_, reach, step = TOKEN, P.SENTENCE, RANGE, size - overlap

    def run(texts: pa.Array) -> pa.Array:
        import re

        token, ends = re.compile(token_, re.ASCII), [re.compile(p, re.ASCII) for p in (sentence_, "\n")]

        def boundary(t: str, target: int) -> int:
            low = max(target - reach, 0)
            window = t[low : min(target + reach, len(t))]
            for pattern in ends:
                if near := [(abs(low + m.end() - target), low + m.end()) for m in pattern.finditer(window)]:
                    return min(near)[1]
            return target

        def of(t: str | None) -> list[tuple]:
            if t is None:
                return [(0, None, 0, None)]
            at = [m.span() for m in token.finditer(t)]
            n = len(at)
            if n <= limit:
                return [(0, t, 0, len(t))]
            out = []
            for i in range(max(-((size - n) // step), 0) + 1):
                first = i * step
                end = len(t) if first + size >= n else at[first + size - 1][1]
                start = 0
                if first:
                    start, back = at[first][0], first - overlap
                    snapped = boundary(t, start)
                    least = at[back][0] if 0 <= back < n else 0
                    start = snapped if least <= snapped <= start else start
                out.append((i, t[start:end], start, end))
            return out

        rows = [of(t) for t in texts.to_pylist()]
        at = [0]
        for r in rows:
            at.append(at[-1] + len(r))
        columns = list(zip(*(x for r in rows for x in r))) or [[]] * 4
        flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["chunk_id", "text", "start_char", "end_char"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)

    return F.arrow_udf(run, PIECES).asNondeterministic()(text)  # so it is not repeated in a filter


def chunk(notes: DataFrame, limit: int = LIMIT, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_id, text, start_char, end_char: the whole note if it has at most limit tokens, else pieces of at
    most size tokens that overlap by overlap tokens and begin at a boundary where one is near."""
    rows = notes.select("doc_id", pieces(F.col("text"), limit, size, overlap).alias("_p"))
    return rows.select("doc_id", F.inline("_p")).select("doc_id", "chunk_id", "text", "start_char", "end_char")


def lift(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (doc_id, chunk_id, start, end, type) with offsets in the note."""
    return spans.join(chunks.select("doc_id", "chunk_id", "start_char"), ["doc_id", "chunk_id"]).select("doc_id", (F.col("start") + F.col("start_char")).alias("start"), (F.col("end") + F.col("start_char")).alias("end"), "type")


def validate(notes: DataFrame) -> DataFrame:
    """doc_id, token_count, exceeds_limit, estimated_chunks."""
    n = token_count(F.col("text"))
    return notes.select("doc_id", n.alias("token_count")).withColumn("exceeds_limit", F.col("token_count") > LIMIT).withColumn("estimated_chunks", F.when(F.col("token_count") <= LIMIT, 1).otherwise(F.ceil(F.col("token_count") / (SIZE - OVERLAP)).cast("int")))
