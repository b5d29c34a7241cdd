"""Training records for a token tagger."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from .chunks import TOKEN
from .evaluate import label_table

LENGTH, IGNORED = 4096, -100


def known_labels(spans: DataFrame, label: str = "label") -> DataFrame:
    """spans with the entity type of their label; unknown labels drop."""
    names = F.create_map(*[F.lit(x) for pair in V.LABELS.items() for x in pair])
    return spans.withColumn("type", F.try_element_at(names, F.lower(label))).filter("type is not null")


TAGS = "array<struct<s:int,e:int,label:string>>"


def tagged(text: Column, spans: Column) -> Column:
    """array<struct<s,e,label>> of the text's tokens with BILOU labels from array<struct<start,end,type>>: a span's
    only token is U, else B, I and L; where spans share a token the later span has it.

    Over Arrow batches, in time that grows with the tokens: a SQL expression that gathers offsets copies its array once
    for each of them. run() needs nothing of this package where it runs, and is called once a row: what is not
    deterministic is not repeated in the filter that goes before an explode().
    """
    pattern = TOKEN

    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array, types: pa.Array) -> pa.Array:
        import re
        from array import array
        from bisect import bisect_left, bisect_right
        from collections import deque
        from itertools import islice

        token, codes, labels = re.compile(pattern, re.ASCII), {"O": 0}, ["O"]
        code = lambda x: codes.setdefault(x, len(codes)) if x in codes or labels.append(x) is None else 0
        at, until, tags, rows = array("i"), array("i"), array("i"), [0]
        sizes = starts.value_lengths().fill_null(0).to_pylist()
        spans = zip(starts.flatten().to_pylist(), ends.flatten().to_pylist(), types.flatten().to_pylist())
        for t, size in zip(texts.to_pylist(), sizes):
            mine = islice(spans, size)
            if t is None:
                deque(mine, 0)
                rows[-1] = None
                rows.append(len(at))
                continue
            places = [m.span() for m in token.finditer(t)]
            s, e = zip(*places) if places else ((), ())
            tag = [0] * len(s)
            for start, end, kind in mine:
                if start is None or end is None:
                    continue
                low, high = bisect_right(e, start), bisect_left(s, end)
                for i in range(low, high):  # all but blanks is in a token, so a span begins and ends with its outer tokens
                    mark = "U" if high - low == 1 else "B" if i == low else "L" if i == high - 1 else "I"
                    tag[i] = code(None if kind is None else f"{mark}-{kind}")
            at.extend(s)
            until.extend(e)
            tags.extend(tag)
            rows.append(len(at))
        named = pa.array(labels, pa.string()).take(pa.array(tags, pa.int32()))
        flat = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(until, pa.int32()), named], ["s", "e", "label"])
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), flat)

    return F.arrow_udf(run, TAGS).asNondeterministic()(text, spans["start"], spans["end"], spans["type"])


def records(notes: DataFrame, length: int = LENGTH) -> DataFrame:
    """uid, input_ids, attention_mask, labels of notes (doc_id, text, spans), padded to length. Ids are hashes of the
    tokens in place of a model's vocabulary."""
    ids = F.create_map(*[F.lit(x) for n, label, _, _ in label_table() for x in (label, n)])
    rows = notes.withColumn("t", F.slice(tagged(F.col("text"), F.col("spans")), 1, length))
    pad = lambda values, fill: F.concat(values, F.array_repeat(F.lit(fill), length - F.size("t")))
    token = F.transform("t", lambda t: (F.pmod(F.hash(F.substring(F.col("text"), t["s"] + 1, t["e"] - t["s"])), F.lit(50000)) + 1).cast("int"))
    return rows.select(F.col("doc_id").alias("uid"), pad(token, 0).alias("input_ids"), pad(F.transform("t", lambda t: F.lit(1)), 0).alias("attention_mask"), pad(F.transform("t", lambda t: F.coalesce(F.try_element_at(ids, t["label"]), F.lit(0))), IGNORED).alias("labels"))


def in_training(uid: Column, share: int = 80, seed: int = 42) -> Column:
    """Whether a record is for training: by a hash of its id, so the split does not depend on layout."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), uid.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return h % 100 < share
