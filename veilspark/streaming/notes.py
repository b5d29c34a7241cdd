"""De-identification of a stream of notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions import surrogates
from ..operators import detect, rewrite
from ..plans.pipeline import deidentify


def pattern_stream(notes: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, text with what the recognizers find replaced: row by row, so it runs in append mode without state."""
    kind = "array<struct<start:int,end:int,type:string,text:string>>"
    text = F.col("text")
    found = notes.withColumn("_s", F.array_sort(detect.recognized(text)).cast(kind))
    made = F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), surrogates.surrogate(F.col("doc_id"), s["type"], s["text"], seed).alias("surrogate")))
    return found.withColumn("_s", made).select("doc_id", rewrite.splice(text, F.col("_s")).alias("text"))


def full_stream(notes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: EngineConfig = EngineConfig()) -> StreamingQuery:
    """The whole pipeline over each micro-batch (all state is within a note, so batches do not depend on each other)."""
    return notes.writeStream.foreachBatch(lambda batch, n: sink(deidentify(batch, cfg=cfg), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
