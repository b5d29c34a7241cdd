"""Removal of spans that hide nothing: medical words, time words, clock times and rooms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import nested
from .nested import is_medical, safe_ranges  # noqa: F401


def drop_medical(spans: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Names that are medical words."""
    return _kept(spans, lambda s: nested.without_medical(s, extra))


def drop_medical_pairs(spans: DataFrame) -> DataFrame:
    rows = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "text")).cast(nested.SPANS).alias("_s"))
    return rows.select("doc_id", F.explode(nested.without_medical_pairs(F.col("_s"))).alias("_x")).select("doc_id", "_x.*")


def drop_time_words(spans: DataFrame) -> DataFrame:
    return _kept(spans, nested.without_time_words)


def _kept(spans: DataFrame, make) -> DataFrame:
    return spans.filter(F.size(make(F.array(F.struct("start", "end", "type", "text")).cast(nested.SPANS))) > 0)


Verdict = Callable[[Column, Column], Column]  # span, safe ranges of its note


def with_verdicts(spans: DataFrame | None, notes: DataFrame, **of: Verdict) -> DataFrame:
    """spans with a column for each verdict on them and the safe ranges of their note (null where the note is not
    there). Without spans, those in the notes' rows (spans), as doc_id, start, end, type, text: nothing is joined then."""
    if spans is None:
        fields = ("start", "end", "type", "text")
        one = lambda s, r: F.struct(*[s[f].alias(f) for f in fields], *[say(s, r).alias(n) for n, say in of.items()])
        marked = let(safe_ranges(F.col("text")), lambda r: F.transform("spans", lambda s: one(s, r)))
        return notes.select("doc_id", F.explode(marked).alias("_s")).select("doc_id", "_s.*")
    safe = notes.select(F.col("doc_id").alias("_d"), safe_ranges(F.col("text")).alias("_safe"))
    rows = spans.join(safe, F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    return rows.withColumns({n: say(F.struct("start", "end"), F.col("_safe")) for n, say in of.items()}).drop("_safe")


def is_taken(s: Column, ranges: Column) -> Column:
    """Whether the veto takes the span."""
    return F.coalesce(nested.is_safe(s, ranges), F.lit(False))


def veto_safe(spans: DataFrame | None, notes: DataFrame) -> DataFrame:
    """Spans that lie in no room and strictly in no clock time; those of notes that are not there stay. Without spans,
    those in the notes' rows."""
    if spans is None:
        return notes.select("doc_id", F.explode(nested.without_safe(F.col("spans"), F.col("text"))).alias("_s")).select("doc_id", "_s.*")
    return with_verdicts(spans, notes, _taken=is_taken).filter(~F.col("_taken")).drop("_taken")


def uncovered(new: DataFrame, old: DataFrame) -> DataFrame:
    """Spans of new that overlap none of old, within a document (an anti-join with the document as its key)."""
    o = old.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return new.join(o, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
