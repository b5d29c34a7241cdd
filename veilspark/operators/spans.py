"""Passes that join, split, trim and repair tables of spans (doc_id, start, end, type, text) against their notes
(doc_id, text); each is a pass of nested.py over the spans of a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import nested


def merge_same_type(spans: DataFrame, notes: DataFrame, max_gap: int = 2) -> DataFrame:
    return nested.by_note(spans, notes, lambda s, note: nested.joined_same_type(s, note, max_gap))


def dedupe_overlaps(spans: Column) -> Column:
    """Of an array of spans from overlapping chunks, one of each that overlap by over half of either: the longer,
    else the earlier. Order matters: spans come by start, longest first, and the first kept one they meet decides."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["type"].alias("type"))))
    kind = "array<struct<start:int,back:int,end:int,type:string>>"

    def much(a: Column, b: Column) -> Column:
        over = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
        return (over > 0) & ((2 * over > a["end"] - a["start"]) | (2 * over > b["end"] - b["start"]))

    def met(acc: Column, s: Column) -> Column:
        def at_(at: Column) -> Column:
            old = F.try_element_at(acc, at)
            longer = s["end"] - s["start"] > old["end"] - old["start"]
            swapped = F.transform(acc, lambda k, i: F.when(i == at - 1, s).otherwise(k))
            return F.when(at == 0, F.concat(acc, F.array(s))).when(longer, swapped).otherwise(acc)

        return F.when(F.size(acc) == 0, F.array(s)).otherwise(let(F.array_position(F.transform(acc, lambda k: much(k, s)), True).cast("int"), at_))

    # Spans that end before the next one starts are met by none that follow: only the others are looked at.
    state = f"struct<done:{kind},live:{kind},until:int>"
    make = lambda done, live, until: F.struct(done.alias("done"), live.alias("live"), until.alias("until"))

    def step(acc: Column, s: Column) -> Column:
        past = make(F.concat(acc["done"], acc["live"]), F.array(s), s["end"])
        return F.when(s["start"] >= acc["until"], past).otherwise(make(acc["done"], met(acc["live"], s), F.greatest(acc["until"], s["end"])))

    none = F.array().cast(kind)
    first = F.aggregate(ordered.cast(kind), make(none, none, F.lit(None).cast("int")).cast(state), step, lambda acc: F.concat(acc["done"], acc["live"]))
    return F.transform(first, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))


def repair_fragments(spans: DataFrame, notes: DataFrame) -> DataFrame:
    return nested.by_note(spans, notes, nested.whole_names)


merge_dates = nested.joined_dates


def trim_dates(spans: DataFrame) -> DataFrame:
    return _each(spans, nested.trimmed_dates)


def combine_names(spans: DataFrame, notes: DataFrame) -> DataFrame:
    return nested.by_note(spans, notes, nested.combined_names)


def split_names(spans: DataFrame) -> DataFrame:
    return _each(spans, nested.split_names)


def repair_identifiers(spans: DataFrame, notes: DataFrame) -> DataFrame:
    return nested.by_note(spans, notes, nested.repaired_identifiers)


def trim_identifiers(spans: DataFrame) -> DataFrame:
    return _each(spans, nested.trimmed_identifiers)


def retype_births(spans: DataFrame, notes: DataFrame) -> DataFrame:
    return nested.by_note(spans, notes, nested.retyped_births)


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    rows = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "text")).cast(nested.SPANS).alias("_s"))
    return rows.select("doc_id", F.explode(nested.without_overlaps(F.col("_s"))).alias("_x")).select("doc_id", "_x.*")


def _each(spans: DataFrame, make) -> DataFrame:
    """A pass that looks at a span alone: nothing is grouped."""
    one = F.array(F.struct("start", "end", "type", "text")).cast(nested.SPANS)
    return spans.select("doc_id", F.explode(make(one)).alias("_x")).select("doc_id", "_x.*")
