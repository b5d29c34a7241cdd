"""Detection: patterns, names by title, credential or list, and what a tagging model says."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import vocab as V
from ..functions.text import let, scan
from . import chunks, nested
from .filters import uncovered
from .spans import dedupe_overlaps

SPAN = "array<struct<type:string,start:int,end:int>>"
RECOGNIZERS = [("POSTCODE", P.STATE_ZIP), ("PHONE_NUMBER", P.PHONE), ("SSN", P.SSN), ("EMAIL", P.EMAIL), ("DATE", P.DATE)]


Found = tuple[int, int, str, float]  # start, end, type, score


class Detector(Protocol):
    """A model: made once in each Python worker, it finds spans in a list of texts, a list of Found for each."""

    def __call__(self, texts: list[str]) -> list[list[Found]]: ...


def by_detector(notes: DataFrame, make: Callable[[], Detector], limit: int = chunks.LIMIT, size: int = chunks.SIZE, overlap: int = chunks.OVERLAP, batch: int = 64) -> DataFrame:
    """doc_id, start, end, type, text of what a model finds in notes (doc_id, text), which it reads in overlapping
    chunks of bounded size: detected in Arrow batches, lifted to the note's offsets, and of overlapping finds of two
    chunks one each. One shuffle, of spans alone, by note."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for p in parts:
            for at in range(0, max(p.num_rows, 1), batch):
                some = p.slice(at, batch)
                docs, starts, texts = (some.column(c).to_pylist() for c in ("doc_id", "start_char", "text"))
                rows = [(d, s + a, s + b, kind, t[a:b]) for d, s, t, found in zip(docs, starts, texts, model(texts)) for a, b, kind, _ in found]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (some.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "start", "end", "type", "text"])

    key = notes.schema["doc_id"].dataType.simpleString()
    parts = chunks.chunk(notes.filter("text is not null"), limit, size, overlap).select("doc_id", "start_char", "text")
    found = parts.mapInArrow(run, f"doc_id {key}, start int, end int, type string, text string")
    rows = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "text")).alias("_s"))
    kept = dedupe_overlaps(F.col("_s"))
    texts = lambda x: F.try_element_at(F.filter("_s", lambda s: (s["start"] == x["start"]) & (s["end"] == x["end"])), F.lit(1))["text"]
    return rows.select("doc_id", F.explode(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), texts(x).alias("text")))).alias("_x")).select("doc_id", "_x.*")


def find(notes: DataFrame, pattern: str, type_: str, score: float = 1.0) -> DataFrame:
    """doc_id, start, end, type, text, score of each match."""
    rows = notes.select("doc_id", F.explode(scan(F.col("text"), pattern)).alias("m"))
    return rows.select("doc_id", "m.start", "m.end", F.lit(type_).alias("type"), "m.text", F.lit(score).alias("score"))


def _first_wins(found: Column, safe: Column) -> Column:
    """Spans in order of their recogniser, without those that overlap a safe one or one before."""

    def step(acc: Column, s: Column) -> Column:
        free = ~F.exists(acc, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
        return F.when(free, F.concat(acc, F.array(s))).otherwise(acc)

    kind = "array<struct<start:int,end:int,type:string,text:string>>"

    def kept(every: Column) -> Column:
        places = F.sort_array(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        some_meet = let(places, lambda p: F.exists(F.transform(p, lambda x, i: x["end"] > F.get(p, i + 1)["start"]), lambda b: F.coalesce(b, F.lit(False))))
        return F.when(some_meet, F.aggregate(every, F.array().cast(kind), step)).otherwise(every)  # pairs are looked at only where some overlap

    return F.filter(let(F.concat(safe.cast(kind), found.cast(kind)), kept), lambda s: s["type"] != "SAFE")


def recognized(text: Column) -> Column:
    """array<struct<start,end,type,text>> by patterns: clock times, rooms and blood pressures are safe and come first,
    then postcodes after a state, phones, SSNs, mail addresses and dates. Nested in the row, so it streams."""

    def spans(pattern: str, type_: str, strip: str | None = None) -> Column:
        def one(m: Column) -> Column:
            word = F.regexp_replace(m["text"], strip, "") if strip else m["text"]
            return F.struct((m["end"] - F.length(word)).alias("start"), m["end"].alias("end"), F.lit(type_).alias("type"), word.alias("text"))

        return F.transform(scan(text, pattern), one)

    safe = F.concat(*[spans(p, "SAFE") for p in (P.CLOCK, P.ROOM, P.BP)])
    return _first_wins(F.concat(*[spans(p, t, r"^[A-Z]{2}\s+" if t == "POSTCODE" else None) for t, p in RECOGNIZERS]), safe)


def recognize(notes: DataFrame) -> DataFrame:
    """doc_id, start, end, type, text of what the patterns find."""
    return notes.select("doc_id", F.explode(recognized(F.col("text"))).alias("s")).select("doc_id", "s.*")


def by_title(notes: DataFrame, type_: str = "NAME") -> DataFrame:
    """Capitalised words after a title on the same line."""
    return nested.of_note(notes, lambda t: nested.by_title(t, type_), 0.9)


def by_credential(notes: DataFrame, type_: str = "NAME") -> DataFrame:
    """Capitalised words before a comma and a credential."""
    return nested.of_note(notes, lambda t: nested.by_credential(t, type_), 0.9)


def by_gazetteer(notes: DataFrame, names: list[str]) -> DataFrame:
    """Capitalised words of a name list that the note never has in small letters and that begin no sentence."""
    return nested.of_note(notes, lambda t: nested.by_gazetteer(t, names), 0.6)


def recall(notes: DataFrame, spans: DataFrame, gazetteer: list[str] | None = None) -> DataFrame:
    """spans and the names by title and credential that they do not cover, and those of the gazetteer if given."""
    out = spans
    for found in (by_title(notes, "LAST_NAME"), by_credential(notes, "LAST_NAME"), *([by_gazetteer(notes, gazetteer)] if gazetteer else [])):
        out = out.unionByName(uncovered(found, out), allowMissingColumns=True)
    return out


def decode_bilou(tags: Column) -> Column:
    """array<struct<type,start,end>> from array<struct<s,e,label>> of token tags, in order.

    Tokens with s = e are special ones and are skipped. O closes; U closes and gives one; B closes and opens; I and
    L of the open type extend (L closes); any other I or L closes and opens an entity that stays open.
    """
    kind = f"struct<open:struct<type:string,start:int,end:int>,out:{SPAN}>"
    none = F.lit(None).cast("struct<type:string,start:int,end:int>")

    def step(acc: Column, t: Column) -> Column:
        tag, typ = F.substring(t["label"], 1, 1), F.substring(t["label"], 3, 64)
        new = F.struct(typ.alias("type"), t["s"].alias("start"), t["e"].alias("end"))
        longer = F.struct(acc["open"]["type"].alias("type"), acc["open"]["start"].alias("start"), t["e"].alias("end"))
        closed = F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        same = tag.isin("I", "L") & acc["open"].isNotNull() & (acc["open"]["type"] == typ)

        def state(o: Column, out: Column) -> Column:
            return F.struct(o.alias("open"), out.alias("out"))  # not cast: that would copy all of out

        return (
            F.when(t["s"] == t["e"], acc)
            .when(tag == "O", state(none, closed))
            .when(tag == "U", state(none, F.concat(closed, F.array(new))))
            .when(same & (tag == "I"), state(longer, acc["out"]))
            .when(same & (tag == "L"), state(none, F.concat(acc["out"], F.array(longer))))
            .otherwise(state(new, closed))
        )

    start = F.struct(none.alias("open"), F.array().cast(SPAN).alias("out")).cast(kind)
    return F.aggregate(tags, start, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))


LABELS = ["O"] + [f"{tag}-{t}" for t in V.ENTITY_TYPES for tag in "BILU"]
