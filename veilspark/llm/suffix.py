"""Operator 4: repeated passages, looked up at minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import slices
from .skew import joined
from .store import fresh, written
from .words import window_hashes, word_spans

PASSAGE = 50  # words that a repeated passage has at least
ANCHOR = 20  # words of a suffix that its hash covers
SPAN = PASSAGE - ANCHOR + 1  # anchors of which one is kept: any passage holds a whole such window


def anchors_by_window(hashes: np.ndarray) -> np.ndarray:
    """For each passage of PASSAGE words, in order, the position of its anchor: the least of its SPAN anchor hashes,
    the first of equals. It depends on the passage's words alone and never goes back from one passage to the next."""
    g = window_hashes(hashes, ANCHOR)
    if len(g) < SPAN:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(g, SPAN).argmin(axis=1) + np.arange(len(g) - SPAN + 1)


def anchors_of(hashes: np.ndarray) -> np.ndarray:
    """Positions of the suffixes that are kept: the anchors of all passages, so that equal passages keep the same
    place."""
    least = anchors_by_window(hashes)
    return least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least


def _anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in slices(parts):
        docs, at, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for doc, text in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist()):
            h = word_spans(text.encode("utf-8", "surrogatepass"))[2]
            if len(h) >= PASSAGE:
                pos = anchors_of(h)
                docs.append(np.full(len(pos), doc, np.int64))
                at.append(pos.astype(np.int32))
                hs.append(window_hashes(h, ANCHOR)[pos])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(at)), pa.array(np.concatenate(hs).view(np.int64))], ["doc", "pos", "h"])


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each kept suffix the passages of PASSAGE words whose anchor it is, as hashes: start is the word the first
    of them begins with, each next one begins a word later."""
    for p in slices(parts):
        docs, texts, at, sizes, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for doc, same, text, places in zip(*(p.column(c).to_pylist() for c in ("doc_id", "same", "text", "places"))):
            h = word_spans(text.encode("utf-8", "surrogatepass"))[2]
            least = anchors_by_window(h)
            kept = np.flatnonzero(np.isin(least, places))
            if len(kept):
                first = np.flatnonzero(np.diff(least[kept], prepend=-1))
                docs.append(np.full(len(first), doc, np.int64))
                texts.append(np.full(len(first), same, np.int64))
                at.append(kept[first].astype(np.int32))
                sizes.append(np.diff(first, append=len(kept)))
                hs.append(window_hashes(h, PASSAGE)[kept])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hs).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(texts)), pa.array(np.concatenate(at)), lists], ["doc", "same", "start", "passages"])


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (after the last), n_words, later, other_doc: the passages of docs (doc_id, text)
    of at least 50 words that another document holds too, joined where they overlap.

    later is true where a document with a smaller doc_id holds the passage, so that dropping the later ones keeps
    each passage once; other_doc is one that shares it. Words that lie in a passage of 50 words which no document
    with a smaller doc_id holds are in a row with later false. Words are what lies between spaces and U+0009 to
    U+000D. Passages that repeat within one document alone do not count, nor do shorter ones; null and empty texts
    have none; rows without doc_id take no part; repeated rows of a doc_id are one document. An empty table gives an
    empty result; other columns are left alone.

    Suffixes are kept at minimisers of 20-word hashes, so any 50 common words have a suffix in common. For those
    whose hash another document has, all passages of 50 words that have the suffix as their minimiser are looked up
    by the least and the largest doc_id of each: every passage has one minimiser, so none is left out, whatever the
    number of documents that share a suffix. Suffixes with equal passages are looked up once. Rows of a suffix, a
    passage or a context that very many have stay where they are (skew.joined). Texts may be of any length: a
    text's words and hashes are held at once, of no more than one text.
    """
    return _repeated(docs).drop("same")


def _repeated(docs: DataFrame) -> DataFrame:
    """repeated(docs) with same, a hash of the text: rows of one doc_id may differ in it."""
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    kept = written(rows.mapInArrow(_anchors, "doc long, pos int, h long"), "suffixes")
    shared = kept.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).filter("a < b").select("h", "n")
    places = joined(kept, written(shared, "anchors-shared"), "h").groupBy("doc").agg(F.collect_set("pos").alias("places"))
    text = rows.join(places, rows["doc_id"] == places["doc"]).select("doc_id", F.xxhash64("text").alias("same"), "text", "places")
    sets = text.mapInArrow(_windows, "doc long, same long, start int, passages array<long>")
    sets = written(sets.withColumn("c", F.xxhash64("passages")), "passages")
    once = sets.groupBy("c").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.first("passages").alias("passages"), F.count("*").alias("n"))
    once = written(once, "passages-once")
    wide = once.select("c", "first", "last", F.posexplode("passages").alias("k", "w"))
    held = wide.groupBy("w").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("n")).filter("least < most")
    held = written(held, "passages-held")
    later = F.col("least") < F.col("first")
    found = joined(wide, held, "w").select("c", "k", later.cast("int").alias("later"), F.when(later, F.col("least")).otherwise(F.col("most")).alias("other"))
    # Passages of one minimiser begin at most 30 words apart, so they overlap and are one span.
    found = found.groupBy("c", "later").agg(F.min("k").alias("k"), F.max("k").alias("k_last"), F.min("other").alias("other"))
    marks = found.groupBy("c").agg(F.collect_list(F.struct("k", "k_last", "other", "later")).alias("marks"))
    contexts = once.select("c", "first", "last", "n").join(marks, "c", "left").filter("marks is not null or last > first").drop("last")
    members = sets.select("c", "doc", "same", F.col("start").cast("long").alias("start"), F.size("passages").alias("size"))
    members = joined(members, written(contexts, "contexts"), "c")
    span = lambda start, stop, other, late: F.struct(start.alias("start"), stop.alias("stop"), other.alias("other"), late.alias("later"))
    start = F.col("start")
    own = F.transform("marks", lambda m: span(start + m["k"], start + m["k_last"] + PASSAGE, m["other"], m["later"]))
    rest = F.array(span(start, start + F.col("size") - 1 + PASSAGE, F.col("first"), F.lit(1)))
    spans = members.select("doc", "same", F.explode(F.when(F.col("doc") == F.col("first"), own).otherwise(rest)).alias("s"))
    return _joined(spans.select("doc", "same", "s.*"))


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a text as one, later ones and others apart."""
    one = spans.groupBy("doc", "same", "later", "start").agg(F.max("stop").alias("stop"), F.min("other").alias("other"))
    order = Window.partitionBy("doc", "same", "later").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") < F.coalesce(reach, F.lit(-1)), 0).otherwise(1)
    isle = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = one.withColumn("new", new).withColumn("isle", isle).groupBy("doc", "same", "later", "isle").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other").alias("other_doc"))
    return out.select(F.col("doc").alias("doc_id"), "same", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), (F.col("later") == 1).alias("later"), "other_doc")


def _cut(columns: list[str], text: str, cuts: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(parts):
            out = []
            for whole, found in zip(p.column(text).to_pylist(), p.column(cuts).to_pylist()):
                data = whole.encode("utf-8", "surrogatepass")
                starts, ends, _ = word_spans(data)
                kept, at = [], 0
                for a, b in sorted((c["a"], c["b"]) for c in found):
                    kept.append(data[at : starts[a]])
                    at = int(starts[b]) if b < len(starts) else len(data)
                kept.append(data[at:])
                out.append(b"".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else p.column(c) for c in columns], columns)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with each repeated passage cut from all documents but that with the smallest doc_id; a document that
    consists of such passages alone goes.

    Rows without doc_id or text stay as they are, and so do all other columns, whatever their names; repeated rows
    are cut alike; an empty table gives an empty result. Where rows of one doc_id differ in their text each is cut
    by its own spans.
    """
    ident, same, cuts = (fresh(docs.columns, c) for c in ("_id", "_same", "_cuts"))
    spans = F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b")))
    found = _repeated(docs).filter("later").groupBy(F.col("doc_id").alias(ident), F.col("same").alias(same)).agg(spans.alias(cuts))
    both = docs.join(found, (docs["doc_id"] == found[ident]) & (F.xxhash64(docs["text"]) == found[same]), "left").drop(ident, same)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    touched = both.filter(F.col(cuts).isNotNull()).mapInArrow(_cut(docs.columns, "text", cuts), schema).filter("trim(text) <> ''")
    return both.filter(F.col(cuts).isNull()).drop(cuts).unionByName(touched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
