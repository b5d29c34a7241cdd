"""Checks of what detection and filtering did: provider names that nothing covers, what a name list costs and brings,
what the veto takes, and the documents and misses that a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import cut, masked, scan
from . import nested
from .filters import is_taken, uncovered, with_verdicts

CONTEXT = 18  # characters on either side in which neighbours are looked for
REPEAT = 65536


def provider_leaks(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, start, end, token: capitalised words of providers (by credential or title, over line ends too) that no
    span covers, each place once for every pattern that finds it."""
    found = F.flatten(F.array(*[F.transform(scan(F.col("text"), p), lambda m: F.struct(m["start"].alias("at"), m["text"].alias("x"))) for p in P.PROVIDERS]))
    rows = notes.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.at", F.explode(scan(F.col("m.x"), r"[A-Z][a-z]{2,}")).alias("w"))
    words = rows.select("doc_id", (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"), F.col("w.text").alias("token"))
    return uncovered(words.filter(F.lower("token") != "nurse"), spans)


def list_cost(found: DataFrame, base: DataFrame, terms: list[str], corpus: str) -> DataFrame:
    """corpus, added, terms, names, term_share: of what the list found beyond base, how much is a clinical term (a
    cost: meaning is lost) and how much looks like a name (a benefit), for each corpus."""
    added = found.join(base.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti")
    term = F.lower("text").isin([t.lower() for t in terms])
    out = added.groupBy(corpus).agg(F.count("*").alias("added"), F.count_if(term).alias("terms"))
    return out.select(corpus, "added", "terms", (F.col("added") - F.col("terms")).alias("names"), F.round(F.col("terms") / F.col("added"), 6).alias("term_share"))


def neighbours(note: Column, start: Column, end: Column) -> Column:
    """The last word before and the first word after, as left _ right (^ and $ where there is none)."""
    left = F.regexp_extract_all(cut(note, F.greatest(start - CONTEXT, F.lit(0)), start), F.lit("[A-Za-z]+"), F.lit(0))
    right = F.regexp_extract_all(cut(note, end, end + CONTEXT), F.lit("[A-Za-z]+"), F.lit(0))
    return F.concat(F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("^")), F.lit(" _ "), F.coalesce(F.try_element_at(right, F.lit(1)), F.lit("$")))


def top_contexts(found: DataFrame, notes: DataFrame, k: int = 5) -> DataFrame:
    """token (masked), context, n, rank: the k commonest neighbours of each token, equal counts by context."""
    rows = found.join(notes.withColumnRenamed("text", "_note"), "doc_id").select(masked(F.col("text")).alias("token"), neighbours(F.col("_note"), F.col("start"), F.col("end")).alias("context"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("n").desc(), "context"))
    return rows.groupBy("token", "context").agg(F.count("*").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= k)


def veto_by_type(spans: DataFrame | None, notes: DataFrame) -> DataFrame:
    """type, gold, overlap (pairs with a safe range), vetoed. Without spans, of those in the notes' rows."""
    pairs = lambda s, ranges: F.size(F.filter(ranges, lambda r: nested.meets(r, s)))
    rows = with_verdicts(spans, notes, _pairs=pairs, _taken=is_taken)
    return rows.groupBy("type").agg(F.count("*").alias("gold"), F.sum("_pairs").alias("overlap"), F.count_if("_taken").alias("vetoed"))


def set_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The rows of either table that the other lacks, with side: missing or unexpected."""
    signed = lambda df, n: df.withColumn("_n", F.lit(n))
    return counted_differences(signed(expected, 1).union(signed(actual, -1)))


def counted_differences(rows: DataFrame, n: str = "_n") -> DataFrame:
    """set_differences() of rows that say how often more they are expected than they are there (n, which may be less
    than zero): rows of zero go before anything moves, and equal rows are counted once for both sides."""
    keys = [F.col(f"`{c}`") for c in rows.columns if c != n]
    many = rows.filter(F.col(n) != 0).groupBy(*keys).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)
    # As many rows as are missing, in two steps, so that no array is long.
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.abs(n) - 1) / REPEAT))
    many = many.withColumn("_i", F.explode(steps))
    many = many.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEAT).cast("long"), F.abs(n) - F.col("_i") * REPEAT))))
    return many.select(*keys, F.when(F.col(n) > 0, "missing").otherwise("unexpected").alias("side"))


def of_domain(docs: DataFrame, keywords: list[str], domain: str = "domain") -> DataFrame:
    """Documents whose domain holds one of the keywords, in any case."""
    return docs.filter(F.lower(domain).rlike("|".join(k.lower() for k in keywords)))


def first_with_gold(docs: DataFrame, n: int, spans: str = "spans", order: str = "doc_id") -> DataFrame:
    """The first n documents, in order, that have a span."""
    return docs.filter(F.size(spans) > 0).orderBy(order).limit(n)


def misses(gold: DataFrame, pred: DataFrame, n: int = 50) -> DataFrame:
    """The first n gold spans that no found one overlaps, in order of document and place."""
    return uncovered(gold, pred).orderBy("doc_id", "start", "end").limit(n)


def best_epoch(metrics: DataFrame) -> DataFrame:
    """epoch, f1 of the best epoch, the earliest of equals (a later one must be strictly better)."""
    return metrics.agg(F.max(F.struct("f1", -F.col("epoch"))).alias("b")).select((-F.col("b.col2")).alias("epoch"), F.col("b.f1").alias("f1"))


def masked_spans(log: DataFrame, texts: DataFrame) -> DataFrame:
    """A de-identification log (study_id, start, end, type) with what stands at each place in the masked text."""
    return log.join(texts, "study_id").select("study_id", "start", "end", "type", cut(F.col("text"), F.col("start"), F.col("end")).alias("masked"))


def shared_words(a: Column, b: Column) -> Column:
    """Whether two texts have a word in common, but for case."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]{4,}"), F.lit(0))
    return F.arrays_overlap(words(a), words(b))


def names_of(*lists: DataFrame) -> DataFrame:
    """The different names of several lists (name), in small letters."""
    out = lists[0].select(F.lower("name").alias("name"))
    for x in lists[1:]:
        out = out.unionByName(x.select(F.lower("name").alias("name")))
    return out.distinct()
