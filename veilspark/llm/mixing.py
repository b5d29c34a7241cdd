"""Operator 8: mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import fresh, written

WORD_GAP = r"[\x20\x09-\x0D]+"
STEP_BITS, STEPS = 10, 4  # a key's place has 40 bits; each step looks 10 bits further into the bucket that holds the cut
SORTED_ROWS = 100_000  # documents of one bucket that are sorted at once, unless their places are all equal
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    parts = F.split(text, WORD_GAP, -1)
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def uniform(ident: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def quality_weight(quality: Column) -> Column:
    """2 for a document labelled good, 0.5 for one labelled bad, 1 without a label."""
    return F.when(quality == 1, 2.0).when(quality == 0, 0.5).otherwise(1.0)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights go round the sources in order; what
    exceeds most times a source's size is shared by weight among the others (filled like connected vessels,
    so one pass over the sources in order of cap / weight settles it). The two windows without a key hold one
    row for each source, never documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when(rank % len(weights) == i, x).otherwise(w)
    cap = F.col("source_size") * most
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", cap)
    up = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (
        s.withColumn("caps_before", F.sum("cap").over(before) - F.col("cap"))
        .withColumn("w_from", F.sum("w").over(every) - F.sum("w").over(before) + F.col("w"))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("caps_before").cast("double")) / F.col("w_from").cast("double"))
        .withColumn("full", F.col("cap").cast("double") <= F.col("level") * F.col("w").cast("double"))
    )
    at = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(at * F.col("w").cast("double")).alias("target"))


def keyed(rows: DataFrame, quality: Column, seed: int) -> DataFrame:
    """rows with their sampling key, its place (where the key lies among all keys, 0 to 2^40 - 1) and what orders
    equal keys."""
    places = 1 << (STEP_BITS * STEPS)
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality
    place = F.least(F.lit(places - 1), F.floor((1 - F.exp(-F.col("_key"))) * places))
    return rows.select("doc_id", "source", "size", key.alias("_key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_tie")).withColumn("_place", place.cast("long"))


def cuts(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row for each source: source_size, target, epochs (complete ones) and where the last, fractional one
    stops: everything at places under _at, and from there to before _until all up to _cut.

    rows: source, size, _key, _place, _tie. Sizes are summed by source and bucket of places first, so prefix sums
    run over at most 1,024 rows for a source; the bucket that holds the cut is looked into in the same way until few
    documents are left, and only these are sorted. Documents of equal key, id and size are taken together.
    """
    sums = written(rows.groupBy("source", F.shiftright("_place", STEP_BITS * (STEPS - 1)).alias("_bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    edge = goal.withColumn("rest", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")).withColumn("below", F.lit(0).cast("long"))
    names = [*edge.columns]
    for step in range(STEPS):
        bits = STEP_BITS * (STEPS - 1 - step)
        over = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("_upto", F.sum("words").over(over)).withColumn("_below", F.col("_upto") - F.col("words"))
        g, r = edge.alias("g"), run.alias("r")
        stop = (F.col("g.source").eqNullSafe(F.col("r.source"))) & (F.col("g.below") + F.col("r._below") < F.col("g.rest")) & (F.col("g.rest") <= F.col("g.below") + F.col("r._upto"))
        own = [F.col(f"g.{c}") for c in names if c != "below"]
        edge = g.join(r, stop, "left").select(*own, (F.col("g.below") + F.coalesce("_below", F.lit(0))).alias("below"), F.shiftleft(F.coalesce("r._bucket", F.lit(-1)), bits).alias("_at"), F.shiftleft(F.coalesce("_bucket", F.lit(-1)) + 1, bits).alias("_until"), F.coalesce("r.n", F.lit(0)).alias("n"))
        edge = written(edge, "mix-edges")
        near = _near(rows, edge)
        if step == STEPS - 1 or (edge.agg(F.max("n")).first()[0] or 0) <= SORTED_ROWS:
            break
        sums = written(near.groupBy("source", F.shiftright("_place", bits - STEP_BITS).alias("_bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-sums")
    order = Window.partitionBy("source").orderBy("_key", "_tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = near.groupBy("source", "_key", "_tie", "size", "below", "rest").agg((F.count("*") * F.col("size")).alias("words"))
    last = same.withColumn("upto", F.sum("words").over(order) + F.col("below")).filter(F.col("upto") - F.col("words") / 2 <= F.col("rest"))
    last = last.groupBy("source").agg(F.max(F.struct("_key", "_tie", "size")).alias("_cut"))
    e, t = edge.alias("e"), last.alias("t")
    return e.join(t, F.col("e.source").eqNullSafe(F.col("t.source")), "left").select("e.source", "source_size", "target", "epochs", "_at", "_until", "_cut")


def _near(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """The rows of each source between _at and _until."""
    e = _small(edge.select("source", "_at", "_until", "below", "rest")).alias("e")
    hit = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d._place") >= F.col("e._at")) & (F.col("d._place") < F.col("e._until"))
    return rows.alias("d").join(e, hit).select("d.source", "size", "_key", "_tie", "_place", "below", "rest")


def _small(table: DataFrame) -> DataFrame:
    """Broadcast only where a count of its rows (one for each source) shows that it is small."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def taken_times() -> Column:
    inside = (F.col("_place") < F.col("_at")) | ((F.col("_place") < F.col("_until")) & F.coalesce(F.struct("_key", "_tie", "size") <= F.col("_cut"), F.lit(False)))
    return F.col("epochs") + F.when(inside, 1).otherwise(0)


def with_quality(docs: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, Column]:
    """docs with the label that weighs their keys; repeated labels of a document: the largest."""
    if labels is None:
        return docs, F.lit(1.0)
    best = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality")).filter("_id is not null")
    return docs.join(best, docs["doc_id"] == F.col("_id"), "left").drop("_id"), quality_weight(F.col("_quality"))


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 8) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, taken (words, repeats
    counted), times.

    docs: doc_id, text, source (more columns are left alone). A source's documents are taken in complete epochs
    first; the rest of its target goes to documents in the order of exponential keys divided by their quality
    weight, up to the document whose middle passes the target. Null and empty texts have size 0; null is a source
    of its own, after the others; repeated rows count as rows; an empty table gives an empty result; a source of
    empty texts has target 0. Equal keys go by doc_id, then size, and rows equal in those go together. Texts may be
    of any length. The same rows give the same mix in any layout.
    """
    slim = docs.select("doc_id", "text", "source").withColumn("size", word_count(F.col("text"))).drop("text")
    rows, quality = with_quality(slim, labels)
    rows = written(keyed(rows, quality, seed), "mix-keys")
    cut = _small(written(cuts(rows, weights, share, most), "mix-cuts"))
    d, c = rows.alias("d"), cut.alias("c")
    out = d.join(c, F.col("d.source").eqNullSafe(F.col("c.source"))).withColumn("times", taken_times())
    return out.select("doc_id", "d.source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken (not at all, once or up to most times).

    How often a row is taken depends on its doc_id, source and size alone, so rows without doc_id and rows of a
    repeated one are each taken by their own size. Null and empty texts have no words and are taken with their
    place in the order; all columns stay, whatever their names; an empty table gives an empty result.
    """
    ident, source, size, times, copy, mine = (fresh(docs.columns, c) for c in ("_id", "_source", "_size", "_times", "_copy", "_words"))
    taken = mix_sources(docs, labels, **how).filter("times > 0")
    taken = taken.select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("size").alias(size), F.col("times").alias(times)).distinct()
    rows = docs.withColumn(mine, word_count(F.col("text")))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("doc_id", ident), ("source", source), (mine, size))]
    out = rows.join(taken, same[0] & same[1] & same[2])
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_sources(docs, labels).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with q as (select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id),
d as (
  select documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5('8:' || coalesce(documents.doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
      / case quality when 1 then 2.0 when 0 then 0.5 else 1.0 end as k
  from documents left join q on documents.doc_id = q.doc_id),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, source_size * 2 as cap from s),
l as (
  select *, ((sum(source_size) over ())::double * 1.5 - ((sum(cap) over up) - cap)::double) / ((sum(w) over ()) - (sum(w) over up) + w)::double as level
  from w window up as (order by cap::double / w, source nulls last rows unbounded preceding)),
f as (select *, cap::double <= level * w as capped from l),
t as (
  select source, source_size, case when capped then cap::double else (max(case when not capped then level end) over ()) * w::double end as target from f),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
p as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - (e.epochs * e.source_size)::double as rest,
    sum(d.size) over (partition by d.source order by k, coalesce(d.doc_id, -9223372036854775808), d.size rows unbounded preceding) as upto
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target,
  (size * (epochs + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end))::bigint as taken
from p
"""
