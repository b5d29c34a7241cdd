"""Operator 10: homomorphic multiset fingerprints of documents (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A paragraph is a piece that ends with a line or sentence end and the blanks after it; the pieces of a text
# joined in order are the text.
PARAGRAPH = r"[^.!?\n]*[.!?\n][.!? \t\r\n]*|[^.!?\n]+"
BITS = 30  # of a lane: sums are modulo 2^30, more than the paragraphs of any text of under 2^31 bytes
MOD = 1 << BITS
SHOWN = 1 << 14  # a fingerprint shows lanes and count modulo this
LANES = 128  # the bits of an MD5
PAIRS = LANES // 2  # lanes i and i + 32 of 64 hash bits share a long, as fields of 32 bits that sums never fill
ONES = 0x0000000100000001
FIELDS = (MOD - 1) << 32 | (MOD - 1)
MAX_RANGES = 1 << 14


def _hex64(h: Column, at: int) -> Column:
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return F.shiftleft(part(at), 32).bitwiseOR(part(at + 8))


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and vec, the sum of the vectors of the paragraphs of text, for each of rows (keys must be unique).

    A paragraph's vector is 0 or 1 in each of 128 lanes: the bits of its MD5. Sums modulo 2^30 do not depend on
    the order; vectors of parts add up, and a paragraph is inserted or deleted by adding or subtracting its
    vector (combine). vec holds 64 longs of two lanes each and the number of paragraphs, all modulo 2^30. Null
    counts as the empty text, which has no paragraph.
    """
    parts = rows.select(*keys, F.explode_outer(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))).alias("_p"))
    hashed = parts.select(*keys, F.md5("_p").alias("_h")).select(*keys, _hex64(F.col("_h"), 1).alias("_a"), _hex64(F.col("_h"), 17).alias("_b"))
    sums = [F.sum(F.shiftright(w, i).bitwiseAND(F.lit(ONES))).alias(f"{w}{i}") for w in ("_a", "_b") for i in range(32)]
    out = hashed.groupBy(*keys).agg(F.count("_a").alias("_n"), *sums)
    lanes = [F.coalesce(F.col(f"{w}{i}"), F.lit(0)).bitwiseAND(F.lit(FIELDS)) for w in ("_a", "_b") for i in range(32)]
    return out.select(*keys, F.array(*lanes, F.col("_n") % MOD).alias("vec"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane by lane a + b, or a - b for sign -1, modulo 2^30: the vector of both parts, or of a without b."""
    if sign > 0:
        return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(FIELDS)))
    borrow = F.lit(ONES << BITS)  # a bit above each lane pays what subtraction borrows
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(borrow) - y).bitwiseAND(F.lit(FIELDS)))


def shown(vec: Column) -> Column:
    """The vector as text: 4 hex digits a lane, 8 for the number of paragraphs, all modulo 2^14."""
    packed = lambda w: F.shiftright(w, 16).bitwiseAND(F.lit((SHOWN - 1) << 16)).bitwiseOR(w.bitwiseAND(F.lit(SHOWN - 1)))
    return F.array_join(F.transform(vec, lambda w: F.lpad(F.lower(F.hex(packed(w))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """How alike two multisets are, from their vectors alone: 1 - |A-B|^2 / (|A|^2 + |B|^2), at least 0.

    With lanes 2c - n (a paragraph counts as plus or minus one) squared length estimates the sum of squared
    counts, so this is near the share of common paragraphs for texts without repeats. Equal vectors: 1; one of
    them empty: 0. Right for up to 2^27 paragraphs each, then the squares leave a long.
    """

    def signed(v: Column) -> Column:  # modulo 2^30, as -2^29 .. 2^29 - 1
        return (v + MOD // 2).bitwiseAND(F.lit(MOD - 1)) - MOD // 2

    def square(*vecs: Column) -> Column:
        n = F.element_at(vecs[0], PAIRS + 1) if len(vecs) == 1 else F.element_at(vecs[0], PAIRS + 1) - F.element_at(vecs[1], PAIRS + 1)

        def both(x: Column, at: int) -> Column:
            lane = 2 * F.shiftright(x, at).bitwiseAND(F.lit(MOD - 1))
            return lane

        def one(x: Column) -> Column:
            lo, hi = signed(both(x, 0) - n), signed(both(x, 32) - n)
            return lo * lo + hi * hi

        def two(x: Column, y: Column) -> Column:
            lo, hi = signed(both(x, 0) - both(y, 0) - n), signed(both(x, 32) - both(y, 32) - n)
            return lo * lo + hi * hi

        cells = [F.slice(v, 1, PAIRS) for v in vecs]
        each = F.transform(cells[0], one) if len(vecs) == 1 else F.zip_with(cells[0], cells[1], two)
        return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)

    apart, whole = square(a, b), square(a) + square(b)
    return F.when(a == b, 1.0).when(whole == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart.cast("double") / whole.cast("double")))


def ranges(docs: DataFrame) -> tuple[list[int], dict[int | None, int]]:
    """Bounds of ranges of doc_id with like numbers of rows, from a sketch of bounded size, and the ids (null too)
    whose rows fill several ranges by themselves, with how many. The number of ranges follows the shuffle
    partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = 2
    while n < min(2 * parts, MAX_RANGES):
        n *= 2
    found, rows, none = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    many: dict[int | None, int] = {}
    for b in found or []:
        many[b] = many.get(b, 0) + 1
    heavy = {b: k for b, k in many.items() if k > 1}
    if none * n > rows:
        heavy[None] = -(-none * n // rows)
    return sorted(many), heavy


def range_of(ident: Column, tie: Column, bounds: list[int], heavy: dict[int | None, int]) -> Column:
    """The range of a row, smaller for larger ids, null last: ids by bisection of the bounds, rows of an id that
    fills several ranges by tie, smaller ones first."""
    step, steps = 1, []
    while step * 2 <= len(bounds):
        step *= 2
    while step and bounds:
        steps.append(step)
        step //= 2
    below = F.lit(0)
    if bounds:
        table = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
        below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) < ident, F.lit(False)), at + s).otherwise(at))
    times = F.lit(1)
    if ids := [b for b in heavy if b is not None]:
        known = F.create_map(*[F.lit(x) for b in ids for x in (int(b), heavy[b])])
        times = F.coalesce(F.try_element_at(known, ident), F.lit(0))  # 0: behind the id that shares the range
    times = F.when(ident.isNull(), F.lit(heavy.get(None, 1))).otherwise(times)
    share = F.floor((F.shiftright(tie, 44) + (1 << 19)) * times / F.lit(float(1 << 20))).cast("long")
    part = F.when(times == 0, F.lit(MAX_RANGES)).otherwise(share)
    return (F.when(ident.isNull(), len(bounds) + 1).otherwise(len(bounds) - below)).cast("long") * (2 * MAX_RANGES) + part


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text (of the next document, descending doc_id; after the last the first) for every
    row of docs, with _range and _place, which name the row.

    Equal ids go by a hash of the text; null ids come last. Rows are dealt by ranges of doc_id (an id that very
    many rows have by ranges of the hash) and looked at within a range; the first row of the range that follows is
    added to each range's end, so no task sorts all rows. The rows added, and the table broadcast for them, are at
    most as many as ranges.
    """
    bounds, heavy = ranges(docs)
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text", tie.alias("_tie"), range_of(F.col("doc_id"), tie, bounds, heavy).alias("_range"))
    first = rows.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), F.col("_tie").alias("tie"))).alias("f"))
    before, every = Window.orderBy("_range"), Window.partitionBy()  # one row for each range
    # The first row of a range ends the range before it, and that of the first one the last.
    first = first.select(F.bitwise_not("f.id").alias("top"), F.col("f.tie").alias("tie"), F.coalesce(F.lag("_range").over(before), F.max("_range").over(every)).alias("_to"))
    heads = docs.select("doc_id", "text").join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("top")) & (F.xxhash64("text") == F.col("tie")))
    heads = heads.groupBy("_to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.col("_to").alias("_range"))
    both = rows.withColumn("_added", F.lit(0)).unionByName(heads.withColumn("_added", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_added", F.col("doc_id").desc_nulls_last(), "_tie")
    out = both.select("doc_id", "text", "_range", "_added", F.row_number().over(order).alias("_place"), F.lead("text").over(order).alias("next_text"))
    return out.filter("_added = 0").drop("_added")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document. Null texts count as empty (n_chars 0, all lanes 0); a table of one row is its own next; an
    empty table gives an empty result; rows with equal ids keep a fixed order, and any number of rows may have one
    id or none; texts may be of any length; other columns are left alone, whatever their names.

    Texts are shuffled once, by range; all sums that follow have the range in their keys, so they need no
    exchange of their own.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("_range", "_place", "doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    keys = ["_range", "_place", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, F.posexplode(F.array("text", "edited", "next_text")).alias("_kind", "_text"))
    vecs = vectors(rows, [*keys, "_kind"], "_text")
    pick = [F.max(F.when(F.col("_kind") == k, F.col("vec"))).alias(name) for k, name in enumerate(("own", "edit", "next"))]
    out = vecs.groupBy(*keys).agg(*pick)
    return out.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last) as o from documents),
n as (select doc_id, o, text, coalesce(lead(text) over (order by o), first_value(text) over (order by o)) as nx from d),
e as (select *, length(text) as n, substr(text, 1, length(text) - length(text) // 2) || substr(nx, 1, length(text) // 2) as ed from n),
t as (select o, 0 as kind, text as t from e union all select o, 1, ed from e),
u as (select o, kind, unnest(regexp_extract_all(t, '[^.!?\n]*[.!?\n][.!? \t\r\n]*|[^.!?\n]+')) as p from t),
h as (select o, kind, md5(p) as h from u),
b as (
  select o, kind, l, count(*) as n,
    sum((('0x' || substr(h, (l // 64) * 16 + 16 - (l % 64) // 4, 1))::int >> ((l % 64) % 4)::int) & 1) as c
  from h, range(128) r(l) group by o, kind, l),
k as (
  select o, kind, string_agg(printf('%04x', (c % 16384)::int), '' order by l // 64, l % 32, l % 64 // 32 desc) as lanes, max(n) as n,
    list((2 * c - n)::bigint order by l) as v
  from b group by o, kind),
f as (select e.o, e.doc_id, e.n, e.ed, coalesce(a.lanes, repeat('0', 512)) || printf('%08x', coalesce(a.n, 0) % 16384) as fa, a.v as va,
    coalesce(c.lanes, repeat('0', 512)) || printf('%08x', coalesce(c.n, 0) % 16384) as fc, c.v as vc
  from e left join k a on a.o = e.o and a.kind = 0 left join k c on c.o = e.o and c.kind = 1),
g as (select *, coalesce(lead(fa) over w, first_value(fa) over w) as fn, case when lead(o) over w is null then first_value(va) over w else lead(va) over w end as vn from f window w as (order by o)),
z as (select *, coalesce(va, list_transform(range(128), lambda i: 0::bigint)) as a, coalesce(vc, list_transform(range(128), lambda i: 0::bigint)) as c, coalesce(vn, list_transform(range(128), lambda i: 0::bigint)) as x from g),
y as (
  select *, list_sum(list_transform(a, lambda q: q * q)) as aa, list_sum(list_transform(c, lambda q: q * q)) as cc, list_sum(list_transform(x, lambda q: q * q)) as xx,
    list_sum(list_transform(list_zip(a, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as ac, list_sum(list_transform(list_zip(a, x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as ax
  from z)
select doc_id, n::bigint as n_chars, sha256(ed) as edited_sha256, fa as fingerprint, fc as edited_fingerprint,
  case when fa = fc then 1.0 when aa + cc = 0 then 0.0 else greatest(0.0, 1.0 - ac::double / (aa + cc)::double) end::double as near_edited,
  case when fa = fn then 1.0 when aa + xx = 0 then 0.0 else greatest(0.0, 1.0 - ax::double / (aa + xx)::double) end::double as near_next
from y
"""
