"""Clinical notes made from orders and customers, with the places of all that must be hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .tables import table

FIRST = ["MARY", "John", "Linda", "Robert", "Susan", "James"]
LAST = ["Walker", "Kowalczyk", "Smith", "Garcia", "Nguyen"]
DOCTORS = ["Mccoy", "Tracy", "Hamilton"]


def _choice(n: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def segments() -> list[tuple[str, Column]]:
    """Label (O: none) and text of each part of a note, in order; o is the order, c the customer."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    text = lambda s: F.lit(s)
    s = lambda x: x.cast("string")
    pad = lambda x, n: F.lpad(s(x), n, "0")
    first = _choice(c, FIRST)
    born = F.date_add(F.lit("1930-01-01").cast("date"), ((c * 37) % 25000).cast("int"))
    return [
        ("O", text("PROGRESS NOTE\nPatient: ")),
        ("FIRST_NAME", first),
        ("O", text(" ")),
        ("LAST_NAME", _choice(c, LAST)),
        ("O", text("\nDOB: ")),
        ("DATE_OF_BIRTH", F.date_format(born, "MM/dd/yyyy")),
        ("O", text("\nMRN: ")),
        ("MEDICAL_RECORD_NUMBER", pad(o, 8)),
        ("O", text("\nDate of Service: ")),
        ("DATE", F.date_format("o_orderdate", "MM/dd/yyyy")),
        ("O", text("\nAddr: ")),
        ("STREET_ADDRESS", F.concat(s(100 + c % 900), F.lit(" MAPLE ST"))),
        ("O", text(" / TULSA OK ")),
        ("POSTCODE", F.concat(s(73000 + c % 999), F.when(c % 3 != 0, F.concat(F.lit("-"), pad(o % 10000, 4))).otherwise(""))),
        ("O", text("\nPhone: ")),
        ("PHONE_NUMBER", F.concat(F.lit("(405) 555-"), pad(c % 10000, 4))),
        ("O", text("\nEmail: ")),
        ("EMAIL", F.concat(F.lower(first), F.lit("."), s(c), F.lit("@example.com"))),
        ("O", text("\nSSN: ")),
        ("SSN", F.concat(s(100 + c % 800), F.lit("-"), s(10 + o % 90), F.lit("-"), s(1000 + o % 9000))),
        ("O", F.concat(F.lit("\nARRIVE\t"), pad(o % 24, 2), pad(o % 60, 2), F.lit("\nLocation: RM0"), s(o % 10), F.lit("\n"), F.when(c % 2 == 0, "She is a ").otherwise("He is a "))),
        ("AGE", s(20 + c % 80)),
        ("O", F.when(c % 2 == 0, " year old female. Seen by Dr. ").otherwise(" year old male. Seen by Dr. ")),
        ("LAST_NAME", _choice(o, DOCTORS)),
        ("O", text("\nHx\tAppendectomy\t")),
        ("DATE", s(1950 + o % 70)),
        ("O", text("\nAnion Gap 12. Started clozapine 100mg.")),
    ]


def _slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What notes are made of, dealt by order: the one join, on the customer, and the one exchange, of a few bytes a row."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = orders.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", "c_custkey", "o_orderdate").repartition(parts, "o_orderkey")


def notes_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, spans: array<struct<start,end,type,text>>.

    Made anew wherever they are read, by compiled code: a part starts after the lengths of all before it. let() keeps
    each step out of whole-stage code: that would be one method too long for the JVM to compile. Rows go through
    inline(), which the optimizer does not reach across, so that what follows starts from columns, as over a table of
    notes, and does not repeat the expressions that build a note.
    """
    made = segments()
    apart = lambda value: let(value, lambda v: v)
    x = [F.col(f"x{i}") for i in range(len(made))]
    rows = _slim(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), *[(apart(part) if i == 1 else part).alias(f"x{i}") for i, (_, part) in enumerate(made)])
    rows = rows.select("doc_id", *x, *[(apart(F.length(part)) if i == 1 else F.length(part)).alias(f"n{i}") for i, part in enumerate(x)])
    at, spans = F.lit(0), []
    for i, (label, _) in enumerate(made):
        end = at + F.col(f"n{i}")
        if label != "O":
            spans.append(F.struct(at.alias("start"), end.alias("end"), F.lit(label).alias("type"), x[i].alias("text")))
        at = end
    rows = rows.select("doc_id", apart(F.concat_ws("", *x)).alias("text"), F.array(*spans).alias("spans"))
    return rows.select("doc_id", F.inline(F.array(F.struct("text", "spans"))))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    return notes_with_spans(spark, sf_dir).select("doc_id", "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, end, type, text of every span."""
    return notes_with_spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
