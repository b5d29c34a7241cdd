"""Steps whose cost must grow no faster than their input."""

import random
import time

import __spark_entry__
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.text import scan
from veilspark.operators import audit, chunks, detect, filters, nested, spans, training
from veilspark.sources import notes as N

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_are_made_where_they_are_read(spark):
    made = plan(N.notes_with_spans(spark, SF))
    assert "ExistingRDD" not in made and "aggregate(" not in made
    row = N.notes_with_spans(spark, SF).first()
    assert len(row["spans"]) == 13 and all(row["text"][s["start"] : s["end"]] == s["text"] for s in row["spans"])


def test_tagging_runs_once_a_note(spark):
    for name in ("spans_to_bilou", "class_weights", "bilou_decode", "spans_to_bilou_tokens"):
        made = plan(__spark_entry__.queries()[name](spark, SF))
        assert made.split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1, name


def test_tags_of_shared_tokens_and_odd_rows(spark):
    rows = [(0, "Mr. Xy-Z é😀 end", [(0, 2, "A"), (4, 8, "B"), (7, 8, "C"), (9, 11, None)]), (1, None, [(0, 1, "A")]), (2, "a b", None), (3, "", []), (4, "q r", [(None, 1, "A"), (2, 3, "A")])]
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int,type:string>>")
    got = {r["i"]: r["t"] and [(x["s"], x["e"], x["label"]) for x in r["t"]] for r in df.select("i", training.tagged(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[0] == [(0, 2, "U-A"), (2, 3, "O"), (4, 6, "B-B"), (6, 7, "I-B"), (7, 8, "U-C"), (9, 10, None), (10, 11, None), (12, 15, "O")]
    assert got[1] is None and got[3] == [] and got[2] == [(0, 1, "O"), (2, 3, "O")] and got[4] == [(0, 1, "O"), (2, 3, "U-A")]


def test_chunks_are_cut_in_one_pass(spark):
    text = " ".join(f"word{i}. Next" for i in range(3000))
    df = chunks.chunk(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string"), 400, 300, 40)
    assert "aggregate(" not in plan(df) and "ArrowEvalPython" in plan(df)
    rows = sorted(df.collect(), key=lambda r: (r["doc_id"], r["chunk_id"]))
    long = [r for r in rows if r["doc_id"] == 1]
    assert long[0]["start_char"] == 0 and long[-1]["end_char"] == len(text) and all(text[r["start_char"] : r["end_char"]] == r["text"] for r in long)
    assert all(a["end_char"] > b["start_char"] for a, b in zip(long, long[1:]))
    assert [tuple(r)[1:] for r in rows if r["doc_id"] > 1] == [(0, "short", 0, 5), (0, None, 0, None)]


def test_very_many_spans_of_chunks_are_compared_with_neighbours_alone(spark):
    many = [(i * 10 + d, i * 10 + 8, "A") for i in range(4000) for d in (0, 1)]
    df = spark.createDataFrame([(many,)], "s array<struct<start:int,end:int,type:string>>")
    got = df.select(spans.dedupe_overlaps(F.col("s")).alias("o")).first()["o"]
    assert [tuple(x) for x in got] == [(i * 10, i * 10 + 8, "A") for i in range(4000)]


def test_veto_queries_read_their_notes_once_and_join_no_spans(spark):
    for name in ("veto_differences", "safe_veto", "veto_by_type"):
        made = plan(__spark_entry__.queries()[name](spark, SF)).split("== Initial Plan ==")[-1]
        assert made.count("orders.parquet") == 1 and made.count("Join") == 1, name  # the join of orders and customers


def test_veto_of_spans_in_rows_equals_that_of_tables(spark):
    rows = [(1, "BP\t1951\nRM01 at 0930", [(4, 6, "A", "95"), (3, 7, "A", "1951"), (8, 12, "B", "RM01"), (8, 12, "B", "RM01"), (None, 3, "B", "x")]), (2, None, [(0, 1, "B", "y")]), (3, "RM02", None), (4, "RM02", []), (None, "RM03", [(0, 4, "A", "RM03")])]
    notes = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int,type:string,text:string>>")
    table = notes.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    for make in (filters.veto_safe, audit.veto_by_type):
        a, b = make(None, notes), make(table, notes.drop("spans"))
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_differences_of_repeated_and_null_rows(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "`a.b` int, s string")
    many = spark.range(100_000).select(F.lit(7).alias("a.b"), F.lit("many").alias("s"))
    expected, actual = df((1, None), (1, None), (2, "x"), (None, "n")).union(many), df((1, None), (3, "y"), (None, "n"), (2, "x"), (2, "x"))
    made = audit.set_differences(expected, actual)
    assert plan(made).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    got = {tuple(r[:3]): r[3] for r in made.groupBy("`a.b`", "s", "side").count().collect()}
    assert got == {(1, None, "missing"): 1, (3, "y", "unexpected"): 1, (2, "x", "unexpected"): 1, (7, "many", "missing"): 100_000}


def test_a_scan_fails_at_the_first_character(spark):
    for name in "PHONE SSN STATE_ZIP DATE ROOM CLOCK BP TITLE GAZETTEER ZIP_PLUS4 ZIP_STATE ZIP_SHORT ZIP_GLUED".split():
        assert getattr(P, name).startswith("(?="), name
    df = spark.createDataFrame([("a\x02 12 \x02\x023",), ("\x02",), ("12",), ("",), (None,), ("é12😀3",)], "t string")
    got = [r["m"] and [tuple(x) for x in r["m"]] if r["m"] is not None else None for r in df.select(scan(F.col("t"), r"\d+").alias("m")).collect()]
    assert got == [[(3, 5, "12"), (8, 9, "3")], [], [(0, 2, "12")], [], None, [(1, 3, "12"), (4, 5, "3")]]
    assert "split(" in plan(df.select(scan(F.col("t"), r"\d+"))) and "\x02" in plan(df.select(scan(F.col("t"), r"\d+")))


def test_recognized_spans_apart_are_not_compared_in_pairs(spark):
    n = 20_000
    df = spark.createDataFrame([("a 405-555-0123 b\n" * n,), ("1530 RM01 a 11/13/2025 x@y.zz OK 74104",)], "t string").select(detect.recognized(F.col("t")).alias("s"))
    began = time.time()
    long, short = [r["s"] for r in df.collect()]
    assert time.time() - began < 20 and len(long) == n and (long[-1]["start"], long[-1]["end"]) == (17 * n - 15, 17 * n - 3)
    assert [(s["type"], s["text"]) for s in short] == [("POSTCODE", "74104"), ("EMAIL", "x@y.zz"), ("DATE", "11/13/2025")]


def test_short_name_lists_are_looked_for_alone(spark):
    text = "Ann Garcia and Gap in a gap; Mr Smith. Smith Garciaz XGarcia Kowalczyk"
    df = spark.createDataFrame([(text,)], "t string")
    few = nested.by_gazetteer(F.col("t"), ["Garcia", "GAP", "smith", "O'Neil"])
    many = nested.by_gazetteer(F.col("t"), ["Garcia", "GAP", "smith", "O'Neil", *[f"Zz{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]])
    a, b = df.select(few.alias("x"), many.alias("y")).first()
    assert a == b and [s["text"] for s in a] == ["Garcia", "Smith"]
    assert P.LOWER_WORD not in plan(df.select(few)) and P.LOWER_WORD in plan(df.select(many))


def test_lines_without_a_hint_of_a_zip_are_left_alone(spark):
    random.seed(1)
    some = ["".join(random.choice(["1", "12345", "-", " ", "OK", "a", "1234", "12", "\t"]) for _ in range(9)) for _ in range(20_000)]
    hits = spark.createDataFrame([(t,) for t in some], "t string")
    any_of = F.col("t").rlike("|".join((P.ZIP_PLUS4, P.ZIP_STATE, P.ZIP_SHORT, P.ZIP_GLUED)))
    assert hits.filter(any_of).count() > 300 and hits.filter(any_of & ~F.col("t").rlike(P.ZIP_HINT)).count() == 0
    assert P.ZIP_HINT in plan(__spark_entry__.queries()["zip_backstop"](spark, SF))
