"""Table-driven cases of the span passes, filters, dates and sweeps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.functions import dates, draw
from veilspark.functions.text import scan, titled
from veilspark.operators import detect, filters, people, rewrite, spans
from veilspark.plans import pipeline

SPAN = "doc_id long, start int, end int, type string, text string"


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def marked(spark, cases):
    """cases: (text, [(part, type)]) to notes and spans, each part at its first place."""
    rows = [(i, t.index(p), t.index(p) + len(p), kind, p) for i, (t, parts) in enumerate(cases) for p, kind in parts]
    return notes(spark, *[t for t, _ in cases]), spark.createDataFrame(rows, SPAN)


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_scan_finds_offsets(spark):
    got = column(spark, ["é😀 12 a 345", "", "7", "none"], lambda c: scan(c, r"\d+"))
    assert [[(m["start"], m["end"], m["text"]) for m in x] for x in got] == [[(3, 5, "12"), (8, 11, "345")], [], [(0, 1, "7")], []]


def test_title_case(spark):
    assert column(spark, ["o'neil mc-donald", "élan"], titled) == ["O'Neil Mc-Donald", "Élan"]


@pytest.mark.parametrize("text", ["11/13/2025", "11/13/25", "November 5, 2024", "2024-03-15", "1957", "2017"])
def test_dates_keep_their_format(spark, text):
    (out,) = column(spark, [text], lambda c: dates.shift_date(c, F.lit(-100)))
    assert out != text or len(text) == 4
    assert abs(len(out) - len(text)) <= 2 or text[0].isalpha()  # months differ in length
    assert [c for c in out if not c.isalnum()] == [c for c in text if not c.isalnum()]


def test_two_digit_years_pivot(spark):
    assert column(spark, ["01/10/70", "01/10/20"], lambda c: dates.shift_whole(c, F.lit(-9))) == ["01/01/70", "01/01/20"]


def test_fragment_is_disguised(spark):
    assert column(spark, ["10", "22x"], lambda c: dates.shift_date(c, F.lit(-33))) == ["87", "99x"]


def test_age_cap(spark):
    assert column(spark, ["88", "89", "aged 101 of 3", "n/a"], dates.cap_age) == ["88", "90+", "aged 90+ of 3", "n/a"]


def test_safe_spans_are_vetoed(spark):
    cases = [("ARRIVE\t0610", [("10", "DATE")]), ("seen at 0322 val", [("22", "DATE")]), ("in RM05 now", [("RM05", "POSTCODE")]), ("Hx\t1951\tx", [("1951", "DATE")]), ("born 1951 there", [("51", "DATE")])]
    n, s = marked(spark, cases)
    assert texts(filters.veto_safe(s, n)) == [(3, "1951"), (4, "51")]


def test_fragments_take_the_word(spark):
    cases = [("Mr Kowalczyk came", [("alczyk", "LAST_NAME")]), ("gave cefepime", [("ime", "LAST_NAME")]), ("JohnSmith", [("John", "FIRST_NAME"), ("Smith", "LAST_NAME")]), ("A. Grant", [("Grant", "LAST_NAME")])]
    n, s = marked(spark, cases)
    got = sorted((r["doc_id"], r["text"], r["type"]) for r in spans.repair_fragments(s, n).collect())
    assert got == [(0, "Kowalczyk", "LAST_NAME"), (2, "JohnSmith", "NAME"), (3, "Grant", "LAST_NAME")]


def test_identifiers_are_repaired(spark):
    kind = "MEDICAL_RECORD_NUMBER"
    cases = [("MCHC 12", [("M", kind)]), ("74804-9625", [("25", kind)]), ("zip 73084 x", [("7", kind)]), ("id 12345678", [("78", kind)]), ("9 Oakland Rd", [("9 Oak", "STREET_ADDRESS")]), ("MRN 555", [("555", kind)])]
    n, s = marked(spark, cases)
    assert texts(spans.repair_identifiers(s, n)) == [(2, "73084"), (4, "9 Oakland"), (5, "555")]


def test_identifiers_are_trimmed(spark):
    n, s = marked(spark, [("x: 12594309", [(": 12594309", "SSN")]), ("%%%", [("%%%", "SSN")])])
    assert texts(spans.trim_identifiers(s)) == [(0, "12594309")]


def test_dates_are_trimmed(spark):
    n, s = marked(spark, [("11/13/2025\nCre", [("11/13/2025\nCre", "DATE")]), ("Saturday", [("Saturday", "DATE")]), ("08/14/2025 5:54", [("08/14/2025 5:54", "DATE_TIME")])])
    assert texts(spans.trim_dates(s)) == [(0, "11/13/2025"), (2, "08/14/2025 5:54")]


def test_recall_stays_on_the_line(spark):
    n = notes(spark, "Dr. Mccoy\nBradycardia\nPresent", "Dr. Mary Ann Walker", "Robert Johnson, MD", "Dr. Propranolol")
    assert texts(detect.by_title(n)) == [(0, "Mccoy"), (1, "Ann"), (1, "Mary"), (1, "Walker")]
    assert texts(detect.by_credential(n)) == [(2, "Johnson"), (2, "Robert")]


def test_bilou_invalid_last_opens(spark):
    tags = [(0, 2, "L-X"), (3, 5, "I-X"), (6, 8, "O"), (9, 10, "U-Y")]
    df = spark.createDataFrame([(tags,)], "t array<struct<s:int,e:int,label:string>>")
    got = df.select(detect.decode_bilou(F.col("t")).alias("o")).first()["o"]
    assert [tuple(x) for x in got] == [("X", 0, 5), ("Y", 9, 10)]


def test_names_are_unique_and_foreign(spark):
    rows = [(0, "last", t) for t in ("able", "baker", "cody", "dunn")]
    tokens = spark.createDataFrame(rows, "doc_id long, kind string, token string")
    got = [r["surrogate"] for r in people.unique_names(tokens, last_pool=["Able", "Moss", "Reed"]).collect()]
    assert len(set(got)) == 4 and not {g.lower() for g in got} & {r[2] for r in rows}


def test_zip_backstop(spark):
    none = F.array(F.lit("11111-2222")).cast("array<string>")
    out = column(spark, ["zip 74804-9625", "TULSA OK 74104", "kept 11111-2222", "lab 12345 ok"], lambda c: rewrite.zip_backstop(c, draw.key(0, F.lit(1), "place"), none))
    assert "74804" not in out[0] and "74104" not in out[1]
    assert out[2:] == ["kept 11111-2222", "lab 12345 ok"]


def test_birth_line(spark):
    assert column(spark, ["DOB: 01/02/1960 and more\nnext"], rewrite.clean_births) == ["DOB: 01/02/1960\nnext"]


def test_nothing_of_a_note_leaks(spark):
    text = "Patient: John Kowalczyk\nSSN: 234-11-1001\nSeen by Dr. Tracy, TULSA OK 74104-1234. john is well."
    n, s = marked(spark, [(text, [("John", "FIRST_NAME"), ("Kowalczyk", "LAST_NAME"), ("234-11-1001", "SSN")])])
    out = pipeline.deidentify(n, s).first()["text"]
    for gone in ("Kowalczyk", "John", "234-11-1001", "Tracy", "74104"):
        assert gone not in out
    assert out.startswith("Patient: ") and "\nSSN: " in out


def test_surnames_that_are_medical_terms_go(spark):
    names = ["John Crohn", "Mary Foley", "Anna Glasgow", "Emil Parkinson"]
    n, s = marked(spark, [(f"Seen: {x} today.", [(x.split()[0], "FIRST_NAME"), (x.split()[1], "LAST_NAME")]) for x in names])
    out = dict(texts(pipeline.deidentify(n, s)))
    assert all(w not in out[i] for i, x in enumerate(names) for w in x.split())


def test_notes_without_id_and_with_one_id_are_rewritten(spark):
    rows = [(None, "SSN 234-11-1001 of John"), (7, "SSN 345-22-2002 of Mary"), (7, "ward, SSN 456-33-3003 of Susan"), (8, None)]
    n = spark.createDataFrame(rows, "doc_id long, text string")
    spans_ = [(i, t.index(p), t.index(p) + len(p), kind, p) for i, t in rows if t for p, kind in ((t[t.index("SSN") + 4 :][:11], "SSN"), (t.split()[-1], "FIRST_NAME"))]
    out = [r["text"] for r in pipeline.deidentify(n, spark.createDataFrame(spans_, SPAN)).collect()]
    whole = " ".join(t or "" for t in out)
    assert len(out) == 4 and not any(x in whole for x in ("234-11", "345-22", "456-33", "John", "Mary", "Susan"))


@pytest.mark.parametrize("text,want", [("Sept 5, 2024", "08/26/2024"), ("March 15th, 2024", "03/05/2024"), ("5th of nothing", None), ("11/13/25 5:54", "11/03/25 05:54"), ("2024-03-15T10:00:00Z", "2024-03-05T10:00:00Z"), ("Mar. 15 2024", "03/05/2024"), ("15 March, 2024", "03/05/2024")])
def test_date_forms(spark, text, want):
    (out,) = column(spark, [text], lambda c: dates.shift_datetime(c, F.lit(-10)))
    assert out == want if want else out != text


def test_no_offset_leaves_digits(spark):
    assert column(spark, ["10", "77x"], lambda c: dates.disguise(c, F.lit(-100))) == ["65", "22x"]


def test_batch_counts_by_type(spark):
    n, s = marked(spark, [("SSN 234-11-1001 of John", [("234-11-1001", "SSN"), ("John", "FIRST_NAME")]), ("nothing", [])])
    got = {r["doc_id"]: r["counts"] for r in pipeline.deidentify_batch(n, s).collect()}
    assert got == {0: {"SSN": 1, "FIRST_NAME": 1}, 1: {}}


def test_scan_of_texts_with_noncharacters(spark):
    got = column(spark, ["a\ufdd01\ufdd1 22", None], lambda c: scan(c, r"\d+"))
    assert [(m["start"], m["end"], m["text"]) for m in got[0]] == [(2, 3, "1"), (5, 7, "22")] and got[1] is None


def test_scan_of_very_many_matches(spark):
    text = " ".join(f"x{i}" for i in range(3000))
    (got,) = column(spark, [text], lambda c: scan(c, r"\d+"))
    assert [m["text"] for m in got] == [str(i) for i in range(3000)] and all(text[m["start"] : m["end"]] == m["text"] for m in got)
