"""Readers and writers round trip, and streams equal batches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilspark.operators import detect
from veilspark.plans import pipeline
from veilspark.sources import tables
from veilspark.streaming import notes as streams

NOTES = [(1, "Dr. Mccoy saw John.\nSSN 234-11-1001"), (2, "at 0610 in RM05, call (405) 555-1234"), (3, "")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo \xff")
    rows = tables.text_files(spark, str(tmp_path)).collect()
    assert [r["text"] for r in rows] == ["one\ntwo \ufffd"] and rows[0]["path"].endswith("a.txt")


def test_json_lines_keep_broken_ones(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "text": "a"}\n{broken\n')
    rows = tables.json_lines(spark, str(tmp_path), "id long, text string").collect()
    assert sorted((r["id"] or 0, r["text"], r["_corrupt"]) for r in rows) == [(0, None, "{broken"), (1, "a", None)]


def test_gold_records_read_both_literals(spark, tmp_path):
    spans = [{"start": 0, "end": 3, "label": "ssn", "text": "o'k"}]
    lines = [{"uid": "a", "text": "x", "spans": json.dumps(spans)}, {"uid": "b", "text": "x", "spans": "[{'start': 0, 'end': 3, 'label': 'ssn', 'text': None}]"}, {"uid": "c", "text": "x", "spans": "no list"}]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r["uid"]: [tuple(s) for s in r["spans"]] for r in tables.gold_records(spark, str(tmp_path)).collect()}
    assert got == {"a": [(0, 3, "ssn", "o'k")], "b": [(0, 3, "ssn", None)], "c": []}


def test_relabelled_csv_and_pilot_log(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text("record_id,begin,length,type\n12||||34||||,5,3,NAME\nbad,1,1,AGE\n")
    rows = [tuple(r) for r in tables.relabelled(spark, str(tmp_path / "r")).orderBy("start").collect()]
    assert rows == [(None, None, 1, 2, "AGE"), (12, 34, 5, 8, "NAME")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"study_id": "s1", "offsets": [["0", "4", "DATE"], ["x", "9", "NAME"]]}\n')
    assert sorted(map(tuple, tables.pilot_log(spark, str(tmp_path / "p")).collect()), key=str) == [("s1", 0, 4, "DATE"), ("s1", None, 9, "NAME")]


def test_corpus_files_round_trip(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, "doc_id long, text string")
    tables.write_texts(notes, f"{tmp_path}/c")
    assert sorted(r["text"] for r in tables.read_texts(spark, f"{tmp_path}/c").collect()) == sorted(t for _, t in NOTES)
    tables.write_json_lines(notes, f"{tmp_path}/j")
    assert sorted((r["doc_id"], r["text"]) for r in tables.json_lines(spark, f"{tmp_path}/j", "doc_id long, text string").collect()) == NOTES


def test_checkpoint_keeps_figures_and_weights(spark, tmp_path):
    tables.write_checkpoint(spark.createDataFrame([(3, 0.5)], "epoch int, f1 double"), spark.createDataFrame([("O", 0.1)], "label string, weight double"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m/metrics").first()["epoch"] == 3 and spark.read.parquet(f"{tmp_path}/m/weights").count() == 1


def test_streams_equal_batches(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, "doc_id long, text string")
    notes.write.json(f"{tmp_path}/in")
    live = lambda: spark.readStream.schema("doc_id long, text string").json(f"{tmp_path}/in")
    rows = streams.pattern_stream(live()).writeStream.format("memory").queryName("patterned").trigger(availableNow=True).start()
    rows.awaitTermination()
    assert sorted(map(tuple, spark.table("patterned").collect())) == sorted(map(tuple, streams.pattern_stream(notes).collect()))
    seen = []
    query = streams.full_stream(live(), lambda batch, n: seen.extend((r["doc_id"], r["text"]) for r in batch.collect()), f"{tmp_path}/state")
    query.awaitTermination()
    assert sorted(seen) == sorted((r["doc_id"], r["text"]) for r in pipeline.deidentify(notes).collect())


def test_a_model_reads_overlapping_chunks(spark):
    class Words:
        def __call__(self, texts):
            return [[(t.index("needle"), t.index("needle") + 6, "NAME", 0.9)] if "needle" in t else [] for t in texts]

    text = " ".join(["hay"] * 55 + ["needle"] + ["hay"] * 60)
    notes = spark.createDataFrame([(1, text), (None, "a needle"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["start"], r["end"], r["type"], r["text"]) for r in detect.by_detector(notes, Words, 40, 30, 10).collect())
    assert got == [(0, 2, 8, "NAME", "needle"), (1, text.index("needle"), text.index("needle") + 6, "NAME", "needle")]
    assert detect.by_detector(notes.filter(F.lit(False)), Words).count() == 0
