"""Readers of the inputs that the engine knows, and writers of its outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "uid string, domain string, document_type string, document_format string, text string, spans string"
SPAN = "array<struct<start:int,end:int,label:string,text:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One note for each file: path, text; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema; a broken line is a row of nulls with the line in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse_spans(literal: Column) -> Column:
    """Spans from JSON or from a Python literal of it (single quotes); an empty array where neither can be read."""
    read = lambda c: F.from_json(c, SPAN)
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(literal, r"(?<=[\[{,:\s])'|'(?=[\]},:])", '"'), r"\bNone\b", "null"), r"\\x", r"\\u00")
    return F.coalesce(read(literal), read(quoted), F.array().cast(SPAN))


def gold_records(spark: SparkSession, path: str) -> DataFrame:
    """Annotated notes: uid, domain, document_type, text and spans as an array."""
    return json_lines(spark, path, GOLD).withColumn("spans", parse_spans(F.col("spans")))


def relabelled(spark: SparkSession, path: str) -> DataFrame:
    """The span relabelling CSV: record ("<int>||||<int>||||") as two ids, start, end, type."""
    rows = spark.read.schema("record_id string, begin int, length int, type string").option("header", True).csv(path)
    ids = F.split("record_id", r"\|\|\|\|")
    return rows.select(F.try_element_at(ids, F.lit(1)).try_cast("int").alias("patient"), F.try_element_at(ids, F.lit(2)).try_cast("int").alias("note"), F.col("begin").alias("start"), (F.col("begin") + F.col("length")).alias("end"), "type")


def pilot_log(spark: SparkSession, path: str) -> DataFrame:
    """A de-identification log: study_id, start, end, type for each span."""
    rows = json_lines(spark, path, "study_id string, offsets array<array<string>>").select("study_id", F.explode("offsets").alias("x"))
    return rows.select("study_id", F.try_element_at("x", F.lit(1)).try_cast("int").alias("start"), F.try_element_at("x", F.lit(2)).try_cast("int").alias("end"), F.try_element_at("x", F.lit(3)).alias("type"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


RECORD_END = "\u001e"  # notes have lines of their own, so a corpus file ends each with the record separator


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """A corpus file: the texts one after the other, each ended by RECORD_END."""
    df.select(text).write.mode("overwrite").text(path, lineSep=RECORD_END)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """What write_texts wrote, as text."""
    return spark.read.text(path, lineSep=RECORD_END).withColumnRenamed("value", "text")


def write_checkpoint(metrics: DataFrame, weights: DataFrame, path: str) -> None:
    """The best epoch's figures and the class weights that it was trained with, side by side."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    weights.write.mode("overwrite").parquet(f"{path}/weights")
