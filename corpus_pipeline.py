"""The corpus pipeline: documents in, token ids of the mixed corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, language, mixing, simhash, suffix
from veilspark.llm.store import delete, scratch, written_alone


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, ambiguous ones too; those without letters, null and empty ones among them,
    go. Repeated rows stay, of any length; columns of any name stay as they are; an empty table stays empty."""
    return language.known(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id (null last), then the smallest
    fingerprint, then by a hash of the text. Rows without doc_id take part; a repeated row goes; null and empty
    texts are one component; columns of any name stay as they are; an empty table stays empty."""
    return simhash.one_of_each(docs).select(*_all(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words stay in the document with the smallest doc_id that holds them; n_chars, where
    there is one, follows. Documents of such passages alone go; rows without doc_id or text stay as they are; rows
    of one doc_id are cut each by its own text; columns of any name stay; an empty table stays empty."""
    out = suffix.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_all(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it, by its own size: not at all, once or twice. Null is
    a source of its own; rows without doc_id and repeated rows are rows like others; documents without a word are
    taken by their place in the order; columns of any name stay; an empty table stays empty."""
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and proof that they decode to its text. Null texts have no ids; texts
    may be of any length; each row of a document taken twice is encoded; other columns are left out; an empty table
    gives an empty result."""
    return bpe.standard(docs)


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]
# No SQL: language identification, SimHash links and BPE are not expressible; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read back as the next one's input. What a stage wrote for
    itself, and the result before, are deleted as soon as its own result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as mine:
        for name, stage in STAGES:
            docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name}")
            if len(mine) > 1:
                delete(spark, mine.pop(0))
        mine.clear()
    return docs
