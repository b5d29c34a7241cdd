"""Tables that several jobs of one operator read, kept where all executors can reach them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a local one serves a local master
    alone; a cluster without one is an error, since its executors could not read what the driver names."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilspark-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, written now and read back. Its folder goes when its scratch() ends, else
    when the driver's JVM does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within are deleted at the end, but for those whose folders are taken off the list."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def written_alone(make, spark: SparkSession, name: str) -> DataFrame:
    """make() as a written table; the tables that make() itself wrote are deleted then."""
    with scratch(spark) as mine:
        out = written(make(), name)
        kept = mine.pop()
    if _SCOPES:
        _SCOPES[-1].append(kept)
    return out


def fresh(columns: list[str], name: str) -> str:
    """name, or with underscores before it what no column (in any case) is called."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
