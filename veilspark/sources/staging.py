"""Cuts in long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_plan(df: DataFrame) -> DataFrame:
    """df, computed and read back from the session's checkpoint folder (a local one only for a local master that sets none), so that
    what follows is planned afresh and survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilspark-"))
    return df.checkpoint()
