"""Tables that several branches of a plan read: computed once, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a table, under spark.checkpoint.dir; in local mode, where that is unset, in a folder of our own."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="cloakline-"))
    return df.checkpoint(eager=True)
