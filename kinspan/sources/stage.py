"""Tables written once where several steps read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the folder in spark.checkpoint.dir, which driver and executors share.

    A lost executor then costs no more than its tasks. Unset, the folder is a local one if Spark is local too, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinspan-"))
    return df.checkpoint()
