"""Results that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def hold(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir, so it outlives executors.

    Without that setting a local session (as in tests) gets a temporary folder; on a cluster it is an error, as executors
    would not share one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="isohyet-"))
    return df.checkpoint()
