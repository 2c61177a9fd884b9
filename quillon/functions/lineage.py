"""Cut the lineage of a DataFrame through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the checkpoint folder of the cluster.

    The folder is that of spark.checkpoint.dir; only where that is unset (a local session, as in
    tests) a temporary folder is used.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quillon-checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
