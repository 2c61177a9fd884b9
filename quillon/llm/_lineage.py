"""Cut the lineage of a DataFrame through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame


def _set_folder(context) -> None:
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quillon-checkpoints-")
        context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the checkpoint folder of the cluster.

    The folder is that of spark.checkpoint.dir; only where that is unset (a local session, as in
    tests) a temporary folder is used. The files go when the returned frame is no longer referenced,
    if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    _set_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """The rows of `df`, written as a compressed table beside the checkpoints and read again.

    For wide intermediate results of which later steps read a few columns, or read twice. The table
    goes when the driver ends.
    """
    context = df.sparkSession.sparkContext
    _set_folder(context)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, context, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(context, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
