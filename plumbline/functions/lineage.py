"""Cutting a table's lineage where a loop would let it grow."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` by ``checkpoint()`` in the folder that the session names in ``spark.checkpoint.dir``.

    Where none is set a local session gets a temporary folder that goes at exit; on a cluster this
    is an error, since a machine's own folder is lost with it.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
