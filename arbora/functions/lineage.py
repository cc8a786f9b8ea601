"""Results of a round written out, so that iterations don't grow their plan."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` read back from files in ``spark.checkpoint.dir``.

    A session in one JVM that names no folder gets a temporary one; a cluster
    must name one that all its machines share.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
