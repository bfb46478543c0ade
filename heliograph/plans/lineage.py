"""Cutting long lineages in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder that `spark.checkpoint.dir` names (shared by all executors);
    only where a session has none, as in tests, a temporary one is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="heliograph-"))
    return df.checkpoint()
