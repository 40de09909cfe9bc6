"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from colloquy.session import cut_lineage


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that ``spark.checkpoint.dir`` names."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))  # sets the folder, as every checkpoint of this library does
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def fresh_name(columns: list[str], name: str) -> str:
    """``name``, or with as many underscores after it as make it none of
    ``columns``, which Spark compares without regard to case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
