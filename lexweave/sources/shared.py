"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(table: DataFrame) -> DataFrame:
    """Writes table to the folder that spark.checkpoint.dir names and reads it back; where none is set, to a
    temporary one of this machine if the master is local, as in tests."""
    spark = table.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lexweave-")
    path = f"{folder.rstrip('/')}/shared-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
