"""Materialise small intermediate results where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary one; on a cluster a missing
    setting is an error, since an executor's own disk can be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, bounded: bool = True) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a table written to the shared folder
    and read back. Results bounded by the schema end in one file, others in a file a task."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    (df.repartition(1) if bounded else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
