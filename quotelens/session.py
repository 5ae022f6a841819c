"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The feature row is wider than the default limit of 100 generated fields.
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quotelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="quotelens-")
    return f"{base.rstrip('/')}/quotelens-{uuid.uuid4().hex}"


def materialise(frame: DataFrame) -> DataFrame:
    """Write a reused frame once as parquet and read it back.

    Like a checkpoint it cuts the lineage and survives lost executors; unlike one it stays
    columnar, so later scans read only the columns they need.
    """
    path = f"{scratch_folder(frame.sparkSession)}/table"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
