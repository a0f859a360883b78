"""Tables written to the folder that every executor and the driver share, and the size of Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes and rows of an Arrow batch at most: whole texts are of any length, so rows alone say nothing about memory.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session on one machine that has none gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/quarry"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, but for limits that the user has set."""
    own = spark.conf.getAll
    for name, most in BATCH.items():
        if name not in own:
            spark.conf.set(name, str(most))


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in a folder for each value of ``by``, and read it back.

    The lineage ends there: a lost executor costs a re-read of its files, not a
    second computation, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/quarry/{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
