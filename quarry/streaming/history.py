"""Incremental activity of directories as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.history import directory


def stream_dir_activity(changes: DataFrame, window: str = "30 days", late: str = "7 days") -> DataFrame:
    """Changes of each directory and window of a stream (repo_id, path, at); rows later than ``late`` are left out."""
    rows = changes.withWatermark("at", late).select("repo_id", directory("path").alias("dir"), "at").where("dir <> ''")
    return rows.groupBy("repo_id", "dir", F.window("at", window).alias("w")).agg(F.count("*").alias("n")).select("repo_id", "dir", F.col("w.start").alias("since"), "n")
