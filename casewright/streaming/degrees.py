"""In-degrees over a stream of edges (an extension: the engine's own jobs are batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_indegree(edges: DataFrame) -> DataFrame:
    """(cited, n, weight), to be written in update mode; state is one row for each cited node."""
    return edges.groupBy("cited").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def windowed_cites(edges: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, cited, n) with a watermark, so that state for closed windows is dropped."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width), "cited").agg(F.count(F.lit(1)).alias("n"))
