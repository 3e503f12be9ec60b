"""Results that arrive while experiments run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is appended exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def progress(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Finished runs a window of event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("runs"))
