"""Finished runs handed on while a design is worked off, exactly once, also by a query that is killed and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from explorium.plans import models as M


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    system, p = _at(spark, path)
    return system.exists(p)


def _mark(spark: SparkSession, path: str) -> None:
    system, p = _at(spark, path)
    system.create(p, True).close()


def stream_of(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A design's Parquet files as a stream, some files a batch; files that are added later follow."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_stream(model: M.Model, design: DataFrame, path: str, checkpoint: str, consumer: Callable[[DataFrame, int], None] | None = None, forever: bool = False) -> StreamingQuery:
    """Runs the model over a stream of designs. Runs of batch k are Parquet below ``path``/batch=k, then ``consumer`` gets them with k.

    The query's checkpoint fixes which designs a batch has. A batch whose runs are written whole isn't run again by a
    query that is started again, and one that the consumer has finished isn't handed on again; a batch cut midway is
    written over. So ``path`` has each run once, and the consumer sees a batch again only if it was cut inside of the
    consumer itself: its number is then the key by which a consumer with effects elsewhere keeps them single. A
    consumer that raises stops the query before its batch counts as done. Empty batches are not handed on.
    """
    spark = design.sparkSession

    def batch(rows: DataFrame, k: int) -> None:
        part = f"{path}/batch={k}"
        if not _exists(spark, f"{part}/_SUCCESS"):
            M.run(model, rows).write.mode("overwrite").parquet(part)
        if consumer and not _exists(spark, f"{path}/_handed/{k}"):
            consumer(spark.read.parquet(part), k)
            _mark(spark, f"{path}/_handed/{k}")

    to = design.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (to if forever else to.trigger(availableNow=True)).start()


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of the batches that are written whole, with their batch."""
    return spark.read.parquet(path)


class Progress(StreamingQueryListener):
    """Tells ``report`` (batch, rows so far) after each batch of the queries it listens to. Add it by ``spark.streams.addListener``."""

    def __init__(self, report: Callable[[int, int], None]):
        self.report, self.rows, self.ended = report, {}, False

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if told.numInputRows:
            self.rows[str(told.id)] = self.rows.get(str(told.id), 0) + told.numInputRows
            self.report(told.batchId, self.rows[str(told.id)])

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.ended = True


def run_whole(model: M.Model, design: DataFrame, root: str, files: int = 4, consumer: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """A whole design worked off in ``files`` batches below ``root``: its finished runs. Called again with the same root it goes on where it stopped, without writing the design again."""
    spark = design.sparkSession
    if not _exists(spark, f"{root}/design/_SUCCESS"):
        design.repartition(files, F.xxhash64(*design.columns)).write.mode("overwrite").parquet(f"{root}/design")
    run_stream(model, stream_of(spark, f"{root}/design"), f"{root}/runs", f"{root}/checkpoint", consumer).awaitTermination()
    return finished_runs(spark, f"{root}/runs")
