"""What the corpus operators share: reading, written intermediate tables, column guards."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space as every contract here means it; the same set that ``bytes.split()`` splits on.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_left: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset, one made for a local run. A cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of whole texts that go to Python at once, and bytes after which a batch of fewer ends: long texts, or sets of their shingles,
#: would make a batch of rows alone as large as they are long, in the engine and in Python, for each core.
BATCH, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on no more than BATCH rows of this session, or about BATCH_BYTES bytes, go to Python at once. What is lazy runs later, so this stays set."""
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, most)


def _bytes(setting: str) -> int:
    """A number, or one of bytes with a unit, as Spark prints it."""
    found = re.fullmatch(r"(-?\d+)([bkmg]?)b?", setting.strip().lower())
    return int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2]]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder belongs to it
            return


class Scratch:
    """Tables of one operator run, written as Parquet below the shared folder.

    Writing cuts the lineage: what is read again doesn't depend on any executor's memory or disk. ``drop`` removes
    a table that nothing lazy reads any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _left.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
