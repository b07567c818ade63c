"""Tables between the steps of an operator, in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  A table there cuts the lineage, survives the
loss of executors, and tells the planner its size, so that joins with it are broadcast
only when they are small.  Results read these tables when they are used, so the tables stay
as long as the session: they are deleted when the driver's JVM ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES, _SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local session without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python are bounded by bytes as well as by rows, unless the session says otherwise."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, BATCH_BYTES)


@contextlib.contextmanager
def session_setting(spark: SparkSession, name: str, value: str):
    """The setting for what is planned meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _forget(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class Scratch:
    """Writes tables and forgets those that are no longer needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/pagemill-{name}-{uuid.uuid4().hex}"
        self._next = 0
        self._path, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def _claim(self) -> str:
        """The next path; the first one has the folder deleted at the end."""
        if not self._next:
            place = self._path(self.folder)
            place.getFileSystem(self._conf).mkdirs(place)
            place.getFileSystem(self._conf).deleteOnExit(place)
        self._next += 1
        return f"{self.folder}/{self._next - 1}"

    def table(self, frame: DataFrame) -> DataFrame:
        """Write ``frame`` and return it as read back."""
        path = self._claim()
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.pagemill_path = path
        return out

    def bucketed(self, frame: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
        """Like ``table``, dealt by ``keys`` into as many buckets as the session shuffles into.

        Joins on the keys, and aggregates and windows by them and more, then need no shuffle,
        whatever columns each of them reads.  The entry in the session's catalog goes at exit.
        """
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"pagemill_{uuid.uuid4().hex}"
        frame.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", self._claim()).saveAsTable(name)
        atexit.register(_forget, self.spark, name)
        return self.spark.table(name)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that nothing will read again."""
        for table in tables:
            path = self._path(table.pagemill_path)
            path.getFileSystem(self._conf).delete(path, True)
