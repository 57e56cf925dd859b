"""Intermediate tables, cut off from their lineage and kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 8 << 20


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder on one machine (master local), else RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        found = _own[context.applicationId]
    return found.rstrip("/")


class Scratch:
    """Parquet tables below shared_dir(): a lost executor loses none of them, and no later read repeats the work.

    drop() removes a table that no unread DataFrame needs any more. What is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        # with its scheme, so that Python tasks open files in the same store as Spark does
        base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
        self.root = f"{base}/tallyloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        # whole texts go to Python in batches of this many bytes, however many rows that is
        if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write df once and return a DataFrame that reads it."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := df.__dict__.pop("_scratch_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception:  # the JVM may have ended before us; the folder is scratch anyway
                return
