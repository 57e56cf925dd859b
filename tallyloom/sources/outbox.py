"""Deliveries that are made once: a ledger of batches, and a transport that can tell what is there already."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER = "file string, status string, attempts int, size long, error string, batch long"
UPLOADING = ".uploading"


class Transport(Protocol):
    """Where messages go. Opened in the task that sends; any OSError is tried again."""

    def size(self, name: str) -> int | None:
        """Bytes of a file that is there, else None."""

    def put(self, name: str, content: bytes) -> None: ...

    def rename(self, old: str, new: str) -> None: ...


def _send(transport: Transport, file: str, content: bytes, retries: int, wait: Callable[[float], None]) -> tuple[str, int, str]:
    """Status, attempts and error of one file. Under another name first, so that no half of it is seen; after the rename it is looked for."""
    error = ""
    for attempt in range(1, retries + 1):
        try:
            if transport.size(file) == len(content):  # of a task or a batch that ended before it could say so
                return "DELIVERED", attempt - 1, ""
            transport.put(file + UPLOADING, content)
            transport.rename(file + UPLOADING, file)
            if transport.size(file) != len(content):
                raise OSError(f"not found after the rename: {file}")
            return "DELIVERED", attempt, ""
        except OSError as failed:
            error = f"{type(failed).__name__}: {failed}"
            if attempt < retries:
                wait(2.0**attempt)
    return "FAILED", retries, f"after {retries} attempts: {error}"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was delivered, each batch's files; empty before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def _ended(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def deliver_once(rows: DataFrame, connect: Callable[[], Transport], path: str, batch: int, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The ledger's rows of this batch: file, status, attempts, size, error, batch of rows (file, message).

    The result is written before it is returned: reading it sends nothing. A batch that the ledger has is not sent again, nor is a
    file that an earlier batch delivered (its row says DUPLICATE); FAILED ones are. A task that is run again finds by name and
    size what its first run sent (the transport must keep names apart by content, as files of one number do). Of rows with
    one file name in a batch one is sent, that with the least message. Null file names or messages are left out.
    connect: makes a transport in the task, one for each.
    """
    spark = rows.sparkSession
    own = f"{path}/batch={batch}"
    if not _ended(spark, own):
        before = ledger(spark, path).filter((F.col("status") == "DELIVERED") & (F.col("batch") != batch)).select("file", F.lit(True).alias("sent")).distinct()
        asked = rows.filter("file is not null and message is not null").groupBy("file").agg(F.min("message").alias("message"))

        def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            transport = None
            for part in parts:
                out = []
                for file, message, known in part[["file", "message", "sent"]].itertuples(index=False):
                    content = message.encode()
                    if known is True:
                        out.append((file, "DUPLICATE", 0, len(content), ""))
                        continue
                    transport = transport or connect()
                    status, attempts, error = _send(transport, file, content, retries, wait)
                    out.append((file, status, attempts, len(content), error))
                yield pd.DataFrame(out, columns=["file", "status", "attempts", "size", "error"])

        done = asked.join(before, "file", "left").mapInPandas(sent, "file string, status string, attempts int, size long, error string")
        done.write.mode("overwrite").parquet(own)
    return ledger(spark, path).filter(F.col("batch") == batch)


def delivering(stream: DataFrame, connect: Callable[[], Transport], path: str, checkpoint: str, retries: int = 3) -> None:
    """deliver_once() for each micro-batch of a stream of messages, all that is there; a batch that is run again after a failure sends nothing twice."""

    def send(batch: DataFrame, number: int) -> None:
        deliver_once(batch, connect, path, number, retries)

    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
