"""Writers: message files, reports, and deliveries through a transport that the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def write_messages(rows: DataFrame, path: str, name: str = "file", message: str = "message") -> None:
    """One folder for each file name; Spark's commit makes them appear at once."""
    rows.select(name, F.col(message).alias("value")).write.mode("append").partitionBy(name).text(path)


def append_log(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("append").format(kind).save(path)


def reported(rows: DataFrame, keys: Sequence[str], hidden: Sequence[str] = ("source", "score_resolution")) -> DataFrame:
    """rows in the order of their keys, without the columns that are for inner use; those that rows lack are no matter."""
    return rows.drop(*hidden).orderBy(*keys)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.format(kind).save(path)


def deliver(rows: DataFrame, send: Callable[[str, str], None], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(file, status, attempts, error) of sending each row's file and message; tried again after 1, 2, 4 ... seconds. Reading the result sends, each time: outbox.deliver_once() is for messages that must go once."""

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for file, message in zip(part["file"], part["message"], strict=True):
                error, n = "", 0
                for n in range(1, retries + 1):
                    try:
                        send(file, message)
                        error = ""
                        break
                    except OSError as failed:
                        error = str(failed)
                        if n < retries:
                            wait(2.0 ** (n - 1))
                out.append((file, "FAILED" if error else "DELIVERED", n, error))
            yield pd.DataFrame(out, columns=["file", "status", "attempts", "error"])

    return rows.select("file", "message").mapInPandas(sent, "file string, status string, attempts int, error string")
