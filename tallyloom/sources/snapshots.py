"""Versions of a master table: a new one counts only if its audit passes, and readers stay with the version that they began with."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "version long, accepted boolean, reasons array<string>, n long, at timestamp"


@dataclass(frozen=True)
class Audit:
    """What a load must have: columns, values in mandatory ones, unique keys, so many rows, and no fewer than a share of the last accepted version's."""

    mandatory: Sequence[str] = ()
    key: Sequence[str] = ()
    least_rows: int = 1
    least_share: float = 0.5
    faults: dict[str, str] = field(default_factory=dict)  # name: condition of rows that must not be there


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each load that was tried, in order of version."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    rows = spark.read.schema(MANIFEST).json(f"{root}/manifest/*.json") if there else spark.createDataFrame([], MANIFEST)
    return rows.orderBy("version")


def _reasons(rows: DataFrame, audit: Audit, last: int | None) -> tuple[list[str], int]:
    """Why rows fail their audit, and how many there are: one aggregation, and one more by key."""
    missing = [f"no column {c}" for c in dict.fromkeys([*audit.mandatory, *audit.key]) if c not in rows.columns]
    empty = {c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in audit.mandatory if c in rows.columns}
    tests = {f"empty {c}": x for c, x in empty.items()} | {name: F.expr(x) for name, x in audit.faults.items() if not missing}
    counted = rows.agg(F.count("*").alias("n"), *(F.count_if(x).alias(f"t{k}") for k, x in enumerate(tests.values()))).head()
    found = missing + [f"{name}: {counted[f't{k}']}" for k, name in enumerate(tests) if counted[f"t{k}"]]
    if audit.key and not missing:
        again = rows.groupBy(*audit.key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*")).head()[0]
        found += [f"repeated keys: {again}"] * bool(again)
    if counted.n < audit.least_rows:
        found.append(f"{counted.n} rows, fewer than {audit.least_rows}")
    elif last is not None and counted.n < audit.least_share * last:
        found.append(f"{counted.n} rows after {last}")
    return found, counted.n


def publish(rows: DataFrame, root: str, audit: Audit = Audit()) -> tuple[int, list[str]]:
    """Write rows as the next version below root, audit what was written, and say so in the manifest; the version, and why it was not accepted.

    Readers see a version only by its line in the manifest, which is written last; a load that breaks off, or fails
    its audit, leaves the last accepted version as it was. One writer at a time: of two, one fails on the folder of the version that both would write.
    """
    spark = rows.sparkSession
    tried = manifest(spark, root).agg(F.max("version"), F.max_by("n", F.when(F.col("accepted"), F.col("version")))).head()
    version, last = (tried[0] or 0) + 1, tried[1]
    folder = f"{root}/rows/version={version}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where) and not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
        files.delete(where, True)  # of a load that broke off
    rows.write.mode("overwrite" if files.exists(where) else "errorifexists").parquet(folder)
    reasons, n = _reasons(spark.read.schema(rows.schema).parquet(folder), audit, last)
    line = spark.createDataFrame([(version, not reasons, reasons, n)], "version long, accepted boolean, reasons array<string>, n long")
    line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/version={version}.json")
    return version, reasons


def latest_version(spark: SparkSession, root: str) -> int | None:
    return manifest(spark, root).filter("accepted").agg(F.max("version")).head()[0]


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of an accepted version, by default the last; the DataFrame keeps reading that one, whatever is published later. ValueError where there is none."""
    found = latest_version(spark, root) if version is None else version
    if found is None or manifest(spark, root).filter((F.col("version") == found) & F.col("accepted")).isEmpty():
        raise ValueError(f"{root} has no accepted version" + (f" {version}" if version else ""))
    return spark.read.parquet(f"{root}/rows/version={found}")
