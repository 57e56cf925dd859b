"""Documents to a training corpus: language ID, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. Decisions are small tables of row ids; they are broadcast up to BROADCAST_ROWS
rows and joined by shuffle beyond. A stage gives each row an id of its own (_numbered()), decides by it and drops it, so
that rows with a null or repeated doc_id are judged one by one like others. Its own columns have names that docs does not have.

Defined results: a document without text has no language and goes at once, whatever else it has; equal rows are copies, of
which one stays, however often a row repeats; very long texts are judged whole; ties follow those of the operators (the
smallest doc_id, then the place in the table). An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.decontam import find_items
from tallyloom.llm.langid import identify
from tallyloom.llm.mixing import mix
from tallyloom.llm.neardup import near_duplicates
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.sharding import shard_by_bytes

SHARDS = 8
BROADCAST_ROWS = 500_000  # a doc_id and a small number

# mixing draws by seeded hash, and the trained and differenced stages have no SQL either
ORACLE_SQL = None


def _bounded(df: DataFrame, scratch: Scratch) -> DataFrame:
    df = scratch.keep(df, "decisions")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {x.lower() for x in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a column more, and its name: a number unique and stable, the file and the place in it of a row of Parquet; else numbers that are written with docs."""
    row = _fresh(docs, "_row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return Scratch(docs.sparkSession, name).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    path, index, file = (_fresh(docs, x) for x in ("_path", "_index", "_file"))
    files = docs.select(F.col("_metadata.file_path").alias(path)).distinct()
    # numbered where they are, in order of their names; a name and a number for each file
    files = files.withColumn(file, F.row_number().over(Window.orderBy(path)).cast("long"))
    at = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    own = [F.col(f"`{x}`") for x in docs.columns]
    return at.join(_bounded(files, Scratch(docs.sparkSession, name)), path).select(*own, (F.col(file) * F.lit(1 << 40) + F.col(index)).alias(row)), row


def _named(rows: DataFrame, row: str) -> DataFrame:
    """rows with the number as their doc_id."""
    return rows.select(F.col(row).alias("doc_id"), *(F.col(f"`{x}`") for x in rows.columns if x not in ("doc_id", row)))


def _without(rows: DataFrame, row: str, ids: DataFrame, name: str) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias(row)).distinct()
    return rows.join(_bounded(gone, Scratch(rows.sparkSession, name)), row, "left_anti")


def _own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`{x}`") for x in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could not be told go."""
    rows, row = _numbered(docs, "language")
    return _own(_without(rows, row, identify(_named(rows, row)).filter("not accepted"), "language"), docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, one if rows repeat it; one without a doc_id only where none in the group has any."""
    scratch = Scratch(spark, "copies")
    rows, row = _numbered(docs, "copies")
    ids = rows.select(F.col(row).alias("n"), "doc_id")
    found = near_duplicates(_named(rows, row)).select(F.col("doc_id").alias("n"), "component_id")
    found = scratch.keep(found.join(ids, "n"), "found")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("x"), F.count("*").alias("size")).filter("size > 1")
    gone = found.join(_bounded(first.select("component_id", F.col("x.n").alias("first")), scratch), "component_id").filter("n <> first")
    return _own(_without(rows, row, gone.select(F.col("n").alias("doc_id")), "copies"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    rows, row = _numbered(docs, "leaks")
    return _own(_without(rows, row, find_items(_named(rows, row), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows, row = _numbered(docs, "mixed")
    copies, copy = _fresh(docs, "_copies"), _fresh(docs, "_copy")
    taken = mix(rows, row=row).filter("copies > 0").select(F.col("rid").alias(row), F.col("copies").alias(copies))
    taken = _bounded(taken, Scratch(spark, "mixed"))
    return _own(rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return shard_by_bytes(docs, SHARDS)


STAGES = [("language ID", language_id), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mixed), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
