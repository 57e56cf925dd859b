"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import delivery, documents, fields, intake, layout, listing, resolving, review, streams

_ALL = {**resolving.QUERIES, **listing.QUERIES, **documents.QUERIES, **review.QUERIES, **intake.QUERIES, **delivery.QUERIES, **streams.QUERIES, **layout.QUERIES, **fields.QUERIES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: plan for name, (plan, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers matched against the supplier master: blocked, scored and ranked."""
    return QUERIES["score_top2_gap"](spark, sf_dir)
