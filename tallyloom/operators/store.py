"""State as an append-only log of change rows and views of the latest state by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.ranking import latest_per_key

# fixed values: the states of a job and which may follow which
STATES = {"RECEIVED": ("PROCESSING",), "RETRY": ("PROCESSING",), "PROCESSING": ("COMPLETED", "REJECTED", "DUPLICATE", "FAILED"), "FAILED": ("RETRY",), "REJECTED": ("RETRY",)}


def change(rows: DataFrame, kind: str, at: Column, actor: str = "system") -> DataFrame:
    """rows as change rows of a kind; append them to the log with the writer of the table's format."""
    return rows.withColumns({"change": F.lit(kind), "changed_at": at, "actor": F.lit(actor)})


def latest_state(log: DataFrame, key: str, seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The last row of each key by seq, without those that say they are deleted."""
    out = latest_per_key(log, key, seq, seq)
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted in log.columns else out


def patched_state(log: DataFrame, key: str, fields: list[str], seq: str = "seq") -> DataFrame:
    """For each key the last value that is not null of each field: rows of the log may set some fields only."""
    return log.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields))


def edited_state(log: DataFrame, key: list[str], fields: list[str], seq: str = "seq", actor: str = "actor", edited_by: str = "user") -> DataFrame:
    """As patched_state(), with sources: a map from each field to the actor of its last value, for those that edited_by set last.

    A hot key sends one row of a task: values and actors are aggregated together before the shuffle. Of changes with one seq the greatest value counts.
    """
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(f).alias("v"), F.col(actor).alias("a")))).alias(f) for f in fields]
    rows = log.groupBy(*key).agg(*last)
    by = F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"{f}.a")))), lambda _, a: a == edited_by)
    return rows.select(*key, *(F.col(f"{f}.v").alias(f) for f in fields), by.alias("sources"))


def with_amounts(lines: DataFrame, quantity: str = "quantity", price: str = "unit_price", amount: str = "amount") -> DataFrame:
    """lines whose amount is quantity times price, two decimals, where both are known; else the amount that they have."""
    return lines.withColumn(amount, F.coalesce(F.round(F.col(quantity) * F.col(price), 2), F.col(amount)))


def hits(log: DataFrame, key: list[str], at: str) -> DataFrame:
    """How often each key was seen, first and last."""
    return log.groupBy(*key).agg(F.count("*").alias("hit_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key does not exist yet, the first of each key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def allowed(moves: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """The moves that STATES permits."""
    test = F.lit(False)
    for state, to in STATES.items():
        test = test | ((F.col(before) == state) & F.col(after).isin(*to))
    return moves.filter(test)


def assembled(parents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """parents with an array of structs for each kind of child, in the order of its columns; empty where there are none."""
    out = parents
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c not in (key, *order)]
        lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out
