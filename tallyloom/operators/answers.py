"""Answers of models as variants: fields under several names and paths, of types that drift, none lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import extract as X, normalize as N

Field = tuple[Sequence[str], str]  # paths in order, and a kind: text, number, whole, flag, list

_FLAGS = ("true", "yes", "oui", "1"), ("false", "no", "non", "0")


def parsed(body: Column) -> Column:
    """body as a variant: as it is if it is JSON, else the JSON that stands in it (fenced or amid words); null if there is none."""
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(X.salvaged_json(body)))


def _kind(at: Column) -> Column:
    return F.schema_of_variant(at)


def value(answer: Column, path: str, kind: str) -> Column:
    """The value at a path as kind, whatever type it came in; null where there is none that can be read so, or it is empty."""
    at = F.try_variant_get(answer, path, "variant")
    if kind == "list":  # one value that should have been a list is a list of one
        many = F.try_variant_get(answer, path, "array<variant>")
        return F.when(many.isNotNull(), many).when(at.isNotNull() & (_kind(at) != "VOID"), F.array(at))
    raw = F.trim(F.try_variant_get(answer, path, "string"))  # numbers and flags as their text
    plain = F.when(~_kind(at).rlike("^(OBJECT|ARRAY|VOID)"), F.nullif(raw, F.lit("")))
    if kind == "text":
        return plain
    if kind == "number":
        return N.once(plain, N.lenient_double)
    if kind == "whole":
        return N.once(N.once(plain, N.lenient_double), lambda x: F.when(x == F.floor(x), F.floor(x)))
    if kind == "flag":
        return N.once(F.lower(plain), lambda x: F.when(x.isin(*_FLAGS[0]), True).when(x.isin(*_FLAGS[1]), False))
    raise ValueError(f"no kind {kind}")


def answer_fields(rows: DataFrame, body: str, fields: Mapping[str, Field], answer: str = "answer") -> DataFrame:
    """rows with a column for each field, from the first path that has a value of its kind, with answer (the variant, so that fields nobody asked for are kept), and drift: the fields that came under another than their first path or as another type."""
    out = rows.withColumn(answer, parsed(F.col(body)))
    typed = {"text": "^STRING", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "whole": "^BIGINT", "flag": "^BOOLEAN", "list": "^ARRAY"}
    found, drift = {}, []
    for name, (paths, kind) in fields.items():
        tried = [value(F.col(answer), path, kind) for path in paths]
        found[name] = F.coalesce(*tried)
        first = F.try_variant_get(F.col(answer), paths[0], "variant")
        as_meant = tried[0].isNotNull() & _kind(first).rlike(typed[kind])
        drift.append(F.when(found[name].isNotNull() & ~F.coalesce(as_meant, F.lit(False)), F.lit(name)))
    return out.withColumns(found | {"drift": F.array_compact(F.array(*drift))})


def answer_lines(rows: DataFrame, key: str, lines: str, fields: Mapping[str, Field]) -> DataFrame:
    """key, line (from 1) and the fields of each element of a list of variants that answer_fields() gave."""
    each = rows.select(key, F.posexplode(F.col(lines)).alias("line", "_line"))
    found = {name: F.coalesce(*(value(F.col("_line"), path, kind) for path in paths)) for name, (paths, kind) in fields.items()}
    return each.withColumn("line", F.col("line") + 1).withColumns(found).drop("_line")
