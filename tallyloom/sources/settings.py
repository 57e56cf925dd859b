"""Settings from INI or YAML files: defaults below, the file above them, names of the environment filled in, types as the defaults have them."""

from __future__ import annotations

import configparser
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession, functions as F

from tallyloom.operators.intake import deep_merge

_TRUE = ("true", "1", "yes", "y")


def _filled(value: Any, environment: Mapping[str, str]) -> Any:
    """${NAME} in texts, at any depth, replaced by the environment's value; '' for names that it lacks."""
    if isinstance(value, str):
        return re.sub(r"\$\{([^}]+)\}", lambda m: environment.get(m[1], ""), value).strip()
    if isinstance(value, Mapping):
        return {k: _filled(v, environment) for k, v in value.items()}
    return [_filled(x, environment) for x in value] if isinstance(value, list) else value


def _typed(value: Any, like: Any, name: str) -> Any:
    if isinstance(value, Mapping):
        return {k: _typed(v, like.get(k) if isinstance(like, Mapping) else None, f"{name}.{k}" if name else k) for k, v in value.items()}
    if isinstance(like, bool) and isinstance(value, str):
        return value.lower() in _TRUE
    if isinstance(like, int) and not isinstance(like, bool) and isinstance(value, str):
        try:
            return int(value)
        except ValueError:
            raise ValueError(f"{name} must be a whole number") from None
    return value


def _text(spark: SparkSession, path: str) -> str:
    """A small file as text, from any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "")).collect()
    return rows[0][0] if rows else ""


def read_settings(spark: SparkSession, path: str, defaults: Mapping, environment: Mapping[str, str], mandatory: tuple[str, ...] = (), fixed: Mapping[str, str] = {}) -> dict:
    """defaults overridden by a file (.ini: sections of keys; .yaml and .yml: mappings, if a YAML library can be imported).

    mandatory: names like section.key that must be filled; fixed: names and the only values that they may have (a profile's
    sender and receiver). ValueError says which are not. Keys of INI files are lower case.
    """
    text = _text(spark, path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        parser = configparser.RawConfigParser()
        parser.read_string(text)
        found = {section: dict(parser.items(section)) for section in parser.sections()}
    settings = _typed(_filled(deep_merge(dict(defaults), found), environment), defaults, "")

    def at(name: str) -> Any:
        value: Any = settings
        for part in name.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        return value

    wrong = [f"{name} is missing" for name in mandatory if at(name) in (None, "")]
    wrong += [f"{name} is {at(name)!r}, not {value!r}" for name, value in fixed.items() if at(name) != value]
    if wrong:
        raise ValueError("; ".join(wrong))
    return settings
