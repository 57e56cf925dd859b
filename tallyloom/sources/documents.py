"""Paged documents as a data source: partitions by file and range of pages, read by a reader that the caller supplies."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "path string, page int, text string, error string"
PAGES_A_TASK = 50
FILES_A_TASK = 100  # whose pages are counted


class Reader(NamedTuple):
    """How to read one kind of document: its number of pages, and (page, text) of some of them. Both take the path; what they open is theirs."""

    count: Callable[[str], int]
    pages: Callable[[str, Sequence[int]], Iterable[tuple[int, str]]]


class _Pages(InputPartition):
    def __init__(self, path: str, pages: tuple[int, ...] | None, error: str | None = None):
        self.path, self.pages, self.error = path, pages, error


def chosen(selection: str | None, count: int) -> list[int]:
    """Pages of a list like 1,3-5, in order; all where there is none. Those beyond the last are left out; ValueError for what is no such list."""
    if not (selection or "").strip():
        return list(range(1, count + 1))
    found: set[int] = set()
    for part in selection.split(","):
        first, _, last = part.strip().partition("-")
        if not first.strip().isdigit() or (last and not last.strip().isdigit()):
            raise ValueError(f"no list of pages: {selection}")
        a, b = int(first), int(last or first)
        if not 1 <= a <= b:
            raise ValueError(f"no list of pages: {selection}")
        found.update(range(a, min(b, count) + 1))
    return sorted(found)


class _PageReader(DataSourceReader):
    def __init__(self, reader: Reader, counts: list[tuple[str, int, str | None]], selection: str | None, columns: list[str], per_task: int):
        self.reader, self.counts, self.selection, self.columns, self.per_task = reader, counts, selection, columns, per_task
        self.tests: list[Callable[[int], bool]] = []

    def partitions(self) -> list[InputPartition]:
        """A task for each file and PAGES_A_TASK of its pages."""
        out: list[InputPartition] = []
        for path, count, error in self.counts:
            try:
                pages = [p for p in chosen(self.selection, count) if all(test(p) for test in self.tests)]
            except ValueError as failed:
                error = f"ValueError: {failed}"
            if error:
                out.append(_Pages(path, None, error))
                continue
            out += [_Pages(path, tuple(pages[k : k + self.per_task])) for k in range(0, len(pages), self.per_task)]
        return out or [_Pages("", ())]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        if partition.pages is None:
            yield self._row(partition.path, None, None, partition.error)
            return
        if "text" not in self.columns:  # nothing of the file is needed
            yield from (self._row(partition.path, page, None, None) for page in partition.pages)
            return
        left = list(partition.pages)
        try:
            for page, text in self.reader.pages(partition.path, partition.pages) if left else ():
                if page in left:
                    left.remove(page)
                    yield self._row(partition.path, page, text, None)
            error = "the reader gave no such page"
        except Exception as failed:
            error = f"{type(failed).__name__}: {failed}"
        yield from (self._row(partition.path, page, None, error) for page in left)

    def _row(self, *values: str | int | None) -> tuple:
        named = dict(zip(("path", "page", "text", "error"), values, strict=True))
        return tuple(named[c] for c in self.columns)


class _FilteringPageReader(_PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        """Conditions on the page number choose pages before any is read; all others are left to Spark."""
        of = {EqualTo: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}
        for f in filters:
            if type(f) in of and f.attribute == ("page",) and isinstance(f.value, int):
                self.tests.append(lambda page, test=of[type(f)], value=f.value: test(page, value))
            elif isinstance(f, In) and f.attribute == ("page",):
                self.tests.append(lambda page, values=frozenset(f.value): page in values)
            else:
                yield f


def _counted(spark: SparkSession, paths: Sequence[str], count: Callable[[str], int]) -> list[tuple[str, int, str | None]]:
    """Path, number of pages and error of each file, counted in tasks."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path in part["path"]:
                try:
                    out.append((path, int(count(path)), None))
                except Exception as failed:  # a reader may fail in any way on a broken file; the row says how
                    out.append((path, 0, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(out, columns=["path", "n", "error"])

    rows = spark.createDataFrame([(k, x) for k, x in enumerate(paths)], "k long, path string")
    tasks = max(1, min(len(paths), 8) if len(paths) <= FILES_A_TASK else -(-len(paths) // FILES_A_TASK))
    found = rows.repartition(tasks, "k").select("path").mapInPandas(counted, "path string, n long, error string").collect()  # a row a file, like a listing
    return sorted((x.path, x.n, x.error) for x in found)


def read_documents(spark: SparkSession, paths: Sequence[str], reader: Reader, pages: str | None = None, columns: Sequence[str] = ("path", "page", "text", "error"), per_task: int = PAGES_A_TASK) -> DataFrame:
    """path, page, text and error of the selected pages of documents.

    Pages are read in tasks of per_task pages, and only those of the selection and, where spark.sql.python.filterPushdown.enabled
    is true, those that filters on `page` leave; without the column text no file is read. A file whose pages cannot be counted is one row with an error and no page; pages that the reader
    fails on have an error and no text. The paths and their page counts are on the driver, like the listing of any file source; contents
    never are, and pages are counted in tasks.
    """
    schema = ", ".join(c.strip() for c in SCHEMA.split(",") if c.split()[0] in columns)
    kind = _FilteringPageReader if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else _PageReader

    counts = _counted(spark, list(dict.fromkeys(paths)), reader.count)

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return "documents"

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return kind(reader, counts, pages, schema.fieldNames(), per_task)

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans the scan knows the environment's modules only
    spark.dataSource.register(Documents)
    return spark.read.format("documents").load()
