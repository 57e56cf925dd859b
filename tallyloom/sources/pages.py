"""Pages of binary documents by readers that the caller supplies: the first reader whose text is long enough wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.extract import page_selection

LEAST_CHARS = 80
Reader = Callable[[bytes], list[str]]
_PAGES = "path string, page int, text string, reader string, error string"


def read_pages(files: DataFrame, readers: Sequence[tuple[str, Reader]]) -> DataFrame:
    """path, page, text, reader and error of files (path, content). readers: name and function from bytes to the texts of pages.

    A file that no reader makes out is one row with an error and page null; one broken file does not stop the others.
    Files come in Arrow batches bounded by bytes.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                errors = []
                for name, reader in readers:
                    try:
                        pages = reader(bytes(content))
                    except Exception as failed:  # a reader may fail in any way on a broken file; the row says how
                        errors.append(f"{name}: {failed}")
                        continue
                    if sum(map(len, pages)) >= LEAST_CHARS:
                        out += [(path, k, text, name, None) for k, text in enumerate(pages, 1)]
                        break
                    errors.append(f"{name}: under {LEAST_CHARS} characters")
                else:
                    out.append((path, None, None, None, "; ".join(errors)))
            yield pd.DataFrame(out, columns=["path", "page", "text", "reader", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(read, _PAGES)


def selected_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages (path, page, ...) that wanted (path, selection: a list like 1,3-5) names; of files without a selection all, of an invalid one none."""
    counts = pages.groupBy("path").agg(F.max("page").alias("_n"))
    chosen = counts.join(wanted, "path").select("path", F.coalesce(page_selection(F.col("selection"), F.col("_n")), F.array().cast("array<int>")).alias("_pages"))
    return pages.join(chosen, "path", "left").filter(F.col("_pages").isNull() | F.array_contains("_pages", F.col("page"))).select(pages.columns)
