"""Tables found in the layout of a page: rows are bands of height, columns are what gaps between words leave, cells are where they meet.

All of it is sweeps by window over a page's own words; a page's rows never meet another page's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import normalize as N

WORD_GAP, COLUMN_GAP, LEAST_CELLS = 8.0, 1.0, 3


def swept(rows: DataFrame, keys: Sequence[str], low: str, high: str, gap: float, name: str, order: Sequence[str] = ()) -> DataFrame:
    """rows with name: the number from 1 of the cluster of overlapping intervals [low, high] that each lies in; intervals no more than gap apart belong together."""
    own = Window.partitionBy(*keys).orderBy(low, high, *order)
    before = F.max(high).over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = (before.isNull() | (F.col(low) > before + gap)).cast("int")
    return rows.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_begins")


def table_cells(words: DataFrame, page: Sequence[str], word_gap: float = WORD_GAP, column_gap: float = COLUMN_GAP, least: int = LEAST_CELLS, overlap: float = 0.5) -> DataFrame:
    """page, band, col, text, x0, y0, x1, y1 of the cells of the tables of pages. words: page, text, x0, y0, x1, y1.

    Words whose middles share a height, `overlap` of their own height at most apart, are a band; words of a band no more than
    word_gap apart are one piece of text. Bands of `least` pieces and more are rows of a table, all others (letterheads, running text)
    are not. Columns are the clusters of the pieces of all rows from left to right: whatever no gap of more than column_gap runs
    through from top to bottom. Pieces of one row and column are one cell, read from left to right. Words with null text or box are
    left out; equal words both count. Order: by place, then text.
    """
    keys, box = list(page), ("x0", "y0", "x1", "y1")
    rows = words.filter(" and ".join(f"{c} is not null" for c in ("text", *box))).select(*keys, "text", *box)
    middle, half = (F.col("y0") + F.col("y1")) / 2, (F.col("y1") - F.col("y0")) * overlap / 2
    rows = swept(rows.withColumns({"_top": middle - half, "_bottom": middle + half}), keys, "_top", "_bottom", 0.0, "band", ["x0", "text"])
    rows = swept(rows, [*keys, "band"], "x0", "x1", word_gap, "piece", ["text"])
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "y0", c))), lambda w: w[c]), " ")
    around = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    rows = rows.withColumn("_n", F.max("piece").over(Window.partitionBy(*keys, "band"))).filter(F.col("_n") >= least)  # pieces are numbered from 1
    pieces = rows.groupBy(*keys, "band", "piece").agg(in_order("text").alias("text"), *around)
    pieces = swept(pieces, keys, "x0", "x1", column_gap, "col", ["band", "piece"])
    return pieces.groupBy(*keys, "band", "col").agg(in_order("text").alias("text"), *around)


def table_rows(cells: DataFrame, page: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """page, band and a column for each label (name: pattern of its folded heading) of the rows below a page's heading, the first band with headings of two labels and more.

    A column belongs to the first label that its heading has; of two columns of one label the left one counts. Pages without a heading have no rows, rows without any labelled cell neither.
    """
    keys = list(page)
    own, band = Window.partitionBy(*keys), Window.partitionBy(*keys, "band")
    folded = N.fold_text(F.col("text"))
    which = F.coalesce(*(F.when(folded.rlike(pattern), F.lit(name)) for name, pattern in labels.items()))
    rows = cells.select(*keys, "band", "col", "text").filter(" and ".join(f"`{c}` is not null" for c in keys)).withColumn("_label", which)
    # by windows over a page's cells, so that the cells are worked out once
    several = reduce(Column.__add__, (F.max(F.when(F.col("_label") == name, 1).otherwise(0)).over(band) for name in labels)) >= 2
    rows = rows.withColumn("_named", several).withColumn("_head", F.min(F.when(F.col("_named"), F.col("band"))).over(own)).filter("band >= _head")
    places = {name: f"_at{k}" for k, name in enumerate(labels)}
    rows = rows.withColumns({at: F.min(F.when((F.col("band") == F.col("_head")) & (F.col("_label") == name), F.col("col"))).over(own) for name, at in places.items()})
    rows = rows.filter(F.col("band") > F.col("_head")).filter(F.col("col").isin(*map(F.col, places.values())))
    return rows.groupBy(*keys, "band").agg(*(F.max(F.when(F.col("col") == F.col(at), F.col("text"))).alias(name) for name, at in places.items()))


def line_items(rows: DataFrame, page: Sequence[str], article: str = "article", quantity: str = "quantity", price: str = "price") -> DataFrame:
    """page, line (10, 20, ...), article, quantity, price and total of table rows that have an article and a quantity above 0; a price that is none is null."""
    number = lambda c: N.lenient_double(F.regexp_extract(F.col(c), r"[-0-9][0-9 .,]*", 0))
    kept = rows.withColumns({"article": N.article_code(F.col(article)), "quantity": number(quantity), "price": number(price)}).filter("article is not null and quantity > 0")
    order = Window.partitionBy(*page).orderBy("band")
    return kept.select(*page, (F.row_number().over(order) * 10).alias("line"), "article", "quantity", "price", F.round(F.col("quantity") * F.col("price"), 2).alias("total"))


def first_of_parsers(parsers: Sequence[DataFrame], doc: str, same: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """The rows of the first parser and of each later one those that no earlier one has, as its columns in same say, with parser (from 0).

    parsers: doc and columns; same: for each parser after the first, the columns in which its rows must differ from earlier ones.
    """
    out = parsers[0].select(doc, *columns).withColumn("parser", F.lit(0))
    for k, (rows, on) in enumerate(zip(parsers[1:], same, strict=True), 1):
        known = out.select(doc, *on).distinct()
        differs = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (doc, *on)]
        condition: Column = differs[0]
        for more in differs[1:]:
            condition = condition & more
        new = rows.select(doc, *columns).alias("a").join(known.alias("b"), condition, "left_anti")
        out = out.unionByName(new.withColumn("parser", F.lit(k)))
    return out
