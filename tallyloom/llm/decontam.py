"""Test items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if the document has at least 75 of 100 of the item's distinct five-word shingles; the
document may be of any length. Only DataFrame functions are used.

1. Items are partitioned by size: class c holds those of 2^c to 2^(c+1) - 1 shingles. An item's sketch is the k_c least
   64-bit hashes of its shingles (a bottom-k MinHash), with k_c = 2^(c-1) + 1 or all of them if they are fewer. An item
   of n shingles in a document with three quarters of them can lack at most floor(n / 4) of its sketch, so k_c -
   floor(n / 4), at least one, must be there: the search loses nothing, whatever the document's length.
2. Each document's shingle hashes stream past the sketches, which are broadcast if they are at most BROADCAST_ROWS, and
   joined by shuffle otherwise. Pairs of document and item with enough sketch hashes are candidates.
3. The shingles of candidate documents, as texts, are counted against the whole sets of their items.

Words are runs of other than ASCII white space, in lower case. A text of one to four words is one shingle, so that an item
of fewer than five words is found only where it is the whole document. Defined
results: null and wordless items and documents have no shingles and are never found; rows with a null doc_id or item_id
cannot be named and are left out; texts under one repeated doc_id or item_id count together. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.scratch import Scratch

WORDS = 5
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _runs(table: DataFrame, key: str) -> DataFrame:
    """(key, w0 to w4): every run of WORDS words of each row. Fewer words are one run, filled up with nulls.

    The runs are columns side by side, so that what follows is compiled code. (slice() in a function of the array's
    elements would copy the array for each; of explode() in place of explode_outer() Spark would infer a filter on the
    array and work out the words once more for it.)
    """
    rows = table.select(F.col(key).cast("long").alias(key), F.lower(F.col("text").cast("string")).alias("text")).filter(f"`{key}` is not null and text is not null")
    rows = rows.select(key, F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[ \t\n\x0B\f\r]+").alias("w"))
    filled = f"case when size(w) >= {WORDS} then w when w[0] <> '' then concat(w, array_repeat(cast(null as string), {WORDS} - size(w))) end"
    rows = rows.select(key, F.expr(filled).alias("w")).select(key, "w", (F.size("w") - (WORDS - 1)).alias("n"))
    shifted = F.arrays_zip(*(F.slice("w", F.lit(k + 1), F.col("n")) for k in range(WORDS)))
    runs = rows.select(key, F.explode_outer(shifted).alias("x"))
    return runs.select(key, *(F.col("x")[str(k)].alias(f"w{k}") for k in range(WORDS))).filter("w0 is not null")


_RUN = [f"w{k}" for k in range(WORDS)]


def _texts(table: DataFrame, key: str) -> DataFrame:
    """(key, s): the shingles of each row as texts."""
    return _runs(table, key).select(key, F.concat_ws(" ", *_RUN).alias("s"))


def _hashes(table: DataFrame, key: str) -> DataFrame:
    """(key, h): the shingles of each row as hashes."""
    return _runs(table, key).select(key, F.xxhash64(*_RUN).alias("h"))


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows and the bytes of its texts, counted, stay within bounds; else joined by shuffle."""
    texts = [F.coalesce(F.octet_length(x), F.lit(0)) for x, kind in df.dtypes if kind == "string"]
    n, size = df.agg(F.count("*"), F.sum(sum(texts, F.lit(0).cast("long")))).head()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, h, n_item, needed): the sketch hashes of each item, its size, and how many of them a document must have."""
    own = _hashes(items, "item_id").distinct()
    # the k least of n: hashes are compared as they are, so that every item draws from one random order
    sets = own.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs")).withColumn("n_item", F.size("hs"))
    sets = sets.withColumn("k", F.least("n_item", F.expr("cast(pow(2, floor(log2(n_item)) - 1) as int) + 1")))
    sets = sets.withColumn("needed", F.greatest(F.lit(1), F.col("k") - F.floor(F.col("n_item") / 4)))
    return sets.select("item_id", F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"), "n_item", "needed")


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item (the item's shingles), n_shared (of these in the document), containment of each found pair. docs: doc_id, text; items: item_id, text."""
    scratch = Scratch(docs.sparkSession, "decontam")
    probes = scratch.keep(sketches(items), "sketches")
    met = _hashes(docs, "doc_id").join(_bounded(probes), "h").select("doc_id", "item_id", "h", "needed")
    pairs = met.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("hits"), F.first("needed").alias("needed")).filter("hits >= needed").select("doc_id", "item_id")
    pairs = scratch.keep(pairs, "candidates")
    chosen = docs.join(_bounded(scratch.keep(pairs.select("doc_id").distinct(), "documents")), "doc_id", "left_semi")

    whole = scratch.keep(_texts(items, "item_id").distinct(), "shingles")
    sizes = whole.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # a shingle of many items counts for the candidates among them only
    shared = _texts(chosen, "doc_id").join(_bounded(whole), "s").join(_bounded(pairs), ["doc_id", "item_id"], "left_semi").distinct()
    counts = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    found = counts.join(_bounded(sizes), "item_id").filter("100 * n_shared >= 75 * n_item")
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
