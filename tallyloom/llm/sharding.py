"""Documents dealt into shards of near-equal bytes; equal texts stay together (law `bytes`).

Karmarkar-Karp differencing: each group of equal texts starts as a partial partition (its bytes, and nothing in the
other shards); the two partial partitions with the largest spread between their largest and smallest part are combined
in opposite order, largest part to smallest, until one is left. It runs in levels: groups are spread by their hash
over buckets of about BUCKET_GROUPS, each differenced in one task, which leaves one partial partition to a bucket; of
these MAX_BUCKETS at a time are combined in the same way in one task, and so on until no more than that are left, which the driver combines. The spread that is left is
about the smallest differences within buckets, unless one group alone is larger than a shard's share.

Defined results: size is the UTF-8 bytes of the text plus 1; a null text has none, and falls into the group of empty
texts. Slots count from 0 without gaps within a shard, in a mixed order of doc_ids and rows. Rows with a null or repeated
doc_id are dealt like others. More shards than groups leave some shards empty; no rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.scratch import Scratch

BUCKET_GROUPS = 20_000
MAX_BUCKETS = 16_384
CHUNK_ROWS = 2_000


def differencing(partials: Sequence[Sequence[int]], shards: int) -> np.ndarray:
    """Which shard each part of each partial partition goes to: [partial, part]. partials: bytes of each part, one row to a partial partition."""
    sizes = np.asarray(partials, dtype=object).reshape(len(partials), shards)
    # a node: its parts in falling order, and for each the (partial, part) pairs or the two nodes it was made of
    heap, made = [], []
    for k, row in enumerate(sizes):
        order = sorted(range(shards), key=lambda j: (-row[j], j))
        made.append(("leaf", k, order))
        parts = [row[j] for j in order]
        heap.append((-(parts[0] - parts[-1]), k, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        joined = [p + q for p, q in zip(a, reversed(b), strict=True)]
        order = sorted(range(shards), key=lambda j: (-joined[j], j))
        made.append(("pair", (x, y), order))
        parts = [joined[j] for j in order]
        heapq.heappush(heap, (-(parts[0] - parts[-1]), len(made) - 1, parts))
    out = np.zeros((len(sizes), shards), np.int32)
    if not heap:
        return out
    stack = [(heap[0][1], list(range(shards)))]  # node, shard of each of its parts
    while stack:
        node, shard = stack.pop()
        kind, of, order = made[node]
        before = [0] * shards
        for place, j in enumerate(order):
            before[j] = shard[place]
        if kind == "leaf":
            out[of] = before
        else:
            stack.append((of[0], before))
            stack.append((of[1], before[::-1]))
    return out


def _bucket(shards: int):
    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key_a", "key_b"], kind="stable")
        partials = np.zeros((len(rows), shards), dtype=object)
        partials[:, 0] = [int(x) for x in rows["bytes"]]
        return rows.assign(part=differencing(partials, shards)[:, 0])[["bucket", "key_a", "key_b", "bytes", "part"]]

    return solved


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs, which needs doc_id and the text column."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    half = lambda first: F.conv(F.substring("digest", first, 14), 16, 10).cast("long")  # noqa: E731  56 of 128 bits
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    keys = scratch.keep(rows.select("rid", "doc_id", "size", "text_crc32", half(1).alias("key_a"), half(15).alias("key_b")), "sizes")

    groups = keys.groupBy("key_a", "key_b").agg(F.sum("size").alias("bytes"))
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("key_a", "key_b"), F.lit(buckets)).cast("int"))
    parts = scratch.keep(groups.groupBy("bucket").applyInPandas(_bucket(shards), "bucket int, key_a long, key_b long, bytes long, part int"), "parts")
    placed = _placed(parts, buckets, shards, scratch)
    return _slotted(keys.join(placed, ["key_a", "key_b"]), shards, scratch).select("doc_id", "size", "text_crc32", "shard", "slot")


def _combined(shards: int):
    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "part"], kind="stable")
        nodes, first = np.unique(rows["bucket"], return_inverse=True)
        sizes = np.zeros((len(nodes), shards), dtype=object)
        for k, part, total in zip(first, rows["part"], rows["bytes"], strict=True):
            sizes[k, part] = int(total)
        dealt = differencing(sizes, shards)
        return rows.assign(part_above=dealt[first, rows["part"]])[["above", "bucket", "part", "part_above", "bytes"]]

    return solved


def _placed(parts: DataFrame, buckets: int, shards: int, scratch: Scratch) -> DataFrame:
    """(key_a, key_b, shard) of the groups of buckets: their parts are combined level by level, and the places in each level followed down."""
    spark = parts.sparkSession
    sums = parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    levels = []
    while buckets > MAX_BUCKETS:
        above = sums.withColumn("above", F.floor(F.col("bucket") / MAX_BUCKETS).cast("int"))
        moved = scratch.keep(above.groupBy("above").applyInPandas(_combined(shards), "above int, bucket int, part int, part_above int, bytes long"), "level")
        levels.append(moved.select("bucket", "part", "above", "part_above"))
        sums = moved.groupBy(F.col("above").alias("bucket"), F.col("part_above").alias("part")).agg(F.sum("bytes").alias("bytes"))
        buckets = -(-buckets // MAX_BUCKETS)
    sizes = np.zeros((buckets, shards), dtype=object)  # at most MAX_BUCKETS * shards numbers
    for bucket, part, total in sums.collect():
        sizes[bucket, part] = int(total)
    dealt = differencing(sizes, shards)
    to = F.broadcast(spark.createDataFrame([(b, p, int(dealt[b, p])) for b in range(buckets) for p in range(shards)], "bucket int, part int, shard int"))
    for moved in reversed(levels):  # the shard of a level's parts is that of the parts above they went to
        upper = to.select(F.col("bucket").alias("above"), F.col("part").alias("part_above"), "shard")
        to = moved.join(upper, ["above", "part_above"]).select("bucket", "part", "shard")
    return parts.join(to, ["bucket", "part"]).select("key_a", "key_b", "shard")


def _slotted(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """rows and slot: counted within chunks of a shard, plus the rows of the chunks before."""
    rows = scratch.keep(rows, "placed")
    chunks = max(1, -(-rows.count() // (shards * CHUNK_ROWS)))
    # by row too, so that rows with a null or one repeated doc_id do not meet in one chunk
    rows = rows.withColumn("mixed", F.xxhash64("doc_id", "rid")).withColumn("chunk", F.pmod("mixed", F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).select("shard", "chunk", "before")
    own = Window.partitionBy("shard", "chunk").orderBy("mixed", "rid")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(before, ["shard", "chunk"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long"))
