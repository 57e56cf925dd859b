"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Lague, then seeded block selection.

Targets: the sources in the order of their code points, null last, weigh 5, 2, 1 and so on in turn and share the words
of all documents by weight; no target exceeds MOST times its source's words, and what is above goes to the others by
weight until none is above.

The mix is cut into equal-token blocks of total / blocks words (width). Seats for blocks go to the sources by the highest
quotients target / (2 k - 1), the k-th seat of a source; the first seats make up the first output shard, the next the
second, so that each shard has an integer quota of each source (quotas()). There are BLOCKS blocks, or twice that and so on until the
smallest target is worth FINE of them, MOST_BLOCKS at most: a source misses its target by half a block, or somewhat more
where many sources have less than one. A source's documents lie in a seeded order of doc_id and text, passed over
again and again, and that line is cut into blocks of width words: the source takes as many blocks as its quotas say, whole
passes included, shard after shard its quota of them. So quota * width words are what it takes; the target only trims
the last block where the quota was rounded up. Whole documents are taken. A document larger
than the room that is left is passed over, and the rest go on in the seeded order: in each round those of at most half
the room, as far as their running sum goes, and where there are none the first of those that fit; the room halves or the
source is done in each, until no untaken document of any source fits (_filling()); once FEW or fewer fit, a source's rounds are gone through in one task.

Running sums are taken within ranges of hashes of about RANGE documents, within groups of TOGETHER ranges and over the groups of a source; a source's
documents, or all of its ranges, never come together in a task. Defined results: size 0 for null or wordless text; such documents are never taken. Documents with
a null doc_id or source, and repeated rows, are mixed like others, each row by itself. No documents, no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS, MOST_BLOCKS = 4096, 1 << 20
FINE = 64  # blocks of the smallest target
RANGE = 2_000  # documents of a range of hashes
TOGETHER = 4096  # ranges whose running sums are taken in one task
SHARDS = 8
SEED = 20240611
_ORDER = ("mixed", "doc_id", "size", "rid")  # of the documents of a source
MAX_SOURCES = 1_000_000  # their targets are worked out in one task
FEW = 100_000  # documents that still fit, all sources together, whose rounds are gone through a source at a time
FEW_SOURCES = 50_000  # some 60 bytes each


def n_words(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: source (null allowed, each once), source_size. Adds weight and target.

    With L words per unit of weight, a target is least(most * source_size, weight * L). The sources that are capped
    are those of the smallest most * source_size / weight, so L follows from running sums in that order.
    """
    order = Window.orderBy(F.col("source").isNull(), F.expr("cast(source as binary)"))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    all_rows = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("all_weight", F.sum("weight").over(all_rows))
    at = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(at), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(at), F.lit(0)))
    # were just the sources before this one capped, the rest would get this much per unit of weight
    rows = rows.withColumn("rate", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    rows = rows.withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    # where a source fits, all later ones do, at lower rates: the highest is that of the first
    rows = rows.withColumn("level", F.max(F.when(F.col("fits"), F.col("rate"))).over(all_rows))
    return rows.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))).select("source", "source_size", "weight", "target")


def seats(goals: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(source, place): places 0 to blocks - 1 in the order of the quotients. goals: source (each once), target.

    The seats of a source are its share c * target * blocks / total, rounded, for some c; the sum of all seats bounds c
    both over all sources and over those with half a seat or more, and so how many quotients a source must be offered.
    """
    every = Window.partitionBy()
    offered = goals.filter("target > 0").withColumn("share", F.col("target") * blocks / F.sum("target").over(every))
    large = F.col("share") >= 0.5
    offered = offered.withColumn("n", F.count("*").over(every)).withColumn("n_large", F.sum(large.cast("long")).over(every)).withColumn("large", F.sum(F.when(large, F.col("share"))).over(every))
    most = F.least((blocks + F.col("n") / 2) / blocks, (blocks + F.col("n_large") / 2) / F.col("large"))
    last = F.least(F.lit(blocks), F.ceil(F.col("share") * most).cast("int") + 1)
    offered = offered.select("source", "target", F.explode(F.sequence(F.lit(1), last)).alias("k"))
    order = Window.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), F.col("source").isNull(), "source", "k")
    return offered.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < blocks).select("source", "place")


def quotas(goals: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(source, shard, blocks): the integer quota of each source in each of shards output shards."""
    shard = F.floor(F.col("place") * shards / blocks).cast("int")
    return seats(goals, blocks).withColumn("shard", shard).groupBy("source", "shard").agg(F.count("*").alias("blocks"))


def n_blocks(goals: DataFrame, blocks: int = BLOCKS) -> int:
    """blocks, or twice that and so on until the smallest target has FINE blocks."""
    total, least = goals.filter("target > 0").agg(F.sum("target"), F.min("target")).head()
    while total and blocks < MOST_BLOCKS and least * blocks < FINE * total:
        blocks *= 2
    return blocks


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, blocks: int = BLOCKS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target (of the document's source), taken (words, repeats counted), copies, quota (blocks of its source) and shards (the output shard of each copy) of every document. row: a column of docs, unique and not null, that is returned as rid."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"].cast("string")).alias("size"), (docs[row].cast("long") if row else F.monotonically_increasing_id()).alias("rid"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    rows = scratch.keep(rows, "sizes")  # read from there on, so that it is stable
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = scratch.keep(targets(sizes, weights, most), "targets")
    n = goals.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; their targets are worked out in one task, which holds at most {MAX_SOURCES}")
    blocks = n_blocks(goals, blocks)
    goals = scratch.keep(_with_quota(goals, blocks), "quotas")
    taken = _taken(rows, goals, most, blocks, seed, scratch)
    return taken if row else taken.drop("rid")


def _with_quota(goals: DataFrame, blocks: int) -> DataFrame:
    """goals and by_shard: the source's quota in each output shard."""
    in_shard = lambda k: F.coalesce(F.sum(F.when(F.col("shard") == k, F.col("blocks"))), F.lit(0)).cast("long")
    quota = quotas(goals, blocks=blocks).groupBy("source").agg(F.array(*map(in_shard, range(SHARDS))).alias("by_shard"))
    joined = goals.alias("g").join(quota.alias("q"), F.expr("g.source <=> q.source"), "left")
    return joined.select("g.*", F.coalesce("q.by_shard", F.array_repeat(F.lit(0).cast("long"), SHARDS)).alias("by_shard"))


def _taken(rows: DataFrame, goals: DataFrame, most: float, blocks: int, seed: int, scratch: Scratch) -> DataFrame:
    n_sources, total = goals.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).head()
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    goals = goals.alias("g").join(counts.alias("c"), F.expr("g.source <=> c.source")).select("g.*", F.ceil(F.col("n") / RANGE).alias("own_blocks"))
    goals = goals.withColumn("quota", F.aggregate("by_shard", F.lit(0).cast("long"), lambda x, y: x + y))
    # the quota's blocks, the last of which the target may trim
    goals = goals.withColumn("limit", F.least("target", F.col("quota") * F.lit(float(total)) / blocks))
    goals = goals.withColumn("passes", F.floor(F.when(F.col("source_size") > 0, F.col("limit") / F.col("source_size")).otherwise(0)))
    goals = goals.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source"))
    small = F.broadcast(goals) if n_sources <= FEW_SOURCES else goals
    by = [x for x in ("doc_id", "text_hash") if x in rows.columns]
    joined = rows.alias("r").join(small.alias("g"), F.expr("r.source <=> g.source")).select("r.rid", "r.doc_id", "r.size", *(f"r.{x}" for x in by[1:]), "g.*")
    mixed = F.xxhash64(*by, F.lit(seed))  # by text too, where rows have its hash, so that rows with a null or one repeated doc_id do not meet in one block
    place = F.shiftrightunsigned(mixed, 11) * F.lit(2.0**-53)  # uniform in [0, 1)
    joined = joined.withColumn("mixed", place).withColumn("block", F.floor(F.col("mixed") * F.col("own_blocks")))

    before = _before(joined)
    own = Window.partitionBy("sid", "block").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumn("upto", F.sum("size").over(own)).join(before, ["sid", "block"])
    extra = F.col("limit") - F.col("passes") * F.col("source_size")
    once_more = F.col("before") + F.col("upto") <= extra
    placed = scratch.keep(placed.select("rid", "doc_id", "size", "sid", "mixed", "block", "source_size", "target", "quota", "by_shard", "passes", (F.col("before") + F.col("upto") - F.col("size")).alias("start"), extra.alias("extra"), once_more.alias("once_more")), "placed")
    added = scratch.keep(_filling(placed, n_sources, scratch), "added")
    extra_copy = (F.col("once_more") | F.col("added").isNotNull()).cast("long")
    copies = F.least(F.lit(int(most)), F.col("passes") + extra_copy)
    out = placed.join(F.broadcast(added) if added.count() <= 50_000 else added, "rid", "left")
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    out = out.withColumn("copies", copies)
    return out.select("rid", "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", F.col("quota").cast("long").alias("quota"), _shards(total / blocks).alias("shards"))


def _before(rows: DataFrame) -> DataFrame:
    """(sid, block, before): the words of a source before each of its ranges: those of whole groups of TOGETHER ranges, and those within the group."""
    by = rows.groupBy("sid", "block").agg(F.sum("size").alias("words")).withColumn("upper", F.floor(F.col("block") / TOGETHER))
    upto = lambda *keys, at: F.sum("words").over(Window.partitionBy(*keys).orderBy(at)) - F.col("words")
    groups = by.groupBy("sid", "upper").agg(F.sum("words").alias("words")).select("sid", "upper", upto("sid", at="upper").alias("outer"))
    return by.withColumn("inner", upto("sid", "upper", at="block")).join(groups, ["sid", "upper"]).select("sid", "block", (F.col("outer") + F.col("inner")).alias("before"))


def _shards(width: float) -> Column:
    """The output shard of each copy: that of the block in which it begins, as the quotas of the source deal its blocks out; what is added beyond them goes with the last."""
    last = lambda k: F.aggregate(F.slice("by_shard", 1, k + 1), F.lit(0).cast("long"), lambda x, y: x + y)  # noqa: E731  the first block after shard k
    block = lambda copy: F.least(F.floor((copy * F.col("source_size") + F.col("start")) / F.lit(width or 1.0)), F.col("quota") - 1)
    shard = lambda copy: F.when(F.col("quota") > 0, sum((block(copy) >= last(k)).cast("int") for k in range(SHARDS - 1))).otherwise(F.pmod("sid", F.lit(SHARDS)).cast("int"))
    return F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), shard)).otherwise(F.array().cast("array<int>"))


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """rid of the documents of one source that fill its room, round by round as in _filling()."""
    rows = rows.sort_values(["mixed", "id", "size", "rid"], kind="stable")
    size, room, rid = rows["size"].to_numpy(), rows["room"].iloc[0], rows["rid"].to_numpy()
    taken, left = np.zeros(len(rows), bool), np.arange(len(rows))
    while len(left := left[~taken[left] & (size[left] <= room)]):
        small = left[2 * size[left] <= room]
        now = small[np.cumsum(size[small]) <= room] if len(small) else left[:1]
        taken[now] = True
        room -= size[now].sum()
    return pd.DataFrame({"rid": rid[taken]})


def _filling(placed: DataFrame, n_sources: int, scratch: Scratch) -> DataFrame:
    """(rid, added): what each source takes beyond the first document that did not fit, until nothing fits."""
    room = placed.groupBy("sid").agg(F.first("extra").alias("extra"), F.coalesce(F.sum(F.when(F.col("once_more"), F.col("size"))), F.lit(0)).alias("used")).select("sid", (F.col("extra") - F.col("used")).alias("room"))
    room = scratch.keep(room, "room")
    rest = placed.filter("not once_more and size > 0").select("rid", "sid", "block", *_ORDER[:-1])
    added = placed.select("rid", F.lit(True).alias("added")).limit(0)
    while True:
        bound = F.broadcast(room) if n_sources <= FEW_SOURCES else room
        # what does not fit now never will
        fit = scratch.keep(rest.join(bound, "sid").filter("size <= room"), "fit")
        n = fit.count()
        if n == 0:
            return added
        if n <= FEW:
            last = fit.select("sid", "rid", "mixed", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size", "room")
            return added.union(last.groupBy("sid").applyInPandas(_filled, "rid long").withColumn("added", F.lit(True)))
        firsts = fit.groupBy("sid").agg(F.min(F.struct(*_ORDER)).alias("x"), F.sum(F.when(2 * F.col("size") <= F.col("room"), 1)).alias("small")).filter("small is null").select(F.col("x.rid").alias("rid"))
        small = fit.filter(2 * F.col("size") <= F.col("room"))
        before = _before(small).join(bound, "sid").filter("before < room").drop("room")
        own = Window.partitionBy("sid", "block").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = small.join(before, ["sid", "block"]).withColumn("upto", F.sum("size").over(own)).filter(F.col("before") + F.col("upto") <= F.col("room"))
        taken = scratch.keep(reached.select("rid").union(firsts).withColumn("added", F.lit(True)), "filling")  # some of each source of fit: its first small one, or a first
        added = added.union(taken)
        known = fit.join(F.broadcast(taken) if taken.count() <= 50_000 else taken, "rid", "left")
        room = scratch.keep(known.groupBy("sid").agg((F.first("room") - F.coalesce(F.sum(F.when(F.col("added"), F.col("size"))), F.lit(0))).alias("room")), "room")
        rest = known.filter("added is null").select("rid", "sid", "block", *_ORDER[:-1])
