"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

Two documents are linked if 100 * |A and B| >= 75 * |A or B| holds for their sets of five-word shingles (module
shingles). Groups are the connected components of the links; the smallest doc_id names its group.

1. features(): one pass over the texts in Arrow batches. The 64-bit shingle hashes are dealt into BINS bins by their
   top bits and the least of each bin is its value (one hash function, one permutation). An empty bin takes the value
   of the first filled bin in a random order of its own (optimal densification). BANDS bands of ROWS bins make the
   bucket keys. At similarity 0.75 two sets share no bucket with probability (1 - 0.75^ROWS)^BANDS, about 1e-6.
2. Equal sets fall together: only one document of each class of equal sets goes on.
3. In each bucket the member with the least mixed id is the hub; hub-member pairs are the candidates, so that a bucket
   of n gives n - 1 pairs. Pairs whose sizes alone rule a link out go at once, the others are confirmed on full sets.
4. Two members that both missed their hub could still be linked. Documents of buckets that are not yet all in one
   component are open. Ordered by frequency among the open documents, rarest first, the first n - ceil(0.75 n) + 1
   shingles of two linked sets have one in common; buckets by such shingles get up to HUBS hubs each.
5. Of buckets that are still in several components, the documents are compared in blocks of at most about BLOCK sets
   and BLOCK_BYTES, block against block within a family of connected buckets, by a matrix product that gives out links
   only. A family's pairs of blocks are dealt out by their second block, so that many tasks share a large family. What is
   left here grows with the documents that lie close to the threshold in one group of copies, not with the groups.

Components are found by steps of joins until FEW_LINKS links or fewer are left, which one task settles. Every other step is a partial aggregation, an equi-join whose large keys Spark can split, or a pass over rows; no bucket is
gathered in a task beyond blocks of bounded size. Defined results: null or wordless text: size 0, linked with nothing, its own group. Null doc_id:
such rows are left out, as they cannot be named. doc_id must be unique; where it repeats with
different texts, each row is named by its own set, and the rows of the least class may be compared under either text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.shingles import U, mix, shingle_sets

BIN_BITS = 8
BINS = 1 << BIN_BITS
ROWS, BANDS = 5, 51
LEAST_NUMERATOR, LEAST_DENOMINATOR = 75, 100
HUBS, BLOCK = 16, 512
BLOCK_BYTES = 4 << 20  # of shingle hashes in a block; one longer document is a block of its own
CELLS = 1 << 22  # of a matrix of sets and shingles
BROADCAST_ROWS = 500_000  # ids of 8 bytes: at most 4 MB before Spark's hash table
FEW_LINKS = 200_000  # pairs of ids, at most 3 MB, whose components one task works out

_orders: list[np.ndarray] = []


def _rank() -> np.ndarray:
    """[j, b]: the place of bin b in the random order in which bin j, if empty, asks the others."""
    if not _orders:
        keys = mix(np.arange(1, BINS * BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(BINS, BINS)
        _orders.append(keys.argsort(axis=1).argsort(axis=1).astype(np.int16))
    return _orders[0]


def signature(found: np.ndarray) -> np.ndarray:
    """The densified one-permutation MinHash values of a sorted, distinct, non-empty set of hashes."""
    bins = (found >> U(64 - BIN_BITS)).astype(np.int64)
    first = np.ones(len(bins), bool)
    np.not_equal(bins[1:], bins[:-1], out=first[1:])
    filled = bins[first]
    out = np.zeros(BINS, U)
    out[filled] = found[first]
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[filled[_rank()[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


_ROW = mix(np.arange(11, 11 + ROWS, dtype=U)) | U(1)
_BAND = mix(np.arange(101, 101 + BANDS, dtype=U))


def band_keys(found: np.ndarray) -> np.ndarray:
    rows = signature(found)[: ROWS * BANDS].reshape(BANDS, ROWS)
    return mix((rows * _ROW).sum(axis=1) ^ _BAND)


def _set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a = int(np.add.reduce(mix(found)))
    b = int(np.bitwise_xor.reduce(mix(found ^ U(0x5851F42D4C957F2D))))
    return a, b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, a, b, offsets, keys = [], [], [], [0], []
        for found in shingle_sets(batch["text"]):
            n.append(len(found))
            if len(found):
                x, y = _set_key(found)
                keys.append(band_keys(found))
                a.append(_signed(x)), b.append(_signed(y))
            else:
                a.append(None), b.append(None)
            offsets.append(len(keys) * BANDS)
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), bands], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (equal for equal sets), bands (bucket keys; empty without words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(_features, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x.tobytes() for x in shingle_sets(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], ["node", "found"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["found_u"], batch["found_v"], strict=True):
            a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum()) if len(b) else 0
            keep.append(LEAST_DENOMINATOR * both >= LEAST_NUMERATOR * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(keep, pa.bool_())], ["u", "v", "linked"])


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted, stay below BROADCAST_ROWS; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of the links (u, v) of all batches: each step every component takes the least one beside it."""
    ends = [(x["u"].to_numpy(), x["v"].to_numpy()) for x in batches]
    if not ends:
        return
    u, v = map(np.concatenate, zip(*ends, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label, before = at[: len(u)], at[len(u) :], np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        for x, y in ((a, b), (b, a)):
            np.minimum.at(label, before[x], before[y])
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "comp"])


class Components:
    """Connected components of links that come in parts. labels: (node, comp) of the nodes that have any link."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.labels = scratch, None

    def add(self, links: DataFrame) -> None:
        """links: (u, v). Each step every component takes the least label beside it, labels are followed to their end, and the links between components that remain go on, until one task can hold them."""
        if self.labels is not None:
            links = self._relabel(links, self.labels)
        edges = self.scratch.keep(links.filter("u <> v").distinct(), "edges")
        while n := edges.count():
            if n <= FEW_LINKS:
                kept = self.scratch.keep(edges.coalesce(1).mapInArrow(_settled, "node long, comp long"), "parents")
                rest = None
            else:
                both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select("v", "u"))
                parent = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("comp"))
                kept = self._followed(self.scratch.keep(parent, "parents"))
                rest = self.scratch.keep(self._relabel(edges, kept.select("node", "comp")).filter("u <> v").distinct(), "edges")
            self._moved(kept)
            self.scratch.drop(edges)
            if rest is None:
                return
            edges = rest
        self.scratch.drop(edges)

    def _moved(self, kept: DataFrame) -> None:
        """Labels follow kept (node, comp), whose nodes are among their components or new. kept is dropped, or is the labels."""
        parent = kept.select("node", "comp")
        if self.labels is None:
            self.labels = kept if kept.columns == parent.columns else self.scratch.keep(parent, "labels")
        else:
            step = parent.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            moved = self.labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            labels = self.scratch.keep(moved.union(parent.join(self.labels.select("node"), "node", "left_anti")), "labels")
            self.scratch.drop(self.labels)
            self.labels = labels
        if self.labels is not kept:
            self.scratch.drop(kept)

    def _followed(self, parent: DataFrame) -> DataFrame:
        """Each label replaced by its own label until none changes."""
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            moved = self.scratch.keep(parent.select("node", "comp").join(up, "comp").select("node", F.col("to").alias("comp"), (F.col("comp") != F.col("to")).alias("moved")), "parents")
            self.scratch.drop(parent)
            if moved.filter("moved").isEmpty():
                return moved
            parent = moved

    def of(self, members: DataFrame) -> DataFrame:
        """members (with a column node) and the comp of each, its own id where it has no link yet."""
        if self.labels is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    @staticmethod
    def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
        for end in ("u", "v"):
            to = labels.select(F.col("node").alias(end), F.col("comp").alias("to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        return edges.select("u", "v")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones (u, v) of candidate pairs, by the full sets of both."""
    u = sets.select(F.col("node").alias("u"), F.col("found").alias("found_u"))
    v = sets.select(F.col("node").alias("v"), F.col("found").alias("found_v"))
    return pairs.join(v, "v").join(u, "u").mapInArrow(_confirm, "u long, v long, linked boolean").filter("linked").select("u", "v")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["found"]]
        n = np.array([len(x) for x in found], np.int64)
        for first in range(0, len(found), 256):
            part = slice(first, first + 256)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["node"].to_numpy(zero_copy_only=False)[part], n[part])), pa.array(np.repeat(n[part], n[part])), pa.array(np.concatenate(found[part]))], ["node", "n", "bucket"])


def _prefixes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, node, n): the prefix shingles of each of nodes that any other has too."""
    rows = sets.join(_small(nodes), "node", "left_semi").mapInArrow(_exploded, "node long, n long, bucket long")
    often = rows.groupBy("bucket").agg(F.count("*").alias("often")).filter("often > 1")
    shared = rows.join(often, "bucket")
    own = Window.partitionBy("node")
    shared = shared.withColumn("place", F.row_number().over(own.orderBy("often", "bucket"))).withColumn("alone", F.col("n") - F.count("*").over(own))
    length = F.expr(f"n - cast(ceil(n * {LEAST_NUMERATOR} / {LEAST_DENOMINATOR}) as long) + 1")
    return shared.filter(F.col("place") + F.col("alone") <= length).select("bucket", "node", "n")


def _sides(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes, components, sizes and all hashes in turn of each block, without copies."""
    rows, upto = column.values, column.offsets.to_numpy()
    found = rows.field("found")
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1] // 8
    hashes = np.frombuffer(found.buffers()[2], U)
    node, comp = rows.field("node").to_numpy(), rows.field("comp").to_numpy()
    for first, last in zip(upto[:-1], upto[1:], strict=True):
        yield node[first:last], comp[first:last], np.diff(offsets[first : last + 1]), hashes[offsets[first] : offsets[last]]


def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between two blocks of sets: |A and B| from a product of 0/1 matrices over the shingles that both blocks have."""
    for batch in batches:
        for sides in zip(_sides(batch["left"]), _sides(batch["right"]), strict=True):
            node, comp, sizes, flat = zip(*sides, strict=True)
            common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
            owner = [np.repeat(np.arange(len(x)), x) for x in sizes]
            both = np.zeros((len(node[0]), len(node[1])), np.int64)
            width = max(256, CELLS // max(1, *map(len, node)))
            for first in range(0, len(common), width):
                part, tables = common[first : first + width], []
                for k in (0, 1):
                    at = np.minimum(np.searchsorted(part, flat[k]), len(part) - 1)
                    hit = part[at] == flat[k]
                    table = np.zeros((len(node[k]), len(part)), np.float32)
                    table[owner[k][hit], at[hit]] = 1
                    tables.append(table)
                both += np.rint(tables[0] @ tables[1].T).astype(np.int64)
            union = sizes[0][:, None] + sizes[1][None, :] - both
            linked = (LEAST_DENOMINATOR * both >= LEAST_NUMERATOR * union) & (comp[0][:, None] != comp[1][None, :])
            u, v = np.nonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(node[0][u]), pa.array(node[1][v])], ["u", "v"])


def _in_blocks(families: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) of nodes (family, node, comp) of one family in different components."""
    members = sets.join(_small(families), "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("found")) / BLOCK_BYTES)).alias("slots"))
    blocks = members.join(_small(scratch.keep(sizes, "slots")), "family").withColumn("slot", F.pmod(F.xxhash64("node"), "slots"))
    blocks = scratch.keep(blocks.groupBy("family", "slots", "slot").agg(F.collect_list(F.struct("node", "comp", "found")).alias("block")), "blocks")
    alone = blocks.filter("slots = 1").select(F.col("block").alias("left"), F.col("block").alias("right"))
    many = blocks.filter("slots > 1")
    left = many.select("family", F.col("block").alias("left"), F.explode(F.sequence("slot", F.col("slots") - 1)).alias("slot"))
    pairs = left.join(many.select("family", "slot", F.col("block").alias("right")), ["family", "slot"]).select("left", "right")
    return alone.union(pairs).mapInArrow(_blocks_linked, "u long, v long")


def _hubs(members: DataFrame, slots: int) -> DataFrame:
    """(bucket, hub, hub_n, hub_comp): per bucket with several components up to slots members, the least of each slot. members: bucket, node, n, comp."""
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket")
    rows = members.join(mixed, "bucket", "left_semi").withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "node"), F.lit(slots)))
    least = rows.groupBy("bucket", "slot").agg(F.expr("min(struct(xxhash64(node) as h, node, n, comp)) as x"))
    return least.select("bucket", F.col("x.node").alias("hub"), F.col("x.n").alias("hub_n"), F.col("x.comp").alias("hub_comp"))


_NEAR = f"{LEAST_DENOMINATOR} * least(n, hub_n) >= {LEAST_NUMERATOR} * greatest(n, hub_n)"


def _representatives(docs: DataFrame, found: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, comp) of the class representatives in components of two or more, or None without links."""
    own = found.filter("n_shingles > 0").join(nodes.select(F.col("node").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    members = own.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    least = members.groupBy("bucket").agg(F.expr("min(struct(xxhash64(node) as h, node, n)) as hub"), F.count("*").alias("size")).filter("size > 1")
    shared = scratch.keep(members.join(least.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "bucket"), "buckets")
    if shared.isEmpty():
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = texts.join(_small(scratch.keep(shared.select("node").distinct(), "ids")), "node", "left_semi").mapInArrow(_sets, "node long, found binary")
    sets = scratch.keep(sets, "sets")
    parts = Components(scratch)

    pairs = shared.filter("node <> hub").filter(_NEAR).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    parts.add(_confirmed(pairs, sets))

    rest = parts.of(shared.filter("node <> hub").select("bucket", "node", "n"))
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket")
    opened = scratch.keep(rest.join(mixed, "bucket", "left_semi").select("node").distinct(), "opened")
    if opened.isEmpty():
        return parts.labels
    prefixes = scratch.keep(_prefixes(sets, opened), "prefixes")
    rest = parts.of(prefixes)
    pairs = rest.join(_hubs(rest, HUBS), "bucket").filter("comp <> hub_comp").filter(_NEAR).select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    parts.add(_confirmed(pairs, sets))

    rest = parts.of(prefixes)
    stars = scratch.keep(rest.join(_hubs(rest, 1).select("bucket", "hub"), "bucket").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "families")
    if stars.isEmpty():
        return parts.labels
    families = Components(scratch)
    families.add(stars)
    if families.labels is not None:
        parts.add(_in_blocks(parts.of(families.labels.select("node", F.col("comp").alias("family"))), sets, scratch))
    return parts.labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    docs: doc_id and text; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    found = scratch.keep(features(docs), "features")
    # the smallest doc_id stands for all documents with its set
    nodes = scratch.keep(found.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "classes")
    labels = _representatives(docs, found, nodes, scratch)
    named = nodes.withColumn("comp", F.col("node"))
    if labels is not None:
        named = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    out = found.select("doc_id", "n_shingles", "set_a", "set_b").join(named.select("set_a", "set_b", "comp"), ["set_a", "set_b"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
