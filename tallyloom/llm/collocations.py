"""Phrase collocation mining: count-min sketches, an exact count of what survives them, scores, subsumption.

First pass: each task adds the hashes of all its runs of one to five words to a count-min sketch (two rows of cells), of
which cells go no higher than LEAST; the tasks' sketches are added up block by block. A cell is never under the count of a
run that falls into it, so that a run all of whose cells reach LEAST in sum may be frequent and no other is. What the
driver holds and broadcasts is a bit for each cell, 4 MB. Second pass: runs survive if their bits, and those of both
runs one word shorter in them, are set; a task counts its survivors, packs them by language and part of the hashes of their text, and parts are summed. So nothing
frequent is lost, and what the sketches overestimate is dropped by its exact count. The sketch has the same width for every amount of
text, so that what a task sends of it is bounded: on more text than width * least / longest words (some 300 million by
default) most of its cells fill up, and more runs are counted only to be dropped. Give more width then, or a higher least; the result does not depend on the width.

A phrase of two to five words that occurs LEAST times or more is a candidate. Cut after its first k words its parts occur l
and r times (parts of a frequent phrase are frequent, so these counts are there too); the score is the least floor(1000 * a * n /
(l * r)), in decimals of 38 digits, of equal ones that of the smallest k. A candidate inside a longer one that has SHARE of 100 of its occurrences is subsumed.

Defined results: text null is empty; lang null is `und`, as is the value `und`. Repeated rows count each time; doc_id and all other columns
play no part. Ties in rank are broken by count and then by the phrase's bytes, which differ. A language without candidates, and an
empty table, give no rows. A very long text is taken in slabs cut between pieces; one piece is held whole. Runs are told apart by 64-bit hashes within a
slab, and by their text beyond.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.scratch import Scratch

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
WIDTH = 1 << 24  # cells of a row of the sketch: 128 MB in a task that fills it, 4 MB as bits
BLOCKS = 256  # of a sketch, added up apart from each other
SLAB = 4 << 20  # bytes of text at once
MEMO = 1 << 20  # words whose hash a task remembers
HELD = 400_000  # phrases that a task sums up before it sends them
PARTS = 4096  # of a language's phrases, dealt by hash; the distinct ones of a part are summed in memory
SALTS = 32

_BREAK, _SPACE = b"\n", b" "
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9 + _SPACE)
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    """The hash of each word; 0 for no word, 1 for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
            self.update({b"": 0, _BREAK: 1})
        found = self[word] = xxhash.xxh64_intdigest(word) | 2
        return found


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, plain text) in slabs of about SLAB bytes, cut where a piece ends."""
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
        by.setdefault(lang, []).append(text.encode().translate(_PLAIN))
    for lang, texts in by.items():
        held, size = [], 0
        for text in texts:
            at = 0
            while at < len(text):
                end = len(text) if len(text) - at <= SLAB else text.find(_BREAK, at + SLAB)
                end = len(text) if end < 0 else end
                held.append(text[at:end])
                size += end - at
                at = end
                if size >= SLAB:
                    yield lang, _BREAK.join(held)
                    held, size = [], 0
        if held:
            yield lang, _BREAK.join(held)


def _runs(slab: bytes, memo: _Hashes) -> tuple[list[bytes], np.ndarray]:
    """The words of a slab with a break between pieces, and their hashes."""
    words = slab.replace(_BREAK, b" \n ").split(_SPACE)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return words, hashes


def _grown(hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hash, inside a piece) of the run of k words that begins at each word."""
    word = hashes != 1
    run, inside = hashes, word
    for k in range(1, longest + 1):
        if k > 1:
            run = (run[:-1] ^ (run[:-1] >> np.uint64(29))) * _P1 + hashes[k - 1 :]
            inside = inside[:-1] & word[k - 1 :]
        if not len(run):
            return
        yield k, run, inside


def _cells(runs: np.ndarray, lang: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each run in both rows of a sketch of width, a power of two."""
    x = (runs + np.uint64(xxhash.xxh64_intdigest(lang.encode()))) * _P2
    x ^= x >> np.uint64(32)
    shift = np.uint64(65 - width.bit_length())
    return ((x * _P3) >> shift).astype(np.int64), ((x * _P1 ^ (x >> np.uint64(29))) * _P2 >> shift).astype(np.int64)


def frequent_cells(texts: DataFrame, width: int, least: int = LEAST, longest: int = LONGEST) -> np.ndarray:
    """uint8 [2, width / 8]: a bit for each cell that reaches least. texts: lang, text."""
    kind = np.uint8 if least < 128 else np.uint32
    blocks = min(BLOCKS, width // 8)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, memo = np.zeros((2, width), np.uint32), _Hashes({b"": 0, _BREAK: 1})
        for batch in batches:
            for lang, slab in _slabs(batch):
                _, hashes = _runs(slab, memo)
                for _, run, inside in _grown(hashes[hashes != 0], longest):
                    for row, at in zip(cells, _cells(run[inside], lang, width), strict=True):
                        np.add.at(row, at, np.uint32(1))
        if not cells.any():
            return
        parts = np.minimum(cells, least).astype(kind).reshape(2, blocks, -1)
        for b in range(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zstandard.compress(np.ascontiguousarray(parts[:, b]).tobytes(), 1)], pa.binary())], ["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                more = np.frombuffer(zstandard.decompress(packed), kind)
                sums[b] = np.minimum(sums[b] + more, least) if b in sums else more
        for b, cells in sums.items():
            bits = np.packbits((cells >= least).reshape(2, -1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    parts = texts.mapInArrow(sketch, "block int, cells binary").repartition("block")
    out = np.zeros((2, blocks, width // 8 // blocks), np.uint8)
    for b, bits in parts.mapInArrow(merge, "block int, bits binary").collect():  # width / 4 bytes in all
        out[:, b] = np.frombuffer(bits, np.uint8).reshape(2, -1)
    return out.reshape(2, -1)


def survivors(texts: DataFrame, bits: np.ndarray, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, f): the exact counts of runs of k words that occur least times; k = 0: the number of words of each lang."""
    width = bits.shape[1] * 8
    shared = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def packed(lang: str, own: Counter) -> Iterator[tuple[str, int, bytes, bytes]]:
        dealt: dict[int, list[bytes]] = defaultdict(list)
        for phrase in own:
            dealt[xxhash.xxh64_intdigest(phrase) % PARTS].append(phrase)
        for part, phrases in dealt.items():
            yield lang, part, zstandard.compress(_BREAK.join(phrases)), np.array([own[x] for x in phrases], "<i8").tobytes()

    def rows(sums: dict[str, Counter]) -> pa.RecordBatch:
        out = [x for lang, own in sums.items() for x in packed(lang, own)]
        columns = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "part", "phrases", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(np.frombuffer(shared.value, np.uint8).reshape(2, -1), axis=1).view(bool)
        memo, sums = _Hashes({b"": 0, _BREAK: 1}), defaultdict(Counter)
        for batch in batches:
            for lang, slab in _slabs(batch):
                words, hashes = _runs(slab, memo)
                real = np.flatnonzero(hashes)
                own = sums[lang]
                own[b"0 "] += int((hashes > 1).sum())
                before = None
                for k, run, inside in _grown(hashes[real], longest):
                    alive = inside if before is None else inside & before[:-1] & before[1:]
                    at = np.flatnonzero(alive)
                    first, second = _cells(run[at], lang, width)
                    at = at[frequent[0][first] & frequent[1][second]]
                    before = np.zeros(len(run), bool)
                    before[at] = True
                    _, some, n = np.unique(run[at], return_index=True, return_counts=True)
                    begins, ends = real[at[some]], real[at[some] + k - 1] + 1
                    start = b"%d " % k  # there may be gaps between the words of a run, but no breaks
                    for i, j, x in zip(begins.tolist(), ends.tolist(), n.tolist(), strict=True):
                        own[start + b" ".join(words[i:j] if j - i == k else filter(None, words[i:j]))] += x
                if sum(map(len, sums.values())) > HELD:
                    yield rows(sums)
                    sums.clear()
        yield rows(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(lang: str, own: Counter) -> pa.RecordBatch:
            found = [(int(x[:1]), x[2:].decode(), n) for x, n in own.items() if n >= least or x == b"0 "]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64())], ["lang", "k", "phrase", "f"])

        key, own = None, Counter()
        for batch in batches:
            for lang, part, phrases, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (lang, part):
                    if own:
                        yield frequent(key[0], own)
                    key, own = (lang, part), Counter()
                for phrase, n in zip(zstandard.decompress(phrases).split(_BREAK), np.frombuffer(counts, "<i8").tolist(), strict=True):
                    own[phrase] += n
        if own:
            yield frequent(key[0], own)

    parts = texts.mapInArrow(count, "lang string, part int, phrases binary, counts binary")
    return parts.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(summed, "lang string, k int, phrase string, f long")


def scored(often: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of each phrase of two words and more: the cut of the lowest score. often: as survivors() returns."""
    words = F.split("phrase", " ")
    cuts = often.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    cuts = cuts.select("lang", "phrase", "k", "a", "c", F.array_join(F.slice("w", F.lit(1), F.col("c")), " ").alias("x"), F.array_join(F.slice("w", F.col("c") + 1, F.col("k") - F.col("c")), " ").alias("y"))
    part = lambda text, count: often.filter("k >= 1").select("lang", F.col("phrase").alias(text), F.col("f").alias(count))
    total = often.filter("k = 0").select("lang", F.col("f").alias("n"))
    rows = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"]).join(total, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    rows = rows.withColumn("score", F.expr(f"(cast(1000 as decimal(38, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "c", "k", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.*").drop("c")


def inner_phrases(often: DataFrame) -> DataFrame:
    """(lang, phrase, around): the most occurrences of a longer candidate that has the phrase in it."""
    words = F.split("phrase", " ")
    sizes = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("z")
    rows = often.filter("k >= 3").select("lang", "k", "f", words.alias("w"), sizes)
    rows = rows.select("lang", "f", "w", "z", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("z") + 1)).alias("i"))
    return rows.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("z")), " ").alias("phrase")).agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, width: int = WIDTH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language of docs (lang, text)."""
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).filter("text <> ''")
    bits = frequent_cells(texts, width, least, longest)
    often = scratch.keep(survivors(texts, bits, least, longest), "frequent")
    rows = scored(often).join(inner_phrases(often), ["lang", "phrase"], "left")
    rows = rows.filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases in SALTS parts first, so that no task sorts all of one language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top).drop("place")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
