"""Class-based bigram language model in Brown's manner, and the scores that it gives to texts.

P(text) is the product over its words and its end of P(class | class before) * P(word | class).

1. Words are counted over all training texts (64-bit hashes, summed in each task, then by shuffle). The head holds the
   words that occur twice or more, the HEAD most frequent of them at most; all other words are the tail, which unknown
   words belong to as well. Texts are written once more as positions in the head, and what follows reads these.
2. Exchange clustering gives every word of the head one of CLASSES classes. The SEEDS most frequent words are exchanged
   one by one over their bigrams. Then, ROUNDS times, all words are exchanged in batches by task: each task counts the
   classes before and after every word, the counts of a range of words meet in one task, and that task moves each word
   to the class that gains most in the likelihood of the class bigrams, on its own copy of their table, which follows
   its moves. In the first round the words without a class join one; in the next ones all may move, and a round that
   lowers the likelihood is taken back.
3. Class bigrams are counted over all training texts and smoothed with the classes' own frequencies. P(word | class) is
   the word's share of the class's tokens. In the tail every count is lower by a discount, n1 / (n1 + 2 n2) of the
   words seen once and twice, and what it frees is the probability of an unknown word. So unknown words have mass at
   every size of the vocabulary: where the head holds all that occurs twice, they share it with the words seen once.
4. A pass over all texts adds up what the head gives; words of the tail go by shuffle to their counts. No word outside
   the head is frequent, so no key of that join is large but one that training texts lack.

Tokens: words (runs of other than ASCII white space, A-Z lower-cased), then one end. base_score is the unigram model
with add-one smoothing. Defined results: a null text is empty and has its end only; a null doc_id trains; repeated rows
count as often as they stand; a text of any length is one row and scored whole. Of equal gains the class of the lowest
number wins, words of equal frequency move in the order of their hashes, of equally frequent words at the border of the seeds those of the least hashes. Without training texts all
words are unknown. No documents, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.shingles import U, buffers, slices, word_hashes

HEAD = 1 << 20  # 18 bytes each are broadcast: 19 MB
SEEDS, CLASSES = 1024, 64
TAIL, END, NEW = CLASSES, CLASSES + 1, CLASSES + 2  # what stands beside the classes; NEW: no class yet
SYMBOLS = CLASSES + 3
ROUNDS = 2
RANGE, BATCH = 1024, 256  # words whose contexts meet in a task, and that move at once
BATCH_SHARE = 1 / 500  # of all tokens that more than one word may have to move at once
RANGES_A_TASK = 8  # so that the number of tasks grows with the head, and not with the cluster, which would change the classes
FOLDED = 512  # tasks whose counts of a range are added up in one
BACK_OFF = 5.0
SWEEPS = 10
_TOP = 18
FLUSH = 1 << 21


class Head:
    """Finds words of the head by their hashes: positions in the sorted keys, by way of the hashes' top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.first = np.searchsorted(keys >> U(64 - _TOP), np.arange((1 << _TOP) + 1, dtype=U)).astype(np.int32)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Position of each word, -1 where it is not in the head."""
        out = np.full(len(words), -1, np.int32)
        if not len(self.keys):
            return out
        top = (words >> U(64 - _TOP)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        left = np.flatnonzero(at < end)
        at, end, sought = at[left], end[left], words[left]
        while len(left):
            same = self.keys[at] == sought
            out[left[same]] = at[same]
            more = ~same & (at + 1 < end)
            left, at, end, sought = left[more], at[more] + 1, end[more], sought[more]
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([x for x, _ in parts])
    n = np.concatenate([x for _, x in parts])
    order = keys.argsort()
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _combined(found: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and how often each occurs, summed up as far as FLUSH keys of memory go."""
    parts, size = [], 0
    for keys in found:
        keys, n = np.unique(keys, return_counts=True)
        parts.append((keys, n.astype(np.int64)))
        size += len(keys)
        if size > FLUSH:
            parts = [_merged(parts)]
            size = len(parts[0][0])
            if size > FLUSH // 2:
                yield parts[0]
                parts, size = [], 0
    if parts:
        yield _merged(parts)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = buffers(batch["text"])
    for first, last in slices(offsets):
        own = offsets[first : last + 1]
        words, upto = word_hashes(data[own[0] : own[-1]], own - own[0])
        yield first, last, words, upto


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, n in _combined(words for batch in batches for *_, words, _ in _texts(batch)):
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])


_CODED = "rid long, doc_id long, held_out boolean, codes array<int>, tail array<long>, times array<int>"


def _coder(head: Head, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """codes: positions in the head, -1 for a word of the tail; tail, times: these words' hashes and how often the text has each."""
    for batch in batches:
        for first, last, words, upto in _texts(batch):
            at = head.find(words)
            out = at < 0
            tail, owner = words[out], np.repeat(np.arange(last - first), np.diff(upto))[out]
            order = np.lexsort((tail, owner))
            tail, owner = tail[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], (tail[1:] != tail[:-1]) | (owner[1:] != owner[:-1])])[: len(tail)])
            times = np.diff(np.append(starts, len(tail)))
            offsets = pa.array(np.searchsorted(owner[starts], np.arange(last - first + 1)).astype(np.int32))
            part = batch.slice(first, last - first)
            lists = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(tail[starts].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([part["rid"], part["doc_id"], part["held_out"], *lists], ["rid", "doc_id", "held_out", "codes", "tail", "times"])


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts of a batch in turn, and for each text the number of those before it."""
    column = batch["codes"]
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets - offsets[0]


def _line(symbols: np.ndarray, upto: np.ndarray, end: int = END) -> np.ndarray:
    """The symbols of the texts with an end before the first and after each."""
    out = np.full(len(symbols) + len(upto), end, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(1, len(upto)), np.diff(upto))] = symbols
    return out


def _bigrams(coded: DataFrame, symbol: np.ndarray, size: int, end: int) -> np.ndarray:
    """[symbol, symbol] counts over all texts. symbol: of each position of the head, and last of the tail."""
    shared = coded.sparkSession.sparkContext.broadcast(symbol.astype(np.int16))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            codes, upto = _codes(batch)
            line = _line(shared.value[codes], upto, end)
            table += np.bincount(line[:-1] * size + line[1:], minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["at", "n"])

    found = coded.select("codes").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    out = np.zeros(size * size)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What exchanging raises: that part of the log-likelihood of class bigrams that depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(axis=1)).sum() - _f(table.sum(axis=0)).sum())


def exchange(bigrams: np.ndarray, counts: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word, one word after the other. bigrams: [word, word] counts of these words in turn; counts: how often each occurs.

    At first the k-th most frequent word is in class k modulo classes.
    """
    v = len(counts)
    classes = max(1, min(classes, v))
    order = np.lexsort((np.arange(v), -counts))
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    of = rank % classes
    member = np.eye(classes)[of]
    after, before = bigrams @ member, bigrams.T @ member  # [word, class]: how often the class follows, goes before
    between = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            g, self_n = of[w], bigrams[w, w]
            a, b = after[w].copy(), before[w].copy()
            a[g] -= self_n
            b[g] -= self_n
            between[g] -= a
            between[:, g] -= b
            between[g, g] -= self_n
            rows, columns = between.sum(axis=1), between.sum(axis=0)
            out_n, in_n = a.sum() + self_n, b.sum() + self_n
            gain = (_f(between + a) - _f(between)).sum(axis=1) + (_f(between + b[:, None]) - _f(between)).sum(axis=0)
            own = np.diag(between)
            gain += _f(own + a + b + self_n) - _f(own + a) - _f(own + b) + _f(own)
            gain -= _f(rows + out_n) - _f(rows) + _f(columns + in_n) - _f(columns)
            h = int(gain.argmax())
            if gain[h] <= gain[g] + 1e-9:
                h = g
            between[h] += a
            between[:, h] += b
            between[h, h] += self_n
            if h != g:
                moved += 1
                of[w] = h
                for table, line in ((after, bigrams[:, w]), (before, bigrams[w])):
                    table[:, g] -= line
                    table[:, h] += line
        if not moved:
            break
    return of


def moved(table: np.ndarray, of: np.ndarray, after: np.ndarray, before: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class that each word of a batch gains most in. table: [symbol, symbol] class bigrams, changed as the words move;
    after, before: [word, symbol] how often the symbol follows, goes before. The words' own class of less than `classes` may keep them; any other symbol may not."""
    gain = np.zeros((len(of), classes))
    stay = np.zeros(len(of))
    for counts, own in ((after, table), (before, table.T)):
        w, g = np.nonzero(counts)
        n = counts[w, g][:, None]
        cells = own[:classes, g].T
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        some, all_n = w[starts], counts.sum(axis=1)
        gain[some] += np.add.reduceat(_f(cells + n) - _f(cells), starts, axis=0) if len(w) else 0
        here = own[of[w], g]
        stay += np.bincount(w, _f(here) - _f(here - n[:, 0]), len(of))
        total = own.sum(axis=1)
        gain -= _f(total[:classes] + all_n[:, None]) - _f(total[:classes])
        stay -= _f(total[of]) - _f(total[of] - all_n)
    has = of < classes
    gain[np.flatnonzero(has), of[has]] = stay[has]
    to = gain.argmax(axis=1)
    to = np.where(has & (gain[np.arange(len(of)), to] <= stay + 1e-9), of, to)
    for sign, where in ((-1, of), (1, to)):
        member = np.zeros((len(table), len(of)))
        member[where, np.arange(len(of))] = sign
        table += member @ after
        table += (member @ before).T
    return to


def _batches(words: np.ndarray, counts: np.ndarray, most: float) -> Iterator[np.ndarray]:
    """words in turn, BATCH or counts of `most` at once, or one word. Words that move at once do not see each other."""
    upto, first = np.concatenate([[0], np.cumsum(counts)]), 0
    while first < len(words):
        last = min(first + BATCH, max(first + 1, int(np.searchsorted(upto, upto[first] + most, "right")) - 1))
        yield words[first:last]
        first = last


def _contexts(coded: DataFrame, of: np.ndarray) -> DataFrame:
    """(r, salt, keys, n): of the words of range r, the counts of each (word, side, symbol), keys as differences, by task."""
    shared = coded.sparkSession.sparkContext.broadcast(np.append(of, TAIL).astype(np.int16))
    width = RANGE * 2 * SYMBOLS

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            codes, upto = _codes(batch)
            line = _line(shared.value[codes], upto)
            own = codes >= 0
            at = (np.arange(len(codes)) + np.repeat(np.arange(1, len(upto)), np.diff(upto)))[own]
            first = codes[own].astype(np.int64) * (2 * SYMBOLS)
            yield np.concatenate([first + line[at + 1], first + SYMBOLS + line[at - 1]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _combined(keys_of(batches)):
            if len(keys):
                r = keys // width
                yield _blocks(np.unique(r), r, keys - r * width, n)

    return coded.select("codes").mapInArrow(counted, "r int, keys array<int>, n array<long>").withColumn("salt", F.floor(F.spark_partition_id() / FOLDED).cast("int"))


def _blocks(which: np.ndarray, r: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row to each of which; r: sorted."""
    offsets = np.append(np.searchsorted(r, which), len(r))
    steps = np.diff(keys, prepend=0)
    steps[offsets[:-1]] = keys[offsets[:-1]]
    at = pa.array(offsets.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(steps.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(n))], ["r", "keys", "n"])


def _folded(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The sum of the blocks of each key in turn; equal keys stand together."""
    at, total = None, None
    for batch in batches:
        for row, keys, n in zip(zip(*(batch[x].to_pylist() for x in by), strict=True), batch["keys"], batch["n"], strict=True):
            if row != at:
                if at is not None:
                    yield at, total
                at, total = row, np.zeros(RANGE * 2 * SYMBOLS, np.int64)
            total[np.cumsum(keys.values.to_numpy())] += n.values.to_numpy()
    if at is not None:
        yield at, total


def _by_range(blocks: DataFrame) -> DataFrame:
    """blocks with few rows to a range: those of FOLDED tasks are added up first where there are more."""
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r, _), total in _folded(batches, ("r", "salt")):
            keys = np.flatnonzero(total)
            yield _blocks(np.array([r]), np.full(len(keys), r), keys, total[keys])

    return blocks.repartition("r", "salt").sortWithinPartitions("r", "salt").mapInArrow(folded, "r int, keys array<int>, n array<long>")


def _exchanged(coded: DataFrame, of: np.ndarray, table: np.ndarray, all_words: bool) -> np.ndarray:
    """of after one round over all words, or over those without a class."""
    shared = coded.sparkSession.sparkContext.broadcast((of.astype(np.int16), table))

    def exchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = shared.value[0].astype(np.int64), shared.value[1].copy()
        for (r,), total in _folded(batches, ("r",)):
            counts = total.reshape(RANGE, 2, SYMBOLS).astype(float)
            words = r * RANGE + np.arange(RANGE)
            words = words[words < len(of)]
            if not all_words:
                words = words[of[words] == NEW]
            words = words[counts[words - r * RANGE].any(axis=(1, 2))]
            for part in _batches(words, counts[words - r * RANGE, 0].sum(axis=1), own.sum() * BATCH_SHARE):
                to = moved(own, of[part], counts[part - r * RANGE, 0], counts[part - r * RANGE, 1])
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(to.astype(np.int16))], ["word", "to"])

    blocks = _contexts(coded, of)
    if (coded.select(F.spark_partition_id().alias("p")).agg(F.max("p")).head()[0] or 0) >= FOLDED:
        blocks = _by_range(blocks)
    tasks = max(1, -(-len(of) // (RANGE * RANGES_A_TASK)))
    ranges = blocks.select("r", "keys", "n").repartition(tasks, "r").sortWithinPartitions("r")
    found = ranges.mapInArrow(exchanged, "word long, to short").toArrow()  # at most HEAD rows of 10 bytes
    of = of.copy()
    of[found["word"].to_numpy()] = found["to"].to_numpy()
    return of


def clustered(coded: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word of the head (those without any class next to them keep NEW), and the [symbol, symbol] class bigrams. coded: the training texts."""
    seeds = np.lexsort((np.arange(len(counts)), -counts))[:SEEDS]
    symbol = np.full(len(counts) + 1, SEEDS, np.int64)  # SEEDS: a word without a class, then the tail and the end
    symbol[-1] = SEEDS + 1
    symbol[seeds] = np.arange(len(seeds))
    bigrams = _bigrams(coded, symbol, SEEDS + 3, SEEDS + 2)
    to = np.concatenate([np.full(SEEDS, NEW), [NEW, TAIL, END]])
    to[: len(seeds)] = exchange(bigrams[: len(seeds), : len(seeds)], counts[seeds].astype(float), CLASSES) if len(seeds) else 0
    member = np.eye(SYMBOLS)[to]
    table, of = member.T @ bigrams @ member, to[symbol[:-1]]
    for k in range(ROUNDS if len(counts) else 0):
        to = _exchanged(coded, of, table, k > 0)
        changed = _bigrams(coded, np.append(to, TAIL), SYMBOLS, END)
        if k and likelihood(changed) < likelihood(table):  # tasks do not see each other's moves
            break
        of, table = to, changed
    return of, table


class Model:
    """What scoring needs, bounded by HEAD and SYMBOLS.

    of: class of each head word; table: class bigrams; counts: of the head's words; texts, tokens, types: of the training
    texts, ends included; tail_tokens, tail_types: of the words outside the head; once, twice: words seen so often.
    """

    def __init__(self, of: np.ndarray, table: np.ndarray, counts: np.ndarray, texts: int, tokens: int, types: int, once: int, twice: int):
        self.of, self.texts, self.tokens = of, texts, tokens
        overall = (table.sum(axis=0) + 1) / (table.sum() + SYMBOLS)
        self.step = np.log10((table + BACK_OFF * overall) / (table.sum(axis=1, keepdims=True) + BACK_OFF))
        mass = np.bincount(of, counts, SYMBOLS) if len(of) else np.zeros(SYMBOLS)
        self.emit = np.append(np.log10(counts / mass[of]), 0.0)  # the tail's emissions come later
        self.known = np.append(np.log10(counts + 1.0), 0.0)
        self.tail_tokens, self.tail_types = tokens - texts - int(counts.sum()), types - (texts > 0) - len(counts)
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
        # an unknown word has what the discount frees, and one place more
        self.tail = math.log10(self.tail_tokens + 1)
        self.unknown = math.log10(self.discount * self.tail_types + 1)
        self.all = math.log10(tokens + types + 1)


_SCORED = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends, symbol = math.log10(model.texts + 1), np.append(model.of, TAIL)
    for batch in batches:
        codes, upto = _codes(batch)
        line = _line(symbol[codes], upto)
        steps = np.concatenate([[0], np.cumsum(model.step[line[:-1], line[1:]])])
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
        tail_n = sums(codes < 0)
        score = np.diff(steps[upto + np.arange(len(upto))]) + sums(model.emit[codes]) + (model.unknown - model.tail) * tail_n
        n = np.diff(upto) + 1
        base = sums(model.known[codes]) + ends - n * model.all
        known = n - 1 - tail_n + (model.texts > 0)
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], batch["held_out"], pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], _SCORED)


def train(rows: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows that are not held_out, the counts (word, n) of the words outside its head, and all rows as codes. rows: rid, doc_id, held_out, text."""
    texts = rows.filter("not held_out").select("text")
    counts = scratch.keep(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    tokens, types, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).head()
    # the least count in the head, by steps of a sixteenth of an octave
    steps = sorted(counts.filter("n > 1").groupBy(F.floor(F.log2("n") * 16).alias("step")).count().collect(), reverse=True)
    least, room = None, HEAD
    for step, n in steps:
        room -= n
        if room < 0:
            break
        least = step
    in_head = F.lit(False) if least is None else (F.col("n") > 1) & (F.floor(F.log2("n") * 16) >= least)
    found = counts.filter(in_head).toArrow()  # at most HEAD rows
    keys, n = found["word"].to_numpy().view(U), found["n"].to_numpy()
    order = keys.argsort()
    keys, n = keys[order], n[order]

    head = rows.sparkSession.sparkContext.broadcast(Head(keys))
    coded = scratch.keep(rows.mapInArrow(lambda batches: _coder(head.value, batches), _CODED), "coded")
    own = coded.filter("not held_out")
    documents = own.count()
    of, table = clustered(own, n)
    return Model(of, table, n, documents, tokens + documents, types + (documents > 0), once, twice), counts.filter(~in_head), coded


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; those with crc32(doc_id) mod 7 = 2 are held out of training."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    held = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].cast("string").alias("text"))
    model, rest, coded = train(rows, scratch)
    shared = spark.sparkContext.broadcast(model)

    kind = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    parts = coded.select("rid", "doc_id", "held_out", "codes").mapInArrow(lambda batches: _scored(shared.value, batches), kind)
    tail = coded.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    own = F.log10(F.col("n") - F.lit(model.discount)) - F.lit(model.unknown)
    tail = tail.join(rest, "word").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("base_more"), F.sum(F.col("times") * own).alias("more"), F.sum("times").alias("found"))
    out, more = parts.join(tail, "rid", "left"), lambda x: F.coalesce(x, F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"), (F.col("base") + more("base_more")).alias("base_score"), (F.col("score") + more("more")).alias("score"))
