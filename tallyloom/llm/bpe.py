"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last 32 characters has its highest bits zero, so that equal passages of different
texts are cut alike. Chunks that stand in two or more different texts are encoded once: the text with the least hash of
those encodes it, and its ids travel to the others. All other chunks are encoded with their text. The ids of chunks do not
simply add up, as a token or a pre-token may lie across a join. So each join is repaired (joined()): a window around it is encoded
again, from a white space in the one chunk to one in the other, with one more word on each side. Where the window's ids
begin and end with the ids that the chunks themselves have for those words, the join is in exact agreement; else the
window takes in the whole chunks and is encoded again. A break before white space parts pre-tokens whatever surrounds it, for
every tokenizer that lets a pre-token have white space at its beginning only; others are refused (check()).

Texts go by two 64-bit hashes of theirs. Equal texts are encoded once and meet no more than once a task; texts travel compressed,
in one shuffle; which chunks are shared follows from counts of hashes, and only ids of shared chunks travel besides. What
a document needs of them is at most its own ids.

Defined results: null is the empty text, without ids; the decoded text of a well-formed text is that text. Rows with equal texts
have equal results, repeated rows and null doc_ids are rows like others; no order decides anything. No rows, no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.llm.scratch import Scratch

LEAST, MOST = 256, 8192  # characters of a chunk; a text's last may be shorter
BITS = 10  # zero bits at a cut: on average 2 ** BITS characters after the least
WINDOW = 32
BLOCK = 1 << 20  # characters that are hashed at once
SLICE = 1 << 21  # characters of texts that a task encodes at once

# fixed value: how byte-level BPE splits text before it merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CODECS: dict[str, Codec] = {}

Finish = Callable[[list[list[int]], "Codec"], list[pa.Array]]


def _rolling(codes: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW characters that end at each character."""
    h = codes * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    width = 1
    while width < WINDOW:  # a window twice as wide is two of these, the earlier one shifted
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text."""
    found = []
    for at in range(0, len(text), BLOCK):
        start = max(0, at - WINDOW)
        h = _rolling(np.frombuffer(text[start : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32))
        found.append(np.flatnonzero(h[at - start :] >> np.uint32(32 - BITS) == 0) + at + 1)
    marks = np.concatenate(found) if found else np.zeros(0, int)
    ends, end = [], 0
    while end < len(text):
        k = int(np.searchsorted(marks, end + LEAST))
        end = min(len(text), end + MOST, int(marks[k]) if k < len(marks) else len(text))
        ends.append(end)
    return ends


def chunks(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def named(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """texts in lists of about SLICE characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _byte_of() -> dict[str, int]:
    """The byte of each character that stands for one in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}


def _ranks(parts: dict) -> dict[bytes, int]:
    of, added = _byte_of(), {x["content"] for x in parts["added_tokens"]}
    return {bytes(of[c] for c in token): k for token, k in parts["model"]["vocab"].items() if token not in added}


def _same_merges(parts: dict) -> bool:
    """Whether ids are the ranks of merges: then merging the pair whose token has the least id is the same as following the merges."""
    vocab, merges = parts["model"]["vocab"], parts["model"]["merges"]
    made = [vocab.get("".join(x if isinstance(x, list) else x.split(" "))) for x in merges]
    return made == list(range(256, 256 + len(made))) and sorted(vocab.values())[:256] == list(range(256)) and all(k in _byte_of() for k, v in vocab.items() if v < 256)


class Codec:
    """A tokenizer in a task. Text without added tokens goes through a faster implementation of the same split and the same merges, where _same_merges() finds ids to be ranks; tests compare both for every character and every token."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.numbers = list(map(str, range(self.size)))
        parts = json.loads(model)
        self.added = [x["content"] for x in parts["added_tokens"]]
        self.plain = _same_merges(parts) and tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=_ranks(parts), special_tokens={}) or None
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.plain is None:
            return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = [self.plain.encode_ordinary(x) if not any(y in x for y in self.added) else None for x in texts]
        others = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(others, self.tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False) if others else (), strict=True):
            out[k] = x.ids
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def pack(self, ids: list[int]) -> bytes:
        return zstandard.compress(np.array(ids, self.kind).tobytes())

    def unpack(self, packed: bytes) -> list[int]:
        return np.frombuffer(zstandard.decompress(packed), self.kind).tolist()


def codec(model: str) -> Codec:
    key = hashlib.md5(model.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def check(model: str) -> None:
    """ValueError for a tokenizer whose text is normalised, or whose pre-tokens may have white space elsewhere than at their beginning."""
    parts = json.loads(model)
    pre = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") for x in parts.get("added_tokens", [])):
        raise ValueError("only byte-level BPE without normalizer or prefix space is encoded in chunks")


def _breaks(chunk: str) -> tuple[int, int, int, int] | None:
    """Two places before white space from the left, and two from the right, in order; None if the chunk has fewer than that. Only a space after a character that is certainly none counts."""
    left, at = [], 0
    while len(left) < 2:
        at = chunk.find(" ", at + 1)
        if at < 0:
            return None
        if "!" <= chunk[at - 1] <= "~":
            left.append(at)
    right, at = [], len(chunk)
    while len(right) < 2:
        at = chunk.rfind(" ", 1, at)
        if at < left[1]:
            return None
        if "!" <= chunk[at - 1] <= "~":
            right.append(at)
    return left[0], left[1], right[1], right[0]


def joined(texts: list[list[str]], ids: list[list[list[int]]], own: Codec) -> list[list[int]]:
    """The ids of each text from its chunks and theirs. See the module's text."""
    whole: list[list[int] | None] = [x[0] if len(x) == 1 else [] if not x else None for x in ids]
    inner = {}  # (text, chunk): its breaks, and how many ids there are before and after the outer two words
    asked = []
    for t, parts in enumerate(texts):
        if whole[t] is None:
            for k, part in enumerate(parts):
                if at := _breaks(part):
                    inner[t, k] = at
                    asked += [part[: at[0]], part[at[0] : at[1]], part[at[2] : at[3]], part[at[3] :]]
    if asked:
        got = iter(own.encode(asked))
        for (t, k), at in list(inner.items()):
            head, first, last, tail = next(got), next(got), next(got), next(got)
            mine = ids[t][k]
            if mine[: len(head) + len(first)] == head + first and mine[len(mine) - len(last) - len(tail) :] == last + tail:
                inner[t, k] = at, len(head), first, last, len(tail)
            else:
                del inner[t, k]
    open_texts = [t for t, x in enumerate(whole) if x is None]
    while open_texts:
        windows, plans = [], {}
        for t in open_texts:
            parts = texts[t]
            fixed = [k for k in range(len(parts)) if (t, k) in inner]
            plans[t] = fixed
            for a, b in zip([None, *fixed], [*fixed, None]):
                before = "" if a is None else parts[a][inner[t, a][0][2] :]
                after = "" if b is None else parts[b][: inner[t, b][0][1]]
                windows.append(before + "".join(parts[0 if a is None else a + 1 : len(parts) if b is None else b]) + after)
        got = iter(own.encode(windows))
        again = []
        for t in open_texts:
            out, fine = [], True
            fixed = plans[t]
            for a, b in zip([None, *fixed], [*fixed, None]):
                window = next(got)
                last, first = [] if a is None else inner[t, a][3], [] if b is None else inner[t, b][2]
                agrees = len(window) >= len(last) + len(first) and window[: len(last)] == last and window[len(window) - len(first) :] == first
                if not agrees:
                    fine = False
                    inner.pop((t, a), None)
                    inner.pop((t, b), None)
                    continue
                if fine:
                    out += window[len(last) : len(window) - len(first)]
                    if b is not None:
                        _, head, _, _, tail = inner[t, b]
                        out += ids[t][b][head : len(ids[t][b]) - tail]
            if fine:
                whole[t] = out
            else:
                again.append(t)
        open_texts = again
    return whole


def digests(ids: list[list[int]], own: Codec) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    name = own.numbers.__getitem__
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return [pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join(map(name, x))) for x in ids]), pa.array(map(sha, own.decode(ids)))]


def both(ids: list[list[int]], own: Codec) -> list[pa.Array]:
    """ids and decoded."""
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(own.decode(ids), pa.string())]


DIGESTS, BOTH = "n_tokens long, ids_sha256 string, decoded_sha256 string", "ids array<int>, decoded string"


def encode(docs: DataFrame, model: str, finish: Finish = both, schema: str = BOTH) -> DataFrame:
    """doc_id and what finish makes of the ids of each document's text: ids and decoded, or digests.

    model: the path of a tokenizer's JSON file on the driver, which sends it to the tasks (a few MB).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    with open(model, encoding="utf-8") as file:
        source = file.read()
    check(source)
    shared_model = spark.sparkContext.broadcast(source)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"], text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("other"), text).alias("k2"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array([zstandard.compress(x.encode()) for x in batch["text"].to_pylist()], pa.binary())], ["k1", "k2", "z"])

    def named_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = [{named(x) for x in chunks(t)} for t in batch["text"].to_pylist()]
            n = np.fromiter(map(len, per), int, len(per))
            pairs = np.frombuffer(b"".join(x for some in per for x in some), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch[k].to_numpy(), n)) for k in ("k1", "k2")] + [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["k1", "k2", "c1", "c2"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared_model.value)
        for batch in batches:
            wanted, texts = [], []
            for z, names in zip(batch["z"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                mine = {np.array([x["c1"], x["c2"]], "<i8").tobytes() for x in names}
                for part in chunks(zstandard.decompress(z).decode()):
                    if (name := named(part)) in mine:
                        mine.remove(name)
                        wanted.append(name)
                        texts.append(part)
            pairs = np.frombuffer(b"".join(wanted), "<i8").reshape(-1, 2)
            ids = pa.array([own.pack(x) for some in _slices(texts) for x in own.encode(some)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)] + [ids], ["c1", "c2", "ids"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared_model.value)
        for batch in batches:
            at = 0
            for some in _slices(zstandard.decompress(z.as_py()).decode() for z in batch["z"]):
                rows = batch.slice(at, len(some))
                at += len(some)
                texts, ids, missing = [], [], {}
                for text, known in zip(some, rows["known"].to_pylist(), strict=True):
                    found = {np.array([x["c1"], x["c2"]], "<i8").tobytes(): x["ids"] for x in known or ()}
                    parts = chunks(text)
                    texts.append(parts)
                    ids.append([own.unpack(found[name]) if found and (name := named(x)) in found else missing.setdefault(x, None) for x in parts])
                missing = dict(zip(missing, own.encode(list(missing)), strict=True))
                ids = [[missing[x] if i is None else i for x, i in zip(parts, mine, strict=True)] for parts, mine in zip(texts, ids, strict=True)]
                out = finish(joined(texts, ids, own), own)
                yield pa.RecordBatch.from_arrays([rows["k1"], rows["k2"], *out], [f"c{k}" for k in range(2 + len(out))])

    # keys that are never null, so that both joins below have the same plan beneath them and the texts are shuffled once
    texts = rows.select("k1", "k2", "text").mapInArrow(packed, "k1 long not null, k2 long not null, z binary").groupBy("k1", "k2").agg(F.first("z").alias("z"))
    # a chunk is shared if the least and the greatest hash of the texts that have it differ
    stands = scratch.keep(rows.select("k1", "k2", "text").mapInArrow(named_chunks, "k1 long, k2 long, c1 long, c2 long").distinct(), "chunks")
    shared = stands.groupBy("c1", "c2").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).filter("first <> last").select("c1", "c2", "first")
    need = scratch.keep(stands.join(shared, ["c1", "c2"]).select("k1", "k2", "c1", "c2", (F.col("k1") == F.col("first")).alias("here")), "shared")
    wanted = need.filter("here").groupBy("k1", "k2").agg(F.collect_list(F.struct("c1", "c2")).alias("wanted"))
    codes = texts.join(wanted, ["k1", "k2"]).select("z", "wanted").mapInArrow(encoded, "c1 long, c2 long, ids binary")
    known = need.select("k1", "k2", "c1", "c2").join(codes, ["c1", "c2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("c1", "c2", "ids")).alias("known"))
    done = texts.join(known, ["k1", "k2"], "left").mapInArrow(assembled, f"k1 long, k2 long, {schema}")
    return rows.select("doc_id", "k1", "k2").join(done, ["k1", "k2"]).drop("k1", "k2")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows (ids array<int>) with decoded, the text of their ids, special tokens included; null where ids is null."""
    with open(model, encoding="utf-8") as file:
        shared_model = rows.sparkSession.sparkContext.broadcast(file.read())
    n = len(rows.columns)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared_model.value)
        for batch in batches:
            ids = batch["ids"].to_pylist()
            texts = [None if x is None else y for x, y in zip(ids, own.decode([x or [] for x in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [f"c{k}" for k in range(n + 1)])

    return rows.mapInArrow(decoded, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
