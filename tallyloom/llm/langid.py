"""Language of documents by Bayesian fusion of what the text, the declared language, the address and the host say.

1. Text: a naive Bayes model of hashed letter trigrams, fitted on about FIT_DOCS documents of each language, chosen by
   hash, with their declared languages as (noisy) labels: the primary part of the declared value, in lower case ("en" of
   "EN-us"); values of another form declare nothing. Every one of LANGUAGES that LEAST_DOCS documents declare is a class, so
   that noise in declared values makes none. Its log-likelihoods, times TEMPER since trigrams overlap, are the likelihoods of
   each document, of which the whole text counts. One more class, "und", gives all trigrams the same probability.
2. Declared markup language and address suffix: P(value | language) from the text posteriors summed by value.
3. Host: P(language | host), smoothed towards its registered domain, and that towards all documents, from text
   posteriors summed by host and domain. A document's own share is left out of all sums that judge it.

The host may be any name of where documents come from (in the tables the column source). Where no suffix is given, it is
what follows the last dot of the host, if those are letters.

A document carries the classes that can still win only: those whose text likelihood is within REACH of the best; what all
priors can add is far less. The sums are partial aggregations by value and class, joined back; a hot host is one row of sums and its documents are split by
Spark. Defined results: rejected ("und") are documents without a letter (null and empty texts too), those that "und"
explains best, and those whose best language has a posterior under LEAST. Of languages with equal posteriors the first by
code wins. A null declared language, suffix or host gives no evidence. Null or repeated doc_ids are judged like others,
texts of any length as a whole. No language with LEAST_DOCS labelled documents: all is "und". No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.shingles import buffers, slices

FIT_DOCS = 5_000
LEAST_DOCS = 5
BUCKETS = 1 << 16
TEMPER = 0.25
LEAST = 0.5
PSEUDO = 2.0
UNKNOWN_PRIOR = 1e-3
REACH = 100.0  # of natural logarithms
FAINT = 1e-9  # posteriors under this are not summed
UNSEEN = 0.02  # of a language's trigrams are as likely as those of "und"


# fixed values: two-letter language codes in use, and three-letter ones of languages that have no such code
LANGUAGES = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky "
    "la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu "
    "ast ceb fil haw hmn hsb nds sah yue".split()
)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram that holds a letter, in turn, and for each text the number of those before it. Letters: a-z, A-Z lower-cased, and all bytes of other than ASCII characters; all else, and what lies before and after a text, is one kind of gap."""
    texts = len(offsets) - 1
    low = data | np.where((data - np.uint8(65)) < 26, np.uint8(32), np.uint8(0))
    code = np.full(len(data) + texts + 1, 32, np.uint32)
    code[np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = np.where(((low - np.uint8(97)) < 26) | (data > 127), low, np.uint8(32))
    letter = code != 32
    joined = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    good = letter[:-2] | letter[1:-1] | letter[2:]
    starts = offsets + np.arange(1, texts + 2)  # of the texts in code; the gaps between them lie one before
    good[starts[1:-1] - 2] = False
    places = np.flatnonzero(good)
    return (joined[places] >> np.uint32(16)).astype(np.int32), np.searchsorted(places + 1, starts)


def primary(declared: Column) -> Column:
    """The primary language of a declared value, two or three letters, in lower case; null if it has another form."""
    return F.nullif(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9_-]*)?\s*$", 1)), F.lit(""))


def _languages(docs: DataFrame, known: Collection[str]) -> dict[str, int]:
    """Documents by language, for those of the known ones that LEAST_DOCS and more declare."""
    found = docs.filter(F.col("code").isin(*sorted(known))).groupBy("code").count().filter(F.col("count") >= LEAST_DOCS)
    return dict(sorted(tuple(x) for x in found.collect()))


def fit_text(docs: DataFrame, languages: dict[str, int]) -> np.ndarray:
    """log P(bucket | language) as float32 [BUCKETS, languages + 1], "und" last. docs: doc_id, text, code; languages: documents of each."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            offsets, data = buffers(batch["text"])
            label = [index[x] for x in batch["code"].to_pylist()]
            for first, last in slices(offsets):
                own = offsets[first : last + 1]
                found, upto = trigrams(data[own[0] : own[-1]], own - own[0])
                owner = np.repeat(np.array(label[first:last], np.int64), np.diff(upto))
                keys, n = np.unique(owner * BUCKETS + found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys // BUCKETS).astype(np.int32)), pa.array((keys % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "bucket", "n"])

    share = docs.sparkSession.createDataFrame([(x, int(min(1.0, FIT_DOCS / n) * (1 << 20))) for x, n in languages.items()], "code string, share int")
    chosen = docs.join(F.broadcast(share), "code").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 20)) < F.col("share")).select("text", "code")
    counts = chosen.mapInArrow(counted, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages) + 1), 0.5)  # the trigrams of FIT_DOCS documents a language
    found = counts.toArrow()
    table[found["bucket"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    table = (1 - UNSEEN) * table / table.sum(axis=0) + UNSEEN / BUCKETS
    table[:, -1] = 1 / BUCKETS
    return np.log(table).astype(np.float32)


def text_likelihoods(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """The columns of docs but the text, n (trigrams with a letter), and of the classes within REACH k, their numbers, ll, the tempered log-likelihoods, and own, the posteriors by the text alone (all 0 without a letter)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [x for x in docs.columns if x != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            offsets, data = buffers(batch["text"])
            n, ll = [np.zeros(0, np.int64)], [np.zeros((0, table.shape[1]))]
            for first, last in slices(offsets):
                own = offsets[first : last + 1]
                found, upto = trigrams(data[own[0] : own[-1]], own - own[0])
                sums = np.zeros((last - first, table.shape[1]))
                some = np.flatnonzero(np.diff(upto))
                if len(some):
                    sums[some] = np.add.reduceat(table[found], upto[:-1][some], axis=0, dtype=np.float64)
                n.append(np.diff(upto))
                ll.append(sums)
            count, flat = np.concatenate(n), TEMPER * np.concatenate(ll)
            prior = np.zeros(flat.shape[1])
            prior[-1] = np.log(UNKNOWN_PRIOR)
            own = softmax(flat + prior) * (count > 0)[:, None]
            near = flat >= flat.max(axis=1, keepdims=True) - REACH
            at = pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (np.nonzero(near)[1].astype(np.int16), flat[near], own[near])]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in keep), pa.array(count), *lists], [*keep, "n", "k", "ll", "own"])

    kinds = ", ".join(f"{x} {docs.schema[x].dataType.simpleString()}" for x in keep)
    return docs.mapInArrow(scored, f"{kinds}, n long, k array<smallint>, ll array<double>, own array<double>")


def softmax(logs: np.ndarray) -> np.ndarray:
    out = np.exp(logs - logs.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _shares(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, k, s): the text posteriors summed by value and class."""
    each = rows.select(*keys, F.explode(F.arrays_zip("k", "own")).alias("x")).filter(F.col("x.own") >= FAINT)
    return each.groupBy(*keys, F.col("x.k").alias("k")).agg(F.sum("x.own").alias("s"))


def _sums(rows: DataFrame, key: str) -> DataFrame:
    """(key, key_k, key_s): the sums of a value, at most one a class."""
    sums = _shares(rows.filter(F.col(key).isNotNull()), key).groupBy(key).agg(F.collect_list(F.struct("k", "s")).alias("x"))
    return sums.select(key, F.col("x.k").alias(f"{key}_k"), F.col("x.s").alias(f"{key}_s"))


def _dense(k: pa.Array, values: pa.Array, size: int, rest: np.ndarray | float = 0.0) -> np.ndarray:
    """[row, class] of lists of classes and their values; rest where a class is not listed. Null lists are empty."""
    lengths = np.diff(k.offsets.to_numpy())  # a null list has no length
    out = np.zeros((len(k), size)) + rest
    own = k.values.to_numpy(zero_copy_only=False)[k.offsets[0].as_py() : k.offsets[-1].as_py()]
    out[np.repeat(np.arange(len(k)), lengths), own] = values.values.to_numpy(zero_copy_only=False)[values.offsets[0].as_py() : values.offsets[-1].as_py()]
    return out


def registered_domain(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, known: Collection[str] = LANGUAGES) -> DataFrame:
    """doc_id, declared, lang ("und" if rejected), posterior, n_trigrams and accepted of every document. known: the codes that may be classes."""
    scratch = Scratch(docs.sparkSession, "langid")
    column = lambda x, name: (F.lit(None) if x is None else docs[x]).cast("string").alias(name)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), column(text, "text"), column(declared, "declared"), column(host, "host"), column(suffix, "suffix"))
    ending = F.lower(F.nullif(F.regexp_extract("host", r"\.([A-Za-z]+)$", 1), F.lit("")))
    rows = rows.withColumns({"code": primary(F.col("declared")), "suffix": F.lower("suffix") if suffix else ending})
    languages = _languages(rows, known)
    model = fit_text(rows, languages)
    size = len(languages) + 1
    scored = scratch.keep(text_likelihoods(rows, model), "likelihoods").withColumn("domain", registered_domain(F.col("host")))

    total = np.zeros(size)
    for k, mass in _shares(scored).collect():  # one row a class
        total[k] = mass
    for key in ("code", "suffix", "domain", "host"):
        scored = scored.join(_sums(scored, key), key, "left")
    names = [*languages, "und"]

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = _dense(batch["k"], batch["own"], size)
            logs = _dense(batch["k"], batch["ll"], size, -np.inf)
            logs = np.where(np.isinf(logs), logs.max(axis=1, keepdims=True) - REACH, logs)
            left = {x: np.maximum(_dense(batch[f"{x}_k"], batch[f"{x}_s"], size) - own, 0) for x in ("code", "suffix", "domain", "host")}
            everywhere = np.maximum(total - own, 0)
            prior = (everywhere + PSEUDO / size) / (everywhere.sum(axis=1, keepdims=True) + PSEUDO)
            share = prior
            for x in ("domain", "host"):
                prior = (left[x] + PSEUDO * prior) / (left[x].sum(axis=1, keepdims=True) + PSEUDO)
            prior[:, -1] = UNKNOWN_PRIOR
            logs += np.log(prior)
            for x in ("code", "suffix"):  # P(value | language) is P(language | value) / P(language) but for a factor
                given = (left[x] + PSEUDO * share) / (left[x].sum(axis=1, keepdims=True) + PSEUDO) / share
                given[:, -1] = 1
                logs += np.where(np.array(batch[x].is_valid())[:, None], np.log(given), 0)
            after = softmax(logs)
            best, n = after.argmax(axis=1), batch["n"].to_numpy()
            top = after[np.arange(len(best)), best]
            good = (n > 0) & (best < size - 1) & (top >= LEAST)
            lang = [names[k] if ok else "und" for k, ok in zip(best, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["declared"], pa.array(lang, pa.string()), pa.array(np.where(n > 0, top, 0.0)), batch["n"], pa.array(good)], ["doc_id", "declared", "lang", "posterior", "n_trigrams", "accepted"])

    return scored.mapInArrow(fused, "doc_id long, declared string, lang string, posterior double, n_trigrams long, accepted boolean")
