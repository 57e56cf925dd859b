"""Collocations, centroid clustering and BPE against brute force, and their odd tables."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe, centroids, collocations as C, queries

MODEL = public_tokenizers.path("byte_bpe_50k.json")


# ---- collocations


def brute(rows, least, longest, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] = counts.get((lang, tuple(words[i : i + k])), 0) + 1
    often = {x: f for x, f in counts.items() if f >= least}
    out = {}
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        if any(l2 == lang and len(v) > len(w) and f * 100 >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (l2, v), f in often.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (often[lang, w[:c]] * often[lang, w[c:]]), c, often[lang, w[:c]], often[lang, w[c:]]) for c in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, some in out.items() for k, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(k, lang, text, 7, 8, "x") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, k long, f long, phrase string")
    return sorted(map(tuple, C.collocations(docs, **more).collect()))


def test_collocations_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = ["New", "york", "city", "of", "THE", "a", "é", "日本", "\x0bx", "b c"] + [f"w{k}" for k in range(40)]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0c"]
    text = lambda n: "".join(w + r.choice(gaps) for w in r.choices(words, k=n, weights=[30, 30, 20, 20, 20] + [3] * 45))
    rows = [(r.choice(["en", "de", None, "und"]), text(r.randrange(200))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("fr", " .. \n"), ("en", rows[0][1]), ("en", rows[0][1]), ("de", "no gap between pieces,at all.no gap"), ("long", text(20_000))]
    monkeypatch.setattr(C, "SLAB", 500)  # slabs, and texts that go over several
    monkeypatch.setattr(C, "MEMO", 20)
    want = brute(rows, 6, 5, 25)
    assert len(want) > 60 and mined(spark, rows, least=6, top=25) == want
    monkeypatch.setattr(C, "HELD", 50)
    for width in (64, 1 << 12):  # cells shared by nearly all runs: the exact count decides
        assert mined(spark, rows, least=6, top=25, width=width) == want


def test_collocations_of_odd_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, " ")]) == []
    got = mined(spark, [(None, "a b " * 100)])
    assert got == brute([(None, "a b " * 100)], 100, 5, 2000) and got[0][0] == "und"
    assert mined(spark, [("x", "q " * 300)] * 2) == brute([("x", "q " * 300)] * 2, 100, 5, 2000)
    huge = spark.createDataFrame([("x", 1, "a", 10**13), ("x", 1, "b", 10**13), ("x", 2, "a b", 10**13 - 1), ("x", 0, "", 4 * 10**14)], "lang string, k int, phrase string, f long")
    assert C.scored(huge).head().score == 1000 * (10**13 - 1) * 4 * 10**14 // 10**26  # products of 96 bits


# ---- centroids


def clustered(vectors, clusters=4, rounds=3):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    start = sorted(kept, key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))[:clusters]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), k) for k, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, k in last if k == j) for j in range(len(c))]
    return sorted((i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, last))


def test_centroids_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(3 * (k % 5), 1 + k % 3) for _ in range(64)]) for k in range(300)]
    rows += [(k + 1000, rows[k][1]) for k in range(40)] + [(5, rows[9][1]), (6, [0.0] * 63), (7, [0.0] * 65), (8, None), (9, [None] + [0.0] * 63), (10, [float("nan")] + [0.0] * 63), (11, [float("inf")] + [0.0] * 63), (12, [-0.001] * 64)]
    docs = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], "vec_id long, embedding array<float>, cluster int, v int, distance int")
    for clusters in (4, 40):
        assert sorted(map(tuple, centroids.cluster(docs, clusters=clusters, rounds=3).collect())) == clustered(rows, clusters)


def test_centroids_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    few = [(1, [1.0] * 64), (1, [1.0] * 64), (None, [1e30] * 64)]
    got = centroids.cluster(spark.createDataFrame(few, schema)).collect()
    assert len(got) == 3 and {x.distance for x in got} == {0} and {x.cluster for x in got if x.vec_id == 1} == {0}


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    c = np.array([[0], [4], [-4], [9]])
    number, d = centroids.nearest(np.array([[2], [-2], [5], [0]]), np.array([1, 2, 3, 0]), c)
    assert number.tolist() == [0, 0, 1, 0] and d.tolist() == [4, 4, 1, 0]  # a tie at exactly twice the distance goes to number 0


# ---- BPE

PIECES = ["the ", "lower case words ", "don't ", "'re", "  ", "\n", "\n\n ", "   x", "<|endoftext|>", "<|endof", "text|>", "日本語", "é́", "😀", "1234567", "...", " ", "　", "\x85", "\x1c", "\ta", "_", "\r\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.lists(st.integers(1, 40), max_size=40))
def test_joins_are_repaired_wherever_the_text_is_cut(parts, lengths):
    text, cut, at = "".join(parts), [], 0
    for n in lengths:
        cut.append(text[at : at + n])
        at += n
    cut = [x for x in [*cut, text[at:]] if x]
    own = bpe.codec(open(MODEL, encoding="utf-8").read())
    assert bpe.joined([cut], [own.encode(cut)], own) == [own.tokenizer.encode(text, add_special_tokens=False).ids]


def test_encoding_equals_whole_texts(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["alpha", "beta's", "gam\tma", "1999", "ünder", "x" * r.randrange(1, 9)]) + r.choice(["", ".", ",\n", "  "]) for _ in range(n))
    passage = prose(600)
    texts = [prose(r.randrange(900)) for _ in range(30)] + [prose(50) + passage + prose(50) for _ in range(8)] + [passage] * 5 + [passage + passage]
    texts += [None, "", " ", "x" * 30_000, "日本語" * 9000, " " * 20_000, "a<|endoftext|> b" * 900, "\n" * 9000, "".join(r.choice(PIECES) for _ in range(5000))]
    docs = spark.createDataFrame([(None if k == 3 else k % 50, t, 1, 2, "z") for k, t in enumerate(texts)], "doc_id long, text string, k1 long, c1 long, ids string").repartition(5)
    whole = Tokenizer.from_file(MODEL)
    want = sorted((t or "", whole.encode(t or "", add_special_tokens=False).ids) for t in texts)
    got = bpe.encode(docs, MODEL).collect()
    assert sorted((x.decoded, x.ids) for x in got) == want and sorted(-1 if x.doc_id is None else x.doc_id for x in got) == sorted(-1 if k == 3 else k % 50 for k in range(len(texts)))
    digest = bpe.encode(docs, MODEL, bpe.digests, bpe.DIGESTS).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in digest) == sorted((len(i), sha(",".join(map(str, i))), sha(t)) for t, i in want)
    assert bpe.encode(docs.limit(0), MODEL).collect() == []
    back = bpe.decode(spark.createDataFrame([(1, want[-1][1]), (2, []), (3, None)], "n int, ids array<int>"), MODEL).collect()
    assert [(x.n, x.decoded) for x in back] == [(1, want[-1][0]), (2, ""), (3, None)]


def test_shared_chunks_are_cut_alike():
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh .,") for _ in range(20_000))
    a, b = (bpe.chunks("".join(r.choice("klmn ") for _ in range(n)) + passage) for n in (3000, 4567))
    assert len(set(a) & set(b)) >= 8 and "".join(a).endswith(passage) and max(map(len, a)) <= bpe.MOST and min(map(len, a[:-1])) >= bpe.LEAST
    long = "".join(r.choice("abcdefgh .,") for _ in range(bpe.BLOCK + 5000))
    assert "".join(bpe.chunks(long)) == long and bpe.chunks(long)[-3:] == bpe.chunks(long[: len(long)])[-3:]


def test_both_encoders_agree_on_every_character_and_token():
    own = bpe.codec(open(MODEL, encoding="utf-8").read())
    assert own.plain is not None
    whole = lambda xs: [x.ids for x in own.tokenizer.encode_batch_fast(xs, add_special_tokens=False)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{0}a1{0}1.{0}.", "  {0} x {0}{0}a\n{0}"):  # how it groups with letters, digits, marks and white space
        for k in range(0, len(every), 200_000):
            xs = [form.format(c) for c in every[k : k + 200_000]]
            assert whole(xs) == [own.plain.encode_ordinary(x) for x in xs]
    # where every token's own text is encoded as that token, the pair of least rank is always a merge
    assert all(len(own.tokenizer.model.tokenize(x)) == 1 for x in own.tokenizer.get_vocab(with_added_tokens=False))
    ascii_ = [chr(c) for c in range(128)]
    for a in "a 1'.\n\t\x1c":
        xs = [a + b + c for b in ascii_ for c in ascii_]
        assert whole(xs) == [own.plain.encode_ordinary(x) for x in xs]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.check(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    bpe.check(json.dumps(json.load(open(MODEL, encoding="utf-8"))))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_queries_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole, sha = Tokenizer.from_file(MODEL), lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {k: whole.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    want = {k: (len(i), sha(",".join(map(str, i))), sha(whole.decode(i, skip_special_tokens=False))) for k, i in ids.items()}
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in queries.op13_bpe(spark, sf).collect()} == want
    assert sum(len(bpe.chunks(t)) for t in texts.values()) > len(texts)
