"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import brown, decontam, langid, media, mixing, neardup, pii, sharding, urlfilter, warc
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.shingles import shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, size string, target string, n string, h int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y", "z", "w", 7) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 60)
    changed = base.replace(base.split()[30], "other", 1)
    out = [(0, base, "en", "a"), (1, base, "en", "a"), (2, changed, "en", None), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "de", "b"), (6, "one two", "de", "b"), (7, "One\ttwo", "de", "b")]
    out += [(10 + k, prose(100 + k, 5 + 7 * k), "en" if k % 3 else "fr", f"s{k % 4}") for k in range(20)]
    out += [(50, prose(7, 20_000), "en", "a"), (51, "é" * 300 + " ÀB c", "fr", "b"), (8, prose(3, 4), "en", "c"), (9, "\x00 weird 🙂 text " * 3, "en", "c")]
    return out


def sets_of(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").translate(urlfilter._LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def exact_components(rows):
    sets, label = {i: sets_of(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}
    ids = sorted(sets)
    for _ in ids:
        moved = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
        if not moved:
            break
    return sets, label


def test_words_and_shingles_match_plain_python():
    texts = ["A b c D e f", "", "x", None, "a  b\tc\nd\re\x0bf\x0c", "é É ß", "end", "end"]
    column = pa.array(texts)
    got = [len(x) for x in shingle_sets(column)]
    assert got == [len(sets_of(x)) for x in texts]
    found = list(shingle_sets(pa.array(["one two three", "ONE  two\nthree", "one two"])))
    assert found[0].tolist() == found[1].tolist() != found[2].tolist()
    data = np.frombuffer(b"ab cab", np.uint8)
    words, upto = word_hashes(data, np.array([0, 4, 6]))
    assert upto.tolist() == [0, 2, 3] and words[0] == words[2] and words[0] != words[1]


def test_near_duplicates_match_all_pairs(spark, rows):
    r = random.Random(5)
    more = list(rows)
    for k in range(40):  # chains of copies, each a little further from the first
        words = prose(900 + k // 8, 40).split()
        for _ in range(k % 8):
            words[r.randrange(40)] = f"new{r.randrange(5)}"
        more.append((1000 + k, " ".join(words), "en", "c"))
    sets, label = exact_components(more)
    got = {x.doc_id: x for x in neardup.near_duplicates(table(spark, more)).collect()}
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_of_odd_tables(spark, rows):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.near_duplicates(table(spark, [(None, "a b c d e", "en", "a")])).count() == 0
    twice = neardup.near_duplicates(table(spark, [rows[0], rows[0], rows[1]])).collect()
    assert sorted((x.doc_id, x.component_id) for x in twice) == [(0, 0), (0, 0), (1, 0)]


def test_blocks_find_what_hubs_miss():
    sets = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4, 6], [9, 10])]
    side = [{"node": k, "comp": k, "found": x.tobytes()} for k, x in enumerate(sets)]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("comp", pa.int64()), ("found", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([side], kind), pa.array([side], kind)], ["left", "right"])
    got = {(min(u, v), max(u, v)) for b in neardup._blocks_linked(iter([batch])) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {(0, 2)}


def test_families_of_many_blocks(spark, monkeypatch):
    """Sets near the threshold, some of them very long, in blocks of few bytes: the links of all pairs, each block bounded."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4000)
    r = np.random.default_rng(9)
    sets = {}
    for k in range(60):
        base = np.arange(1, 2001 if k % 15 == 0 else 101, dtype=np.uint64) * np.uint64(2**40 + 7)
        keep = r.random(len(base)) > 0.13
        sets[k] = np.sort(base[keep])
    nodes = spark.createDataFrame([(0 if k % 3 else 1, k, k) for k in sets], "family long, node long, comp long")
    frame = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "node long, found binary")
    got = {(min(u, v), max(u, v)) for u, v in neardup._in_blocks(nodes, frame, Scratch(spark, "t")).collect()}
    want = set()
    for a in sets:
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (a % 3 == 0) == (b % 3 == 0) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                want.add((b, a))
    assert got == want and len(want) > 50


def test_densified_bins_agree_about_as_often_as_sets_overlap():
    r = np.random.default_rng(3)
    same = r.integers(0, 2**63, 30).astype(np.uint64)
    a = np.unique(np.concatenate([same, r.integers(0, 2**63, 5).astype(np.uint64)]) * np.uint64(2))
    b = np.unique(np.concatenate([same, r.integers(0, 2**63, 5).astype(np.uint64)]) * np.uint64(2))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - 0.75) < 0.12


def test_sharding_keeps_equal_texts_together_and_balances(spark, rows):
    docs = table(spark, rows + [(200 + k, prose(k, 3 + k % 50), "en", "a") for k in range(300)] + [(900, "same", "en", "a")] * 5)
    got = sharding.shard_by_bytes(docs, 8).collect()
    text = {i: t or "" for i, t, *_ in rows} | {200 + k: prose(k, 3 + k % 50) for k in range(300)} | {900: "same"}
    assert len(got) == len(rows) + 305
    place, slots, total = {}, defaultdict(list), Counter()
    for x in got:
        assert x.size == len(text[x.doc_id].encode()) + 1 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode())
        assert place.setdefault(text[x.doc_id], x.shard) == x.shard
        slots[x.shard].append(x.slot)
        total[x.shard] += x.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rest = [v for k, v in total.items() if k != place[prose(7, 20_000)]]
    assert max(rest) - min(rest) <= 20
    assert sharding.shard_by_bytes(table(spark, [])).count() == 0


def test_sharding_matches_differencing_by_lists(spark):
    """One bucket: the partial partitions with the largest spread, found by search, are combined until one is left."""
    r = random.Random(31)
    texts = [prose(k, r.randrange(1, 90)) for k in range(120)] + [prose(5, 7)] * 9 + [""] * 4
    half = lambda t, k: int(hashlib.md5(t.encode()).hexdigest()[k : k + 14], 16)
    groups = Counter()
    for t in texts:
        groups[t] += len(t.encode()) + 1
    order = sorted(groups, key=lambda t: (half(t, 0), half(t, 14)))
    nodes = {k: sorted([(groups[t], (t,))] + [(0, ())] * 4, key=lambda x: -x[0]) for k, t in enumerate(order)}
    spread = lambda k: nodes[k][0][0] - nodes[k][-1][0]
    while len(nodes) > 1:
        x, y = sorted(nodes, key=lambda k: (-spread(k), k))[:2]
        joined = [(p[0] + q[0], p[1] + q[1]) for p, q in zip(nodes[x], reversed(nodes[y]), strict=True)]
        nodes[max(nodes) + 1] = sorted(joined, key=lambda p: -p[0])
        del nodes[x], nodes[y]
    want = sorted(x for x, _ in nodes.popitem()[1])
    got = sharding.shard_by_bytes(table(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert sorted(x.n for x in got) == want and want[-1] - want[0] <= 3


def test_differencing():
    sizes = [[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]
    to = sharding.differencing(sizes, 2)[:, 0]
    sums = [sum(x[0] for x, s in zip(sizes, to, strict=True) if s == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]  # the known answer of differencing; greedy packing gives 13 and 17
    assert sharding.differencing([], 3).shape == (0, 3)


def test_warc_round_trip(spark):
    long, other = "<p>" + "x" * 1000, "y" * 1500
    pages = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, None), (4, "http://a/4 \r\nb", "short"), (5, "http://a/5", "short"), (None, "http://a/n", long), (7, "é", other), (7, "é", other)]
    df = spark.createDataFrame([(*x, "c", 3) for x in pages], "page_id long, url string, html string, digest string, offset int")
    index = warc.write_archives(df, Scratch(spark, "t"))
    got = warc.read_records(index, index.archives, payloads=True).collect()
    body = {i: (h or "").encode() for i, _, h in pages}
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 7: ("response", None)}
    assert len(got) == len(pages)
    for x in got:
        assert (x.record_type, x.refers_to) == want[x.page_id]
        assert x.payload_bytes == len(body[x.page_id]) and x.payload_digest == hashlib.sha1(body[x.page_id]).hexdigest()
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == body[x.page_id]
    some = warc.read_records(index.filter("page_id = 2"), index.archives).collect()
    assert [x.page_id for x in some] == [2]
    empty = warc.write_archives(df.limit(0), Scratch(spark, "t"))
    assert empty.count() == 0 and warc.read_records(empty, empty.archives).count() == 0


def test_ranges_join_neighbours_only():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP_BYTES, 5), ("a", 10**8, 1), ("b", 0, 4)]
    assert [(x[0], x[1], x[2], len(x[3])) for x in warc.ranges(rows)] == [("a", 0, 20 + warc.GAP_BYTES, 3), ("a", 10**8, 10**8 + 1, 1), ("b", 0, 4, 1)]
    with pytest.raises(ValueError):
        broken = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
        warc.parse(broken)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_regex(text):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    fixed = ["a@b.c d", "a@b@c.d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111", "+1 (988) 555-2485", "+1+22 333 444 5555", "é@b.cc", "a.b@c-d.e-f.", "00.000.0000.255", ""]
    r = random.Random(1)
    fixed += ["".join(r.choice("ab@.-+ 0123456789()é_%") for _ in range(r.randrange(60))) for _ in range(4000)]
    for text in fixed:
        assert pii.base_spans(text) == base_by_regex(text), text
    assert len(list(pii.emails("a" * 200_000))) == 0  # linear time


def test_pii_rows(spark):
    texts = ["mail me: bo@ex.com or +1 (988) 555-2485", None, "", "nothing here 12", "call (988) 555-2485 now", "IP 10.0.0.1 card 4111 1111 1111 1111", "order 4111 1111 1111 1112"] + [f"contact a{k}@b{k}.org tel +44 20 7946 0{100 + k}" for k in range(30)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)] + [(5, texts[5], "s")], "doc_id long, text string, spans string")
    got = pii.find_pii(docs).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        base = base_by_regex(texts[x.doc_id] or "")
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert x.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(x.spans.split(",") if x.spans else [])
    assert pii.find_pii(docs.limit(0)).count() == 0


def check_digit(digits):
    return digits + next(str(d) for d in range(10) if pii.luhn(digits + str(d)))


def test_planted_spans_are_added_and_decoys_are_not(spark):
    """Spans that no base pattern has, among base ones and lookalikes; precision and recall of what is added."""
    r = random.Random(12)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(6))
    card = lambda: check_digit("4" + number(14))
    grouped = lambda x, by: by.join(x[k : k + 4] for k in range(0, 16, 4))
    planted = [  # kind, the text before, the span
        lambda: ("email", "contact ", f"{name()} [at] {name()} [dot] com"), lambda: ("email", "e-mail: ", f"{name()}.{name()}(at){name()}.org"), lambda: ("email", "write to me, mail ", f"{name()} at {name()} dot net"),
        lambda: ("ip", "host ", f"2001:db8:{number(3)}:{number(2)}::{number(4)}"), lambda: ("ip", "server ", f"fe80::{number(3)}:{number(4)}:{number(4)}:{number(4)}"),
        lambda: ("card", "card ", grouped(card(), ".")), lambda: ("card", "visa: ", grouped(card(), "/")),
        lambda: ("phone", "call ", f"({r.randrange(200, 999)}) 555-{number(4)}"), lambda: ("phone", "telefon ", f"0{r.randrange(30, 99)}1 {number(3)} {number(4)}"), lambda: ("phone", "phone ", f"0044 20 7946 {number(4)}"),
    ]
    decoys = [
        lambda: f"version {r.randrange(1, 9)}.{r.randrange(300, 999)}.{r.randrange(9)}.{r.randrange(256, 999)}", lambda: f"order 1{number(3)}.{number(4)}.{number(4)}.{number(4)}", lambda: f"they met at {name()}.then at noon",
        lambda: f"item no 00{number(7)}", lambda: f"at 12:30:45:10 and 1:2:3:4:5", lambda: f"invoice 3{number(12)}", lambda: f"ref {number(3)}-{number(2)}-{number(4)}", lambda: f"id 0{number(2)}{number(4)}{number(4)}",
    ]
    docs, want = [], set()
    for k in range(900):
        text = prose(k, 10) + " "
        if k % 3 == 0:
            text += r.choice([f"mail {name()}@{name()}.com", f"call +1 ({number(3)}) 555-{number(4)}", f"card {card()}", f"host {r.randrange(1, 223)}.{r.randrange(255)}.1.{r.randrange(255)}"])
        elif k % 3 == 1:
            kind, before, span = r.choice(planted)()
            want.add((k, f"{kind}:{len(text) + len(before)}:{len(text) + len(before) + len(span)}"))
            text += before + span
        else:
            text += r.choice(decoys)()
        docs.append((k, text + " " + prose(k + 5000, 5)))
    rows_ = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = set()
    for x in rows_:
        base = {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_regex(dict(docs)[x.doc_id])}
        mine = {(x.doc_id, s) for s in x.spans.split(",") if s and s not in base}
        assert len(mine) == x.n_added
        got |= mine
    assert len(want) == 300 and len(got & want) >= 0.8 * len(want), len(got & want)
    assert len(got & want) >= 0.95 * len(got), sorted(got - want)


def test_gazetteers_come_as_a_table(spark):
    known = pii.gazetteers(spark.createDataFrame([("domain", "ZZ"), ("domain", "zz")], "kind string, term string"))
    assert known.domains == {"zz"} and known.issuers == pii.DEFAULT.issuers
    assert pii.votes("a@b.zz", 0, 0, 6, True, known)[2] == 1 == -pii.votes("a@b.com", 0, 0, 7, True, known)[2]


def test_spans_that_overlap():
    rows_ = np.zeros((4, pii.WIDTH), np.int64)
    rows_[:, :4] = [[1, 0, 10, 20], [0, 3, 18, 25], [0, 3, 25, 30], [0, 2, 28, 40]]
    rows_[2, 5], weights = 7, np.zeros(pii._SIZE)
    weights[0], weights[7] = 5.0, 6.0
    assert pii.added(rows_, weights) == [(25, 3, 30)]
    assert pii.added(rows_[:1], weights) == []


def test_labelers_that_agree_are_trusted():
    code = lambda votes: sum((v + 1) * 3 ** (len(votes) - 1 - k) for k, v in enumerate(votes))
    counts = [(3, code((1, 1, 1, 1, 1, 1)), 500), (3, code((0, -1, -1, -1, -1, -1)), 500), (3, code((1, 1, 1, -1, 1, 1)), 50)]
    table_, posterior = pii.reliabilities(counts)
    assert posterior[3, counts[0][1]] > 0.95 > 0.05 > posterior[3, counts[1][1]] and posterior[3, counts[2][1]] > 0.9
    assert np.allclose(table_[3].sum(axis=2), 1)


def test_decontamination_matches_brute_force(spark, rows):
    items = [(1, " ".join(prose(7, 20_000).split()[500:540])), (2, "nowhere " * 9), (3, None), (4, ""), (5, "One TWO"), (6, prose(1, 60)), (None, "one two")]
    bench = spark.createDataFrame([(*x, 1, "n") for x in items], "item_id long, text string, n int, doc_id string")
    lower = lambda t: sets_of((t or "").lower())
    want = {}
    for i, t, *_ in rows:
        for j, u in items:
            own = lower(u)
            if j is not None and own and 100 * len(own & lower(t)) >= 75 * len(own):
                want[i, j] = (len(own), len(own & lower(t)))
    got = {(x.doc_id, x.item_id): (x.n_item, x.n_shared) for x in decontam.find_items(table(spark, rows + [rows[0]]), bench).collect()}
    assert got == want and (50, 1) in want and (6, 5) in want
    assert decontam.find_items(table(spark, []), bench).count() == 0
    assert decontam.find_items(table(spark, rows), bench.limit(0)).count() == 0
    words = prose(1, 60).split()  # an item whose halves stand in two rows of one doc_id
    halves = spark.createDataFrame([(1, " ".join(words[:32])), (1, " ".join(words[28:])), (2, " ".join(words[:32]))], "doc_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontam.find_items(halves, bench).collect()] == [(1, 6)]


def filtered(rows_, kinds, step):
    """Rows of samples behind the filters, byte by byte as the format's text says."""
    out = np.zeros((len(rows_), rows_.shape[1] + 1), np.uint8)
    for i, row in enumerate(rows_.astype(int)):
        for j, x in enumerate(row):
            a = int(row[j - step]) if j >= step else 0
            b = int(rows_[i - 1][j]) if i else 0
            c = int(rows_[i - 1][j - step]) if i and j >= step else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out[i, j + 1] = (x - (0, a, b, (a + b) // 2, near)[kinds[i]]) % 256
        out[i, 0] = kinds[i]
    return out


def test_png_filters_and_checksums():
    r = np.random.default_rng(1)
    payload = r.integers(0, 256, 64 * 37).astype(np.uint8).tobytes()
    for kind in (None, 0, 1, 2):
        assert media.read_png(media.write_png(payload, kind)).tobytes() == payload
    rows_ = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    for step in (1, 2, 4):
        for top in (0, 1, 2, 3, 4, 5):
            kinds = r.integers(0, 5, len(rows_)) if top == 5 else np.full(len(rows_), top)
            assert media.unfilter(filtered(rows_, kinds, step), step).tobytes() == payload
    text = (prose(3, 900)).encode()
    text = text.ljust(-(-len(text) // 64) * 64, b"\0")
    stored = next(zlib.decompress(body) for kind, body in media.chunks(media.write_png(text)) if kind == b"IDAT")
    kinds = Counter(stored[::65])
    assert kinds[1] + kinds[2] > 0.9 * kinds.total() and min(kinds[1], kinds[2]) > 0  # so that unfiltering has work to do
    assert np.frombuffer(stored, np.uint8).reshape(-1, 65).tolist() == filtered(np.frombuffer(text, np.uint8).reshape(-1, 64), list(stored[::65]), 1).tolist()
    png = bytearray(media.write_png(payload))
    png[60] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(png))
    with pytest.raises(ValueError):
        media.read_png(media.write_png(payload)[:-4])
    with pytest.raises(ValueError):
        media.unfilter(np.full((1, 65), 5, np.uint8), 1)


def test_hash_matches_the_transform_written_out():
    r = np.random.default_rng(6)
    for height in (1, 7, 32, 61):
        image = r.integers(0, 256, (height, 64)).astype(np.uint8)
        place = lambda n: [[k * n // 32] if n < 32 else list(range(k * n // 32, (k + 1) * n // 32)) for k in range(32)]
        down, across = place(height), place(64)
        small = [[sum(int(image[y, x]) for y in ys for x in xs) / (len(ys) * len(xs)) for xs in across] for ys in down]
        c = [[math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
        low = [round(1e6 * sum(small[y][x] * c[u][y] * c[v][x] for y in range(32) for x in range(32))) for u in range(8) for v in range(8)][1:]
        middle = sorted(low)[31]
        bits = "".join("1" if x > middle else "0" for x in low) + "0"
        assert media.dct_hash(image) == f"{int(bits, 2):016x}"


def test_media_rows(spark, rows):
    docs = table(spark, rows + [rows[0]])
    got = media.media_features(Scratch(spark, "t").keep(media.store_media(docs))).collect()
    text, by_text = {i: (t or "").encode() for i, t, *_ in rows}, {}
    assert len(got) == len(rows) + 1
    for x in got:
        own = text[x.doc_id]
        padded = own.ljust(max(64, -(-len(own) // 64) * 64), b"\0")
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(own), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert by_text.setdefault(own, (x.media_bytes, x.media_sha256, x.feature)) == (x.media_bytes, x.media_sha256, x.feature)
    assert media.media_features(media.store_media(table(spark, []))).count() == 0


def sainte_lague(goals, n):
    seats = Counter()
    for _ in range(n):
        seats[max(goals, key=lambda s: (goals[s] / (2 * seats[s] + 1), -sorted(goals).index(s)))] += 1
    return seats


def test_targets_and_seats(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, "e": 3}
    goals = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {x.source: x for x in goals.collect()}
    weight, target, capped = {s: w for s, w in zip(sorted(sizes), (5, 2, 1, 5, 2), strict=True)}, {}, set()
    while True:  # as the contract says it: the excess is shared out again until none is above
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in sizes if x not in capped) for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert {s: x.weight for s, x in got.items()} == weight
    assert all(math.isclose(got[s].target, target[s], abs_tol=1e-9) for s in sizes)
    seats = {x.source: x["count"] for x in mixing.seats(goals, 64).groupBy("source").count().collect()}
    assert seats == dict(sainte_lague({s: t for s, t in target.items() if t}, 64))
    many = spark.createDataFrame([(f"s{k:04d}", 1.0) for k in range(400)] + [("big", 600.0)], "source string, target double")
    seats = {x.source: x["count"] for x in mixing.seats(many, 50).groupBy("source").count().collect()}
    assert seats == dict(sainte_lague({f"s{k:04d}": 1.0 for k in range(400)} | {"big": 600.0}, 50))


def test_mix_comes_near_its_targets(spark, rows):
    more = rows + [(2000 + k, prose(k, 20 + k % 60), "en", f"s{k % 4}") for k in range(800)] + [(3000, "x", None, None)] * 2
    got = mixing.mix(table(spark, more)).collect()
    assert sorted(x.doc_id for x in got) == sorted(i for i, *_ in more)
    source = {i: s for i, _, _, s in more}
    taken, size = Counter(), Counter()
    for x in got:
        words = len([w for w in re.split(r"[ \t\n\x0b\f\r]+", dict((i, t) for i, t, *_ in more)[x.doc_id] or "") if w])
        assert x.size == words and x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[source[x.doc_id]] += x.taken
        size[source[x.doc_id]] += x.size
    target = {source[x.doc_id]: x.target for x in got}
    assert math.isclose(sum(target.values()), sum(size.values()))
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - target[s]) <= 0.02 * target[s]
    again = mixing.mix(table(spark, more)).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in got)
    assert mixing.mix(table(spark, [])).count() == 0


def test_quotas_decide_what_is_taken(spark, monkeypatch):
    docs = table(spark, [(k, prose(k, 10 + k % 30), "en", "abbccccccccccccccc"[k % 18]) for k in range(900)])
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 64)
    source = {x.doc_id: x.source for x in docs.collect()}

    def taken():
        words, in_shard, info = Counter(), Counter(), {}
        for x in mixing.mix(docs, blocks=64).collect():
            assert len(x.shards) == x.copies
            s = source[x.doc_id]
            words[s] += x.taken
            info[s] = (x.quota, x.target)
            for shard in x.shards:
                in_shard[s, shard] += x.size
        return words, in_shard, info

    words, in_shard, info = taken()
    target = {s: t for s, (_, t) in info.items()}
    width = sum(target.values()) / 64
    assert {s: q for s, (q, _) in info.items()} == dict(sainte_lague(target, 64))
    for s, (quota, _) in info.items():  # short documents: to one of them
        assert 0 <= min(target[s], quota * width) - words[s] <= 10, s
        by_shard = Counter(int(k * mixing.SHARDS / 64) for k, x in enumerate(ordered(target, 64, lambda k: 2 * k - 1)) if x == s)
        assert all(abs(in_shard[s, k] - by_shard[k] * width) <= 40 + (width / 2 if k == 7 else 0) for k in range(8))

    other = [(x, k) for k, x in enumerate(ordered(target, 64, lambda k: k))]  # another divisor method: the highest t / k
    monkeypatch.setattr(mixing, "seats", lambda goals, blocks: spark.createDataFrame(other, "source string, place int"))
    changed, _, seats = taken()
    assert {s: q for s, (q, _) in seats.items()} == dict(Counter(x for x, _ in other)) != {s: q for s, (q, _) in info.items()}
    for s in target:
        assert 0 <= min(target[s], seats[s][0] * width) - changed[s] <= 10
        assert (changed[s] != words[s]) == (min(target[s], seats[s][0] * width) != min(target[s], info[s][0] * width))
    assert changed != words


def ordered(target, blocks, divisor):
    """The sources of the highest quotients, in order."""
    return [s for _, s in sorted((-t / divisor(k), s) for s, t in target.items() for k in range(1, blocks + 1))[:blocks]]


def test_small_sources_get_more_blocks(spark):
    goals = spark.createDataFrame([("a", 1e6), ("b", 100.0), ("c", 0.0)], "source string, target double")
    assert mixing.n_blocks(goals) == 1 << 20 and mixing.n_blocks(goals.filter("target > 1000")) == 4096 and mixing.n_blocks(goals.limit(0)) == 4096
    docs = table(spark, [(k, prose(k, 40), "en", "big") for k in range(400)] + [(1000 + k, prose(k, 3), "en", "small") for k in range(30)])
    got = [x for x in mixing.mix(docs).collect() if x.doc_id >= 1000]
    assert abs(sum(x.taken for x in got) - got[0].target) <= 0.05 * got[0].target


def brute_taken(rows, sources, blocks, most, total):
    """rid to copies. rows: rid, source, size, place in the seeded order; sources: target and quota."""
    out = {}
    for source, (target, quota) in sources.items():
        own = sorted((x for x in rows if x[1] == source), key=lambda x: x[3])
        size = sum(x[2] for x in own)
        limit = min(target, quota * total / blocks)
        passes = int(limit // size) if size else 0
        extra, upto, more = limit - passes * size, 0, set()
        for rid, _, n, _ in own:
            upto += n
            if upto <= extra:
                more.add(rid)
        room = extra - sum(n for rid, _, n, _ in own if rid in more)
        while True:
            fit = [x for x in own if x[0] not in more and 0 < x[2] <= room]
            if not fit:
                break
            small, upto, new = [x for x in fit if 2 * x[2] <= room], 0, []
            for x in small:
                upto += x[2]
                if upto <= room:
                    new.append(x)
            new = new or fit[:1]
            more |= {x[0] for x in new}
            room -= sum(x[2] for x in new)
        out |= {rid: min(most, passes + (rid in more)) if n else 0 for rid, _, n, _ in own}
    return out


def test_mix_matches_block_selection_written_out(spark, monkeypatch):
    r = random.Random(17)
    docs = [(k, prose(k, r.choice([1, 3, 9, 30, 200])), "en", r.choice(["a", "a", "a", "b", "c", None])) for k in range(500)] + [(None, prose(900 + k, 5), "en", "c") for k in range(20)] + [(1000, "", "en", "a"), (1001, None, "en", "b")]
    frame = table(spark, docs).withColumn("rid", F.monotonically_increasing_id()).cache()
    mixed = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(mixing.SEED))
    rows = [(x.rid, x.source, x.n, (x.m, -1 if x.doc_id is None else x.doc_id, x.n, x.rid)) for x in frame.select("rid", "source", "doc_id", mixing.n_words(F.col("text")).alias("n"), (F.shiftrightunsigned(mixed, 11) * F.lit(2.0**-53)).alias("m")).collect()]
    sizes = Counter()
    for _, source, n, _ in rows:
        sizes[source] += n
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 64)
    monkeypatch.setattr(mixing, "RANGE", 9)  # many ranges, and groups of them
    monkeypatch.setattr(mixing, "TOGETHER", 4)
    got = mixing.mix(frame, blocks=64, row="rid").collect()
    target = {sizes_: x.target for x in got for sizes_ in [next(s for rid, s, *_ in rows if rid == x.rid)]}
    quota = {next(s for rid, s, *_ in rows if rid == x.rid): x.quota for x in got}
    named = {s or "~": t for s, t in target.items()}  # null goes last
    seats_ = sainte_lague(named, 64)
    assert quota == {s: seats_[s or "~"] for s in target}
    assert {x.rid: x.copies for x in got} == brute_taken(rows, {s: (target[s], quota[s]) for s in target}, 64, 3, sum(sizes.values()))
    assert all(x.taken == x.copies * x.size for x in got)


def test_long_documents_are_passed_over(spark):
    rows = spark.createDataFrame([(k, "s", 20, k) for k in range(500)] + [(500 + k, "s", n, 500 + k) for k, n in enumerate((20_000, 9_000, 2_500, 30))] + [(None, "t", 7, 600 + k) for k in range(40)], "doc_id long, source string, size long, rid long")
    goals = spark.createDataFrame([("s", 41_530, 5, 12_345.0, [3] * 8), ("t", 280, 2, 150.0, [3] * 8)], "source string, source_size long, weight int, target double, by_shard array<long>")
    for seed in range(3):
        got = mixing._taken(rows, goals, 3, 24, seed, Scratch(spark, "long")).collect()
        for target, size in ((12_345, 41_530), (150, 280)):
            mine = [x for x in got if x.source_size == size]
            room = target - sum(x.taken for x in mine)
            assert 0 <= room < min(x.size for x in mine if not x.copies)
        assert {x.copies for x in got} == {0, 1}


def test_rows_with_null_and_repeated_doc_ids_are_mixed_and_dealt_like_others(spark, monkeypatch):
    texts = [prose(k, 20) for k in range(60)]
    docs = table(spark, [(7001, prose(1, 1000), "en", "a")] + [(None, t, "en", "a") for t in texts] + [(5, t, "en", "b") for t in texts[:30]] + [(k, prose(k, 15), "en", "b") for k in range(6000, 6040)])
    got = mixing.mix(docs).collect()
    for source_size in {x.source_size for x in got}:
        mine = [x for x in got if x.source_size == source_size]
        room = mine[0].target - sum(x.taken for x in mine)
        assert 0 <= room < min(x.size for x in mine if x.copies < 3), (source_size, room)
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 4)
    dealt = sharding.shard_by_bytes(docs, 3).collect()
    assert len(dealt) == 131
    for shard in range(3):
        mine = sorted(x.slot for x in dealt if x.shard == shard)
        assert mine == list(range(len(mine)))


def test_exchange_finds_alternating_classes():
    r = random.Random(2)
    line = [w for _ in range(3000) for w in (r.randrange(4), 4 + r.randrange(4))]
    bigrams = np.zeros((8, 8))
    for a, b in zip(line, line[1:], strict=False):
        bigrams[a, b] += 1
    of = brown.exchange(bigrams, bigrams.sum(axis=1), 2)
    assert len(set(of[:4])) == 1 and len(set(of[4:])) == 1 and of[0] != of[4]


def tokens_of(text):
    return [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").translate(urlfilter._LOWER)) if x]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_batches_raise_the_likelihood():
    r = np.random.default_rng(4)
    v, groups = 300, 6
    word_class = r.integers(0, groups, v)
    line = [int(r.integers(v))]
    for _ in range(60_000):  # the class after g is g + 1 or, seldom, any
        g = (word_class[line[-1]] + 1) % groups if r.random() < 0.9 else r.integers(groups)
        line.append(int(r.choice(np.flatnonzero(word_class == g))))
    bigrams = np.zeros((v, v))
    np.add.at(bigrams, (line[:-1], line[1:]), 1)
    size = groups + 3
    of = r.integers(0, groups, v)
    seen = []
    for _ in range(4):
        member = np.eye(size)[of]
        table_ = member.T @ bigrams @ member
        seen.append(brown.likelihood(table_))
        for part in brown._batches(np.arange(v), bigrams.sum(axis=1), bigrams.sum() / 500):
            member = np.eye(size)[of]
            of[part] = brown.moved(table_, of[part], bigrams[part] @ member, (bigrams.T @ member)[part], groups)
        member = np.eye(size)[of]  # words that move at once are static to each other in the table
        assert np.isclose(table_.sum(), bigrams.sum()) and abs(table_ - member.T @ bigrams @ member).sum() < 0.01 * bigrams.sum()
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 50_000
    pairs = [(of[x] == of[y]) == (word_class[x] == word_class[y]) for x in range(0, v, 3) for y in range(x)]
    assert np.mean(pairs) > 0.95


def test_words_without_a_class_join_one():
    table_ = np.zeros((5, 5))  # classes 0 and 1 take turns; 2: tail, 3: end, 4: none yet
    table_[0, 1] = table_[1, 0] = 100
    table_[0, 4] = table_[4, 0] = 9
    to = brown.moved(table_, np.array([4]), np.array([[9.0, 0, 0, 0, 0]]), np.array([[9.0, 0, 0, 0, 0]]), 2)
    assert to.tolist() == [1] and table_[0, 1] == table_[1, 0] == 109 and table_[0, 4] == table_[4, 0] == 0


def brute_scores(docs, model, head):
    """log10 probability of every text under the classes of the model, all else counted anew."""
    train = [tokens_of(t) for i, t, *_ in docs if not held_out(i)]
    counts = Counter(w for x in train for w in x)
    symbol = {w: int(model.of[k]) for w, k in head.items()}
    bigrams, mass = Counter(), Counter()
    stream = [brown.END]
    for x in train:
        stream += [symbol.get(w, brown.TAIL) for w in x] + [brown.END]
    bigrams.update(zip(stream, stream[1:], strict=False))
    into, out = Counter(stream[1:]), Counter(stream[:-1])
    for w, n in counts.items():
        mass[symbol.get(w, brown.TAIL)] += n
    tail_types = sum(w not in symbol for w in counts)
    ones, twos = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos)))

    def step(a, b):
        share = (into[b] + 1) / (len(stream) - 1 + brown.SYMBOLS)
        return (bigrams[a, b] + brown.BACK_OFF * share) / (out[a] + brown.BACK_OFF)

    def emit(w):
        if w in symbol:
            return counts[w] / mass[symbol[w]]
        return (counts[w] - discount if w in counts else discount * tail_types + 1) / (mass[brown.TAIL] + 1)

    result = {}
    for i, t, *_ in docs:
        line = [brown.END] + [symbol.get(w, brown.TAIL) for w in tokens_of(t)] + [brown.END]
        result[i] = sum(math.log10(step(a, b)) for a, b in zip(line, line[1:], strict=False)) + sum(math.log10(emit(w)) for w in tokens_of(t))
    return result


@pytest.mark.parametrize("head", [brown.HEAD, 150])
def test_brown_scores(spark, rows, monkeypatch, head):
    docs = rows + [(3000 + k, prose(k % 40, 30), "en", "a") for k in range(120)] + [(None, prose(77, 40), "en", "a")]
    tokens = lambda t: tokens_of(t) + [None]
    counts = Counter(w for i, t, *_ in docs if not held_out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    monkeypatch.setattr(brown, "HEAD", head)
    got = {x.doc_id: x for x in brown.score(table(spark, docs)).collect()}
    assert len(got) == len(docs)
    frame = table(spark, docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"), "text")
    model, _, _ = brown.train(frame, Scratch(spark, "t"))
    words = sorted({w for w in counts if w is not None})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes, _ = word_hashes(data, np.array([0, len(data)]))
    kept = sorted((int(h), w) for h, w in zip(hashes, words, strict=True) if counts[w] > 1)
    if len(kept) > len(model.of):  # those of the highest counts, whole steps of them
        least = sorted((counts[w] for _, w in kept), reverse=True)[len(model.of) - 1]
        kept = [(h, w) for h, w in kept if counts[w] >= least]
    assert len(kept) == len(model.of) <= head
    want = brute_scores(docs, model, {w: k for k, (_, w) in enumerate(kept)})
    for i, t, *_ in docs:
        x, own = got[i], tokens(t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held_out(i), len(own), sum(w in counts for w in own), n)
        assert math.isclose(x.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(x.score, want[i], rel_tol=1e-9)
    assert brown.score(table(spark, [])).count() == 0
    assert brown.score(table(spark, [(i, "a b", "en", "a") for i in range(60) if held_out(i)])).select(F.max("n_known")).head()[0] == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_held_out_texts_are_better_told_than_by_the_base(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the tables are not here")
    got = brown.score(spark.read.parquet(path)).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert got[0] > got[1] + 0.3 * got[2]


def test_brown_model_is_a_distribution(spark):
    texts = [prose(k, 12) + f" once{k}" for k in range(60)]
    rows_ = spark.createDataFrame([(k, k, False, t) for k, t in enumerate(texts)], "rid long, doc_id long, held_out boolean, text string")
    model, rest, _ = brown.train(rows_, Scratch(spark, "t"))
    assert np.allclose((10**model.step).sum(axis=1), 1)
    for c in set(model.of.tolist()):
        assert math.isclose((10 ** model.emit[:-1][model.of == c]).sum(), 1)
    tail = [x.n for x in rest.collect()]
    assert len(tail) >= 60 and math.isclose(sum(n - model.discount for n in tail) + 10**model.unknown, 10**model.tail)


def test_counts_of_a_range_add_up():
    r = np.random.default_rng(1)
    width = brown.RANGE * 2 * brown.SYMBOLS
    want, blocks = defaultdict(lambda: np.zeros(width, np.int64)), []
    for _ in range(5):
        keys = np.unique(r.integers(0, 3 * width, 400))
        n = r.integers(1, 9, len(keys))
        for k, x in zip(keys, n, strict=True):
            want[int(k) // width][k % width] += x
        of = keys // width
        blocks.append(brown._blocks(np.unique(of), of, keys - of * width, n))
    whole = pa.Table.from_batches(blocks).sort_by("r").to_batches()
    got = {r_: total.copy() for (r_,), total in brown._folded(iter(whole), ("r",))}
    assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want)


TRIE_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "a.example.org", "/es/x"), ("block", "org", "")]


def plain_judge(url):
    host, path = urlfilter.parts(url)
    fit = [(len(h), len(p), h + p, v) for v, h, p in TRIE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/en/12?q#f", "https://m.example.org/en/1", "http://example.org/es/1", "http://a.example.org/es/xy", "http://example.org", "http://xexample.org/es/", "http://b.com/fr/1", "http://b.com/de/", "http://b.com/de", "a://b.com:80/de/", "x://org?u=http://com/de/"]
    r = random.Random(4)
    urls += ["http://" + r.choice(["a.", "", "b."]) + r.choice(["example.org", "com", "org", "x.com"]) + "".join("/" + r.choice(["es", "en", "1", "12", "fr", "de", "x", ""]) for _ in range(r.randrange(4))) for _ in range(300)]
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)] + [(3, urls[3], "h", "v")], "page_id long, url string, host string, verdict string")
    got = urlfilter.filter_urls(df, TRIE_RULES).collect()
    assert len(got) == len(urls) + 1
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == plain_judge(urls[x.page_id]), urls[x.page_id]
    assert urlfilter.filter_urls(df.limit(0), TRIE_RULES).count() == 0


def test_url_rules_by_join_and_many_rules(spark, monkeypatch):
    r = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "com", "b.com", "EXAMPLE.net"]
    many = list({(r.choice(["allow", "block"]), r.choice(hosts), "/" * (k % 3 > 0) + "".join(r.choice("ab/1") for _ in range(k % 7))) for k in range(400)})
    urls = [None, "", "x", "http://", "http://org", "a://b.com?/x"] + ["http://" + r.choice(["", "x.", "y.x."]) + r.choice(hosts) + "/" + "".join(r.choice("ab/1") for _ in range(r.randrange(9))) + r.choice(["", "?q", "#f"]) for _ in range(300)] + ["http://org/" + "a/" * 30_000]
    df = spark.createDataFrame([(k % 50 or None, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    plain = []
    for k, u in enumerate(urls):
        host, path = urlfilter.parts(u)
        fit = [(len(h), len(p), v == "block", h.lower() + p, v) for v, h, p in many if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        plain.append((k % 50 or None, host, path, best[3], best[4]))
    order = lambda rows: sorted(rows, key=repr)
    as_table = spark.createDataFrame(many, "verdict string, host string, path string")
    by_trie = order(map(tuple, urlfilter.filter_urls(df, many).collect()))
    assert by_trie == order(plain) == order(map(tuple, urlfilter.filter_urls(df, as_table).collect()))
    monkeypatch.setattr(urlfilter, "MAX_RULES", 10)
    for rules in (many, as_table):
        assert order(map(tuple, urlfilter.filter_urls(df, rules).collect())) == order(plain)
    assert urlfilter.filter_by_join(df.limit(0), as_table).count() == 0
    assert {x.verdict for x in urlfilter.filter_by_join(df, as_table.limit(0)).collect()} == {"allow"}


def test_language_id(spark):
    words = {"en": "the and of to in is that with".split(), "de": "der die und das nicht von zu mit".split(), "fr": "le la et les des une dans que".split()}
    r = random.Random(8)
    docs = []
    for k in range(600):
        lang = ("en", "de", "fr")[k % 3]
        declared = lang if k % 10 else r.choice(["en", "de", "fr", None])
        docs.append((k, " ".join(r.choice(words[lang]) for _ in range(3 + k % 30)), declared, f"{lang}.host{k % 5}.org"))
    odd = [(1000, None, "en", "x"), (1001, "", None, None), (1002, "123 456 --", "de", "x"), (1003, "qx", None, None), (None, "the and of the", "en", None)]
    got = langid.identify(table(spark, docs + odd + [docs[0]])).collect()
    assert len(got) == len(docs) + len(odd) + 1
    by = {x.doc_id: x for x in got}
    right = sum(by[k].lang == ("en", "de", "fr")[k % 3] for k in range(600))
    assert right >= 594
    assert [by[k].accepted for k in (1000, 1001, 1002)] == [False] * 3 and by[1000].lang == "und"
    assert by[None].lang == "en"
    assert langid.identify(table(spark, [])).count() == 0
    unlabelled = langid.identify(table(spark, [(1, "some text", None, None)])).collect()
    assert [x.lang for x in unlabelled] == ["und"]


def brute_languages(docs):
    """doc_id to (language, posterior) of (doc_id, text, declared, host), all written out; every labelled document fits the model."""
    code = lambda x: (m := re.fullmatch(r"\s*([A-Za-z]{2,3})([-_][\w-]*)?\s*", x or "", re.ASCII)) and m[1].lower()
    suffix = lambda h: (m := re.search(r"\.([A-Za-z]+)$", h or "")) and m[1].lower()

    def grams(text):
        signs = [32] + [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (text or "").encode()] + [32]
        for x, y, z in zip(signs, signs[1:], signs[2:], strict=False):
            if (x, y, z) != (32, 32, 32):
                yield (((x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 16

    declared = Counter(code(d) for _, _, d, _ in docs if code(d))
    names = sorted(x for x, n in declared.items() if n >= langid.LEAST_DOCS)
    size, b = len(names) + 1, langid.BUCKETS
    seen = {x: Counter(g for _, t, d, _ in docs if code(d) == x for g in grams(t)) for x in names}
    log = lambda x, g: float(np.float32(math.log((1 - langid.UNSEEN) * (seen[x][g] + 0.5) / (seen[x].total() + 0.5 * b) + langid.UNSEEN / b)))
    norm = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    ll, own = [], []
    for _, t, *_ in docs:
        gs = list(grams(t))
        ll.append([langid.TEMPER * sum(log(x, g) for g in gs) for x in names] + [langid.TEMPER * len(gs) * float(np.float32(math.log(1 / b)))])
        own.append(norm([*ll[-1][:-1], ll[-1][-1] + math.log(langid.UNKNOWN_PRIOR)]) if gs else [0.0] * size)
    keys = [(code(d), suffix(h), h and ".".join(h.split(".")[-2:]), h) for *_, d, h in docs]
    total = [sum(o[k] for o in own) for k in range(size)]
    out = {}
    for i, (doc_id, t, _, _) in enumerate(docs):
        def rest(which, i=i):  # all other documents of the value
            value = keys[i][which]
            return [0.0] * size if value is None else [max(0.0, sum(o[k] for o, q in zip(own, keys, strict=True) if q[which] == value) - own[i][k]) for k in range(size)]

        toward = lambda sums, prior: [(s + langid.PSEUDO * p) / (sum(sums) + langid.PSEUDO) for s, p in zip(sums, prior, strict=True)]
        share = toward([max(0.0, x - y) for x, y in zip(total, own[i], strict=True)], [1 / size] * size)
        prior = toward(rest(3), toward(rest(2), share))
        prior[-1] = langid.UNKNOWN_PRIOR
        logs = [x + math.log(p) for x, p in zip(ll[i], prior, strict=True)]
        for which in (0, 1):
            if keys[i][which] is not None:
                given = [g / s for g, s in zip(toward(rest(which), share), share, strict=True)]
                logs = [x + math.log(g) for x, g in zip(logs, [*given[:-1], 1.0], strict=True)]
        after = norm(logs)
        best = after.index(max(after))
        good = any(True for _ in grams(t)) and best < size - 1 and after[best] >= langid.LEAST
        out[doc_id] = (names[best] if good else "und", after[best] if any(True for _ in grams(t)) else 0.0)
    return out


def test_language_id_matches_the_fusion_written_out(spark):
    r = random.Random(3)
    words = {"en": "the and of to in is".split(), "de": "der die und das nicht zu".split(), "pt": "que os uma para com".split()}
    docs = []
    for k in range(90):
        x = ("en", "de", "pt")[k % 3]
        text = " ".join(r.choice(words[x if r.random() < 0.7 else "en"]) for _ in range(1 + k % 7))
        docs.append((k, text, r.choice([x, x.upper() + "-xx", x + "_1", None, "junk!", "de"]), r.choice([f"www.a{k % 4}.{x}", f"b.{x}", "nothing", None])))
    docs += [(200, "qqq", "zz", "a0.en"), (201, None, "en", "a.de"), (202, "éé à ñ", None, "b.pt"), (203, "12", "pt", None)]
    want = brute_languages(docs)
    got = {x.doc_id: x for x in langid.identify(table(spark, docs)).collect()}
    assert set(got) == set(want) and {got[i].lang for i in got} == {"en", "de", "pt", "und"}
    for i, (lang, posterior) in want.items():
        assert got[i].lang == lang and math.isclose(got[i].posterior, posterior, rel_tol=1e-4, abs_tol=1e-6), i


def test_many_declared_languages_are_kept(spark):
    r = random.Random(1)
    codes = [a + b for a in "abcdefghij" for b in "klmnopqr"]
    word = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for x in codes}
    docs = [(k, " ".join(r.choice(word[x]) for _ in range(25)), x if k % 9 else None, None) for k, x in enumerate(codes * 8)]
    got = langid.identify(table(spark, docs), known=codes).collect()
    assert sum(x.lang == codes[x.doc_id % len(codes)] for x in got) >= 0.98 * len(docs)


def test_noise_in_declared_values_makes_no_class(spark):
    words = {"en": "the and of to in is".split(), "sw": "na ya wa kwa ni za".split()}
    docs = [(k, " ".join(random.Random(k).choice(words[x]) for _ in range(20)), x if k % 3 else f"q{'abcdefghij'[k % 10]}", None) for k in range(400) for x in [("en", "sw")[k % 2]]]
    got = langid.identify(table(spark, docs)).collect()
    assert all(x.lang == ("en", "sw")[x.doc_id % 2] for x in got) and langid.identify(table(spark, docs), known=["qa"]).filter("accepted and lang <> 'qa'").count() == 0
    assert 150 < len(langid.LANGUAGES) < 250 and all(re.fullmatch("[a-z]{2,3}", x) for x in langid.LANGUAGES)


def test_host_and_declared_language_decide_what_the_text_leaves_open(spark):
    words = {"en": "the and of to".split(), "de": "der die und das".split()}
    docs = [(k, " ".join([random.Random(k).choice(words["en" if k % 2 else "de"])] * 9), "en" if k % 2 else "de", "en.org" if k % 2 else "de.org") for k in range(200)]
    docs += [(500, "zz", None, "en.org"), (501, "zz", None, "de.org"), (502, "zz", "de", None)]
    by = {x.doc_id: x.lang for x in langid.identify(table(spark, docs)).collect()}
    assert (by[500], by[501], by[502]) == ("en", "de", "de")


def test_runs_of_thousands_of_digits_in_every_kind(spark):
    run, texts = "7" * 5000, []
    for x in ("0" * 5000 + "1.1.1.1", "1.2.3." + "0" * 5000 + "4", f"1.1.1.{run}", f"{run}.1.1.1", run, " ".join(["7"] * 5000), f"+1 {run}", "+1" + "()" * 3000, f"{run}@{run}.{run}", f"a@b.{run}", ":".join(["1"] * 5000), f"::{run}", f"{run}::1", f"{run} at {run} dot {run}", f"a [at] {run}.com", "-".join(["4111"] * 3000), f"00{run}", "0" + " 12" * 3000):
        texts += [x, f"call {x} now", x * 2]
    got = {x.doc_id: x for x in pii.find_pii(table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts) and got[0].spans.startswith("ip:0:5007") and got[0].n_ip == 1 and got[3].n_ip == 1 and got[6].n_ip == 0
    for k, t in enumerate(texts):
        base = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(pii.base_spans(t)))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_differencing_in_as_many_levels_as_it_takes(spark, monkeypatch):
    r = random.Random(4)
    docs = table(spark, [(k, "x" * r.randrange(1, 4000), "en", "s") for k in range(400)])
    for groups, most in ((400, 100), (8, 100), (8, 7), (2, 3)):  # one bucket; two levels; three; five
        monkeypatch.setattr(sharding, "BUCKET_GROUPS", groups)
        monkeypatch.setattr(sharding, "MAX_BUCKETS", most)
        got = sharding.shard_by_bytes(docs, 8).collect()
        sums = Counter()
        for x in got:
            sums[x.shard] += x.size
        assert len(got) == 400 and sorted(sums) == list(range(8)) and max(sums.values()) - min(sums.values()) <= 4000, (groups, most, sums)
        by_text = defaultdict(set)
        for x in got:
            by_text[x.size, x.text_crc32].add(x.shard)
        assert all(len(x) == 1 for x in by_text.values())
