"""Personal data in texts: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

1. scan() finds the base spans (e-mail, IP address, card and phone number patterns) and wider candidates: e-mail
   addresses written out ("at", "[at]", "dot"), IP addresses of version 6, cards in groups behind other separators, of 13
   digits or inside a longer chain of groups, telephone numbers without a plus sign (three groups, national with 0,
   international with 00), digit chains that fail the checksum, dotted numbers out of range. On every candidate the
   LABELERS (two patterns, a gazetteer, the context, the boundary, a checksum) vote for, against or not at all. The
   gazetteers (top-level domains, calling codes, card issuers) are tables that the caller may replace.
2. Over all candidates of the corpus the vote patterns are counted by kind (at most 4 * 3^6 of them) and the labelers'
   reliabilities are estimated by expectation-maximisation of a two-class model with smoothed vote probabilities.
3. The posteriors are soft labels for a logistic regression on hashed span features, fitted on about FIT_SPANS
   candidates, chosen by hash. Candidates of THRESHOLD or more that overlap no base span are added, of those that
   overlap each other the likeliest, then the first, then the longest; base spans stay.

Each document is one row throughout, whatever its length; nothing is shuffled but counts. Offsets are code points, the
end exclusive. Defined results: null text is empty and has no spans; null or repeated doc_ids only pass; no documents,
no rows. Where the corpus has no candidate but base spans, the classifier adds nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.shingles import buffers

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "wide", "gazetteer", "context", "boundary", "checksum")
FIT_SPANS = 20_000
THRESHOLD = 0.9
FEATURES, DIMENSIONS = 6, 4096
WIDTH = 5 + FEATURES  # base, kind, start, end, votes, features

MAX_TERMS = 100_000  # of the gazetteers, of some 20 bytes each in every task

# fixed values: common top-level domains, calling codes, first digits of card issuers
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl se no dk fi pt ie eu us ca au nz jp cn in br mx ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split()
ISSUERS = "4 51 52 53 54 55 34 37 36 38 6011 65 35 62".split()


class Gazetteers(NamedTuple):
    domains: frozenset[str]
    calling_codes: tuple[str, ...]
    issuers: tuple[str, ...]


DEFAULT = Gazetteers(frozenset(DOMAINS), tuple(CALLING_CODES), tuple(ISSUERS))


def gazetteers(terms: DataFrame) -> Gazetteers:
    """From a table (kind: domain, calling_code or issuer; term) of at most MAX_TERMS rows; kinds that it lacks keep their default."""
    rows = terms.select("kind", "term").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the gazetteers have more than {MAX_TERMS} terms")
    of = lambda kind, default: sorted(t for k, t in rows if k == kind) or default
    return Gazetteers(frozenset(x.lower() for x in of("domain", DOMAINS)), tuple(of("calling_code", CALLING_CODES)), tuple(of("issuer", ISSUERS)))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+./_-])0[0-9]{1,4}(?:[ ./-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])")
_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}([./_\xa0]|[ -]{2,3})(?:[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{6}\1[0-9]{4,5})(?![0-9])")
_SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_AT = re.compile(r"(?: ?[\[({<] ?(?:at|AT|At) ?[\])}>] ?| (?:at|AT) )(?=[A-Za-z0-9-]{1,63}(?:[.\[({<]| ?[\[({<]| (?:dot|DOT) ))")
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|DOT|Dot) ?[\])}>] ?| (?:dot|DOT) )[A-Za-z0-9-]{1,63})+")
_FOR = re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|phone|tel|telephone|mobile|cell|call|fax|ip|address|host|server|card|visa|credit|debit|payment|kontakt|telefon|correo|courriel)\W*$")
_AGAINST = re.compile(r"(?i)\b(?:version|v|order|invoice|isbn|issn|ref|id|no|number|build|release|section|chapter|page|part|sku|item)\W*$")


def luhn(digits: str) -> bool:
    doubled = [int(x) for x in digits[-2::-2]]
    return (sum(int(x) for x in digits[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@label.label..., in time linear in the text: a match can only begin where the run of local characters before an at sign does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, found.end()
        at = text.find("@", done)


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers. A run of digits cannot begin a match in its middle."""
    at = _DIGIT.search(text)
    while at:
        found = _IP.match(text, at.start())
        if found:
            yield found.span()
        at = _DIGIT.search(text, found.end() if found else at.end())


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in that order; those that fail their test are dropped."""
    found = [(a, 0, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [(a, 1, b) for a, b in dotted(text) if all(len(y := x.lstrip("0")) < 4 and int(y or 0) <= 255 for x in text[a:b].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(x := _digits(m[0])) <= 19 and luhn(x):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _inside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of a chain of digits that have 14 to 19 digits and pass the checksum."""
    groups = [(m.start(), m.end()) for m in _DIGIT.finditer(text, start, end)]
    for i, (first, _) in enumerate(groups):
        n = 0
        for _, last in groups[i:]:
            n = len(_digits(text[first:last]))
            if n > 19:
                break
            if n >= 14 and luhn(_digits(text[first:last])):
                yield first, last


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _AT.finditer(text):
        rest = _SPELT.match(text, m.end())
        start = m.start()
        while rest and start > max(0, m.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, 0, rest.end()
    if not _DIGIT.search(text):
        return
    for a, b in dotted(text):
        yield a, 1, b
    if "::" in text or text.count(":") > 3:
        for m in _SIX.finditer(text):
            if m[0].count(":") > 3 or "::" in m[0] and len(m[0]) > 3:
                yield m.start(), 1, m.end()
    for m in _CARD.finditer(text):
        n = len(_digits(m[0])) if m.end() - m.start() > 12 else 0
        if 13 <= n <= 19:
            yield m.start(), 2, m.end()
        elif n > 19:
            for a, b in _inside(text, *m.span()):
                yield a, 2, b
    for m in _GROUPS.finditer(text):
        yield m.start(), 2, m.end()
    for m in _PHONE.finditer(text):
        yield m.start(), 3, m.end()
    for m in _LOCAL_PHONE.finditer(text):
        if not m.start() or text[m.start() - 1] not in "+0123456789":
            yield m.start(), 3, m.end()
    for m in _NATIONAL.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.start(), 3, m.end()


def _address(span: str) -> bool:
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def votes(text: str, start: int, kind: int, end: int, base: bool, known: Gazetteers = DEFAULT) -> tuple[int, ...]:
    """1, 0 or -1 of each labeler."""
    span, digits = text[start:end], _digits(text[start:end])
    before, left, right = text[max(0, start - 24) : start], text[start - 1 : start], text[end : end + 1]
    context = 1 if _FOR.search(before) else -1 if _AGAINST.search(before) else 0
    closed = -1 if left.isalnum() or right.isalnum() or left in "./_-=" and left else 1
    if kind == 0:
        last = re.split(r"[.\])( ]+", span)[-1].lower()
        spelt = bool(_AT.search(span))  # brackets, or a dot in words, are no chance
        return (1 if base else 0, (1 if re.search(r"[\[({<]|(?i: dot )", span) else -1) if spelt else 1 if re.search(r"[A-Za-z]", span) else -1, 1 if last in known.domains else -1, context, closed, 1 if "@" in span else 0)
    if kind == 1 and ":" in span:
        return (0, 1 if len(span) > 8 else 0, 1 if re.match(r"(?i)(?:[23][0-9a-f]{3}|f[cde]|::)", span) else -1, context, closed, 1 if _address(span) else -1)
    if kind == 1:
        parts = [int(x[-9:]) for x in span.split(".")]
        public = 0 < parts[0] < 224 and parts[0] != 127
        return (1 if base else -1, 1 if max(map(len, span.split("."))) <= 3 else -1, 1 if public else -1, context, closed, 1 if max(parts) <= 255 else -1)
    if kind == 2:
        return (1 if base else 0 if luhn(digits) else -1, 1 if 15 <= len(digits) <= 16 else 0, 1 if digits.startswith(known.issuers) else -1, context, closed, 1 if luhn(digits) else -1)
    abroad = span[0] == "+" or digits.startswith("00")
    called = digits.lstrip("0").startswith(known.calling_codes) if abroad else digits[0] not in "1" and digits[:3] != "000"
    return (1 if base else 0, 1 if re.search(r"[ ()/.-]", span) else -1, 1 if called else -1, context, closed, 1 if 10 <= len(digits) <= 15 else 0 if len(digits) == 9 else -1)


def _features_of(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    span = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", span))[:24]
    word = re.search(r"(\w*)\W*$", text[max(0, start - 24) : start])[1].lower()
    values = (min(end - start, 40), len(_digits(span)), text[start - 1 : start].isspace(), text[end : end + 1].isspace(), shape, word)
    return tuple(int.from_bytes(hashlib.blake2b(f"{kind}/{k}/{x}".encode(), digest_size=4).digest(), "big") % DIMENSIONS for k, x in enumerate(values))


def scan(text: str, known: Gazetteers = DEFAULT) -> tuple[list[tuple[int, int, int]], list[tuple[int, ...]]]:
    """Base spans, and all candidates as rows of WIDTH numbers."""
    base = base_spans(text)
    candidates, seen = [], set(base)
    spans = [(x, True) for x in base]
    for x in _wider(text):
        if x not in seen:
            seen.add(x)
            spans.append((x, False))
    for (start, kind, end), own in spans:
        code = 0
        for vote in votes(text, start, kind, end, own, known):
            code = 3 * code + vote + 1
        candidates.append((int(own), kind, start, end, code, *_features_of(text, start, kind, end)))
    return base, candidates


def candidates(docs: DataFrame, known: Gazetteers = DEFAULT) -> DataFrame:
    """doc_id and spans, WIDTH numbers to a candidate in turn, of every document."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch["text"])
            rows = []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                rows.append([x for row in scan(text, known)[1] for x in row])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, spans array<long>")


def _decoded(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        code, vote = divmod(code, 3)
        out.append(vote)
    return out[::-1]


# How often labelers are believed to vote -1, 0 and 1 on what is no personal data, and on what is: a vote of the boundary
# for a span says little, one of the context much. Out of ten; the order is that of LABELERS.
BELIEVED = np.array([
    [[6.0, 3, 1], [5, 3, 2], [4, 2, 4], [6, 3, 1], [3, 1, 6], [6, 1, 3]],
    [[1.0, 3, 6], [1, 3, 6], [1, 2, 7], [0.75, 3, 6.25], [1, 1, 8], [1, 1, 8]],
])


def reliabilities(counts: Sequence[tuple[int, int, int]], rounds: int = 60) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """From (kind, vote code, count): P(vote | class) as [kind, class, labeler, vote], and the posterior of each (kind, code).

    BELIEVED stands for ten candidates and a fifth as many as there are, and so fixes which class is which. What the
    strict pattern is for and all else have class frequencies of their own: else many base spans would pull up the rest.
    """
    table = np.zeros((len(KINDS), *BELIEVED.shape[:2], 3))
    posterior: dict[tuple[int, int], float] = {}
    for kind in range(len(KINDS)):
        own = [(code, n) for k, code, n in counts if k == kind]
        table[kind] = BELIEVED / BELIEVED.sum(axis=2, keepdims=True)
        if not own:
            continue
        seen = np.eye(3)[[_decoded(code) for code, _ in own]]  # [pattern, labeler, vote]
        n = np.array([x for _, x in own], float)
        strict = seen[:, 0, 2].astype(int)
        prior = np.full((2, 2), 0.5)  # [strict, class]
        for _ in range(rounds):
            logs = np.log(prior[strict].T) + np.einsum("plv,clv->cp", seen, np.log(table[kind]))
            weight = np.exp(logs - logs.max(axis=0))
            weight /= weight.sum(axis=0)
            for k in (0, 1):
                prior[k] = (weight[:, strict == k] @ n[strict == k] + 5) / (n[strict == k].sum() + 10)
            table[kind] = np.einsum("cp,plv->clv", weight * n, seen) + BELIEVED * (1 + 0.02 * n.sum())
            table[kind] /= table[kind].sum(axis=2, keepdims=True)
        posterior |= {(kind, code): float(w) for (code, _), w in zip(own, weight[1], strict=True)}
    return table, posterior


def _inputs(rows: np.ndarray) -> np.ndarray:
    """Feature numbers of candidate rows (n, WIDTH): the hashed ones, and one for each labeler's vote by kind."""
    powers = 3 ** np.arange(len(LABELERS))[::-1]
    cast = rows[:, 4:5] // powers % 3
    own = DIMENSIONS + (rows[:, 1:2] * len(LABELERS) + np.arange(len(LABELERS))) * 3 + cast
    return np.concatenate([rows[:, 5:], own], axis=1)


_SIZE = DIMENSIONS + len(KINDS) * len(LABELERS) * 3


def fit(rows: np.ndarray, soft: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of the span classifier for soft labels; rows as in scan()."""
    weights = np.zeros(_SIZE)
    if len(rows):
        x = _inputs(rows)
        for _ in range(rounds):
            error = soft - _sigmoid(weights[x].sum(axis=1))
            slope = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), _SIZE) / len(rows)
            weights += rate * (slope - decay * weights)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(found: DataFrame) -> np.ndarray:
    """The classifier's weights from the candidates of the whole corpus: counts of all, fitted on about FIT_SPANS."""
    n = f"cast(size(spans) / {WIDTH} as int)"
    rows = found.filter("size(spans) > 0").select("doc_id", F.explode(F.expr(f"transform(sequence(0, {n} - 1), i -> slice(spans, i * {WIDTH} + 1, {WIDTH}))")).alias("x"))
    counts = [(kind, code, n) for kind, code, n in rows.groupBy(F.col("x")[1], F.col("x")[4]).count().collect()]
    total = sum(n for *_, n in counts)
    _, posterior = reliabilities(counts)
    share = min(1.0, FIT_SPANS / max(1, total))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("doc_id", "x")).limit(2 * FIT_SPANS).select("x").collect()
    fitted = np.array([x for (x,) in chosen], np.int64).reshape(-1, WIDTH)
    return fit(fitted, np.array([posterior[k, c] for k, c in fitted[:, [1, 4]].tolist()]))


def find_pii(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end, all) and n_added of every document. terms: gazetteers in place of the default ones."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(candidates(docs, DEFAULT if terms is None else gazetteers(terms)), "candidates")
    weights = found.sparkSession.sparkContext.broadcast(train(found))
    named = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch["spans"].to_pylist():
                rows = np.array(x, np.int64).reshape(-1, WIDTH)
                base = [(a, k, b) for own, k, a, b in rows[:, :4].tolist() if own]
                spans = base + added(rows, weights.value)
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(named(base).encode()).hexdigest(), named(spans), len(spans) - len(base)))
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return found.mapInArrow(judged, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def added(rows: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates of one text that the classifier adds."""
    more = rows[rows[:, 0] == 0]
    if not len(more):
        return []
    sure = _sigmoid(weights[_inputs(more)].sum(axis=1))
    more, sure = more[sure >= THRESHOLD], sure[sure >= THRESHOLD]
    base = rows[rows[:, 0] == 1]
    starts = np.sort(base[:, 2])
    ends = np.maximum.accumulate(base[np.argsort(base[:, 2], kind="stable"), 3]) if len(base) else base[:, 3]
    taken: list[tuple[int, int, int]] = []
    for _, kind, start, end in more[np.lexsort((-more[:, 3], more[:, 2], -sure)), :4].tolist():
        before = int(np.searchsorted(starts, end))  # base spans that begin before its end
        if (not before or ends[before - 1] <= start) and _free(taken, start, end):
            bisect.insort(taken, (start, kind, end))
    return taken


def _free(taken: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """No span of taken, which do not overlap each other, overlaps this one."""
    at = bisect.bisect_left(taken, (start, -1, -1))
    return (at == len(taken) or taken[at][0] >= end) and (not at or taken[at - 1][2] <= start)
