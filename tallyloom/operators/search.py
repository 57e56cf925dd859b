"""The best two master rows of each query, looked for in memory: a chunk of the master table is in every task, and queries stream past it.

A pair's points are those of matching.scored(). What a query's own postal code and VAT bring is scored row by row; of all other rows
(points of town, street and name only) the best two are enough, and rows that no bound lets reach these are not read. Points are
rounded as Spark rounds them and rows stand by ordinal, so that of equal ones the first is found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

SLACK = 0.006  # of a bound over points that are rounded to 2 decimals
CACHE_BYTES = 64 << 20  # of points by text that a task keeps
_rounded: dict[float, float] = {}


def rounded(x: float) -> float:
    """Two decimals as Spark's round(): half up, of the number as it is written."""
    found = _rounded.get(x)
    if found is None:
        if len(_rounded) > 1 << 16:
            _rounded.clear()
        found = _rounded[x] = float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return found


class Lists:
    """Rows by a number that each has."""

    def __init__(self, ids: np.ndarray, n: int):
        self.ids, self.order = ids, np.argsort(ids, kind="stable")
        self.start = np.searchsorted(ids[self.order], np.arange(n + 1))

    def rows(self, low: int, high: int) -> np.ndarray:
        """Of numbers from low to under high."""
        return self.order[self.start[low] : self.start[high]]

    def of(self, chosen: np.ndarray, few: int) -> np.ndarray:
        """Of all chosen numbers (a mask), in the rows' order."""
        some = np.flatnonzero(chosen)
        if len(some) > few:
            return np.flatnonzero(chosen[self.ids])
        return np.sort(np.concatenate([self.rows(k, k + 1) for k in some])) if len(some) else some


class Texts:
    """Different texts of rows with lists of their words."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        ids, texts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.to_pylist()
        self.ids, self.number, self.lists = ids, {t: k for k, t in enumerate(texts)}, Lists(ids, len(texts))
        words: dict[str, list[int]] = {}
        sizes = np.zeros(len(texts), np.int32)
        for k, text in enumerate(texts):
            sizes[k] = len(own := set(text.split()))
            for w in own:
                words.setdefault(w, []).append(k)
        self.words, self.sizes = {w: np.array(x, np.int32) for w, x in words.items()}, sizes

    def jaccard(self, text: str) -> np.ndarray | None:
        """100 * common words / all words of text and each of the texts; None if none has any."""
        own = set(text.split())
        met = [self.words[w] for w in own if w in self.words]
        if not met:
            return None
        common = np.bincount(np.concatenate(met), minlength=len(self.sizes))
        return 100.0 * common / (len(own) + self.sizes - common)


class Block:
    """The rows of one block."""

    def __init__(self, rows: pa.Table, points: dict[str, float], kept: dict):
        self.points, self.kept, self.n = points, kept, len(rows)
        column = lambda c: rows[c].combine_chunks()
        self.ordinal = rows["ordinal"].to_pylist()
        self.texts = {c: Texts(column(c)) for c in ("name", "street")}
        self.towns = Texts(column("city"))
        self.codes = sorted(set(rows["postal"].to_pylist()))
        self.code_number = {c: k for k, c in enumerate(self.codes)}
        self.code = np.array([self.code_number[c] for c in rows["postal"].to_pylist()], np.int32)
        self.by_code = Lists(self.code, len(self.codes))
        vats = column("vat").dictionary_encode()
        self.vat, self.vat_number = vats.indices.to_numpy(zero_copy_only=False).astype(np.int32), {t: k for k, t in enumerate(vats.dictionary.to_pylist())}
        self.by_vat = Lists(self.vat, len(self.vat_number))

    def _once(self, kind: str, text: str, work):
        found = self.kept.get(key := (id(self), kind, text), self)
        if found is self:
            found = work(text)
            size = sum(x.nbytes for x in (found if isinstance(found, tuple) else (found,)) if x is not None) + 200
            if self.kept.get("bytes", 0) + size > CACHE_BYTES:
                self.kept.clear()
            self.kept["bytes"] = self.kept.get("bytes", 0) + size
            self.kept[key] = found
        return found

    def _shared(self, kind: str, text: str) -> np.ndarray | None:
        """Points of a name or a street for each different one of the rows, None without any."""
        def work(text: str) -> np.ndarray | None:
            j = self.texts[kind].jaccard(text)
            if j is None or kind == "name":
                return None if j is None else self.points["name"] * j
            return np.where(j >= self.points["street_least"], self.points["street"] * j, 0.0) if j.max() >= self.points["street_least"] else None

        return self._once(kind, text, work)

    def _places(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of the town and of similar ones, and their points."""
        def work(text: str) -> tuple[np.ndarray, np.ndarray] | None:
            j = self.towns.jaccard(text)
            if j is None:
                return None
            by_town = np.where(j >= self.points["city_least"], self.points["city_share"] * j, 0.0)
            if text in self.towns.number:
                by_town[self.towns.number[text]] = self.points["city"]
            own = by_town[self.towns.ids]
            rows = np.flatnonzero(own > 0)
            return rows, own[rows]

        return self._once("city", text, work)

    def best(self, name: str, street: str, city: str, postal: str, vat: str, often: int, few: int) -> list:
        """Ordinals of the best two rows with any points. A block of at most often rows is scored whole; of at most few texts the rows are taken list by list, of more by a pass over all rows."""
        names, streets, places = self._shared("name", name), self._shared("street", street), self._places(city)
        name_of, street_of = self.texts["name"].ids, self.texts["street"].ids
        low, high = 0, 0
        if postal:
            low, high = bisect_left(self.codes, postal[:3]), bisect_left(self.codes, postal[:3] + "\U0010ffff")
        vat_at, code_at, town_at = self.vat_number.get(vat, -1) if vat else -1, self.code_number.get(postal, -1) if postal else -1, self.towns.number.get(city, -1) if city else -1
        best: dict[int, float] = {}

        def added(rows: np.ndarray, points: np.ndarray) -> None:
            if len(points) > 2:
                some = np.flatnonzero(points >= np.partition(points, len(points) - 2)[len(points) - 2] - 0.011)
                rows, points = rows[some], points[some]
            values, which = np.unique(points, return_inverse=True)
            points = np.array([rounded(x) for x in values.tolist()])[which]
            for _ in range(min(2, len(rows))):
                k = int(points.argmax())
                if points[k] > 0:
                    row = int(rows[k])
                    best[row] = max(best.get(row, 0.0), float(points[k]))
                points[k] = -1.0
            for row in sorted(best, key=lambda r: (-best[r], r))[2:]:
                del best[row]

        def said(rows: np.ndarray) -> np.ndarray | float:
            """Points of street and name."""
            return (streets[street_of[rows]] if streets is not None else 0.0) + (names[name_of[rows]] if names is not None else np.zeros(len(rows)))

        def whole(rows: np.ndarray) -> None:
            code, vat_ok = self.code[rows], self.vat[rows] == vat_at
            same = code == code_at
            points = np.where(vat_ok, self.points["vat"], 0.0) + np.where(same, self.points["postal"], np.where((code >= low) & (code < high), self.points["near"], 0.0))
            if places is not None:
                at = np.searchsorted(places[0], rows)
                at[at == len(places[0])] = 0
                points = points + (np.where(places[0][at] == rows, places[1][at], 0.0) if len(places[0]) else 0.0)
            added(rows, points + said(rows) + np.where((same | vat_ok) & (self.towns.ids[rows] == town_at), self.points["both"], 0.0))

        if self.n <= often:
            whole(np.arange(self.n))
        else:
            own = self.by_code.rows(low, high)
            if vat_at >= 0:
                own = np.concatenate([own, self.by_vat.rows(vat_at, vat_at + 1)])
            if len(own):
                whole(np.unique(own))
            if places is not None and len(places[0]):
                added(places[0], places[1] + said(places[0]))
            self._others(names, streets, best, said, added, few)
        return [self.ordinal[row] for row in best]

    def _others(self, names, streets, best, said, added, few: int) -> None:
        """Rows of any town by street and name: the most alike name first, then whatever street or name can still reach the second best."""
        most_name, most_street = (float(x.max()) if x is not None else 0.0 for x in (names, streets))
        second = lambda: min(best.values()) if len(best) == 2 else 0.0
        if most_name + most_street == 0 or most_name + most_street + SLACK < second():
            return
        if names is not None:
            rows = self.texts["name"].lists.of(names == most_name, few)
            added(rows, said(rows))
        ways = []
        for kind, own, other in (("name", names, most_street), ("street", streets, most_name)):
            least = second() - SLACK - other
            if own is not None and least > 0:
                ways.append((self.texts[kind].lists, own >= least))
            elif least > 0:
                return  # nothing has points of this kind, and the other alone cannot reach
        rows = np.arange(self.n)
        if ways:
            lists, chosen = min(ways, key=lambda x: int(np.diff(x[0].start)[x[1]].sum()))
            rows = lists.of(chosen, few)
        added(rows, said(rows))


class Chunk:
    """Master rows (block, ordinal, name, street, city, postal, vat; no nulls, words of names and streets sorted) in memory, by block."""

    def __init__(self, rows: pa.Table, points: dict[str, float]):
        self.rows, self.points = rows.sort_by([("block", "ascending"), ("ordinal", "ascending")]).combine_chunks(), points
        blocks = self.rows["block"].to_pylist()
        edges = [k for k in range(len(blocks)) if not k or blocks[k] != blocks[k - 1]] + [len(blocks)]
        self.edges = {blocks[a]: (a, b) for a, b in zip(edges, edges[1:])}
        self.blocks: dict[str, Block] = {}
        self.kept: dict = {}

    def best(self, keys: Iterable[str], often: int, few: int) -> tuple[list[str], list]:
        """Keys (name|street|city|postal|vat|block) and ordinals of the best two rows of each."""
        out_keys, out = [], []
        for key in keys:
            *fields, block = key.split("|", 5)
            if block not in self.edges:
                continue
            if block not in self.blocks:
                low, high = self.edges[block]
                self.blocks[block] = Block(self.rows.slice(low, high - low), self.points, self.kept)
            found = self.blocks[block].best(*fields, often, few)
            out_keys += [key] * len(found)
            out += found
        return out_keys, out
