"""Allow and block rules on URLs: a trie over reversed host labels, then path segments, walked once per URL.

A rule (verdict, host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's. Of several fitting rules the one with the longest host, then the longest path, decides; where the same host and
path stand in both lists, block goes before allow. Up to MAX_RULES rules of MAX_CHARS characters are broadcast as a trie; the work on a URL does
not grow with the number of rules, as the starts of a node are looked up by their lengths. More rules are joined by
shuffle instead: each URL's host suffixes with the starts of its path of those lengths that rules have
(filter_by_join()), with the same results.

Defined results: the host goes from after the first '://' to '/', '?', '#' or the end, A-Z lower-cased, the path from
there to '?', '#' or the end. Null and texts without '://': both empty, no rule. A path that is empty fits rules with an
empty path only. No rule: the verdict is DEFAULT. Repeated rows and null ids are judged like any other row, URLs of any
length as a whole. No pages, no rows; no rules, the default for all.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_RULES, MAX_CHARS = 200_000, 16 << 20  # of rules that are broadcast
DEFAULT = "allow"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


class RuleTrie:
    """Host nodes: label -> node, innermost label last. Each host node holds a trie of full path segments; a rule's last, unfinished segment is a start of the URL's next one."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "starts": {}, "lengths": []}
            *full, start = path.split("/")
            at = node["paths"]
            for segment in full:
                at = at["next"].setdefault(segment, {"next": {}, "starts": {}, "lengths": []})
            if at["starts"].get(start, ("allow",))[0] != "block":
                at["starts"][start] = (verdict, host.translate(_LOWER) + path)
                if len(start) not in at["lengths"]:
                    bisect.insort(at["lengths"], len(start))

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The deciding rule, as host and path in one text, or None; and the verdict."""
        fitting, node = [], self.root
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                fitting.append(node["paths"])
        segments = path.split("/")
        for at in reversed(fitting):  # the longest host first
            best = None
            for segment in segments:
                for n in reversed(at["lengths"]):
                    if n <= len(segment) and (found := at["starts"].get(segment[:n])):
                        best = found
                        break
                at = at["next"].get(segment)
                if at is None:
                    break
            if best is not None:
                return best[1], best[0]
        return None, DEFAULT


def parts(url: str | None) -> tuple[str, str]:
    """Host and path as the module's text defines them."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict of each row of pages. rules: verdict, host, path; a table of more than is broadcast is not brought to the driver."""
    if isinstance(rules, DataFrame):
        n, size = rules.agg(F.count("*"), F.sum(F.length(F.concat_ws("", "verdict", "host", "path")))).head()
        if n > MAX_RULES or (size or 0) > MAX_CHARS:
            return filter_by_join(pages, rules, url, key)
        rules = [tuple(x) for x in rules.select("verdict", "host", "path").collect()]
    elif len(rules) > MAX_RULES or sum(len(x) for rule in rules for x in rule) > MAX_CHARS:
        return filter_by_join(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), url, key)
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            split = [parts(x) for x in batch["url"].to_pylist()]
            found = [trie.judge(*x) for x in split]
            columns = [[x[0] for x in split], [x[1] for x in split], [x[0] for x in found], [x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array(x, pa.string()) for x in columns)], [key, "host", "path", "rule", "verdict"])

    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"))
    return rows.mapInArrow(judged, f"`{key}` {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def filter_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """As filter_urls() for any number of rules: an equi-join on host and path, of which only distinct lengths are broadcast."""
    own = rules.select("verdict", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), F.col("path").alias("p"))
    own = own.groupBy("h", "p").agg(F.min_by("verdict", F.col("verdict") != "block").alias("v"))
    lengths = F.broadcast(own.agg(F.array_sort(F.collect_set(F.length("p"))).alias("lengths")))  # one row of distinct numbers, no more than the longest path has characters
    after = F.when(F.contains(url, F.lit("://")), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias(url), F.monotonically_increasing_id().alias("rid"))
    host = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    rows = rows.select("rid", "key", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    labels = rows.join(lengths, F.lit(True)).withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    tried = labels.select("rid", "key", "host", "path", F.explode(suffixes).alias("h"), starts.alias("starts")).select("rid", "key", "host", "path", "h", F.explode_outer("starts").alias("p"))
    found = tried.join(own, ["h", "p"], "left")
    best = F.max_by(F.struct(F.concat("h", "p").alias("rule"), "v"), F.when(F.col("v").isNotNull(), F.struct(F.length("h"), F.length("p"))))
    out = found.groupBy("rid", "key", "host", "path").agg(best.alias("x"))
    return out.select(F.col("key").alias(key), "host", "path", "x.rule", F.coalesce("x.v", F.lit(DEFAULT)).alias("verdict"))
