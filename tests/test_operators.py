"""Operators on small tables with ties, nulls and empty inputs."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from tallyloom.operators import edifact, geometry, joins as J, matching as M, ranking as R, rules, store


def test_best_and_gap_keep_the_inputs_order(spark):
    rows = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 50.0), ("b", 1, 80.0), ("b", 2, 60.0), ("c", 1, 10.0)], "g string, i int, score double")
    got = {x.g: (x.i, x.second, x.clear) for x in R.best_and_gap(rows, "g", "score", "i").collect()}
    assert got == {"a": (1, 50.0, False), "b": (1, 60.0, True), "c": (1, None, True)}
    assert [(x.g, x.i) for x in R.ties_with_best(rows, "g", "score", "i").collect()] == [("a", 2)]
    assert R.best_and_gap(rows.limit(0), "g", "score", "i").count() == 0


def test_flag_fallback_and_numbering(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("b", 1, False), ("b", 2, None)], "g string, i int, f boolean")
    kept = R.flagged_or_all(rows, "g", F.col("f")).select("g", "i").collect()
    assert sorted(map(tuple, kept)) == [("a", 1), ("b", 1), ("b", 2)]
    assert sorted((x.g, x.line_number) for x in R.numbered(rows, "g", [F.asc("i")]).collect()) == [("a", 10), ("a", 20), ("b", 10), ("b", 20)]
    ids = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, id string").withColumn("g", F.lit(1))
    assert {x.i: x.id for x in R.suffixed(ids, "g", "id", [F.asc("i")]).collect()} == {1: "x", 2: "x-2", 3: "y"}


def test_token_matches_against_all_pairs(spark):
    r = random.Random(1)
    sets = {k: [f"w{w}" for w in r.sample(range(12), r.randrange(1, 7))] for k in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "a int, t array<string>")
    got = {(x.a, x.b): round(x.jaccard, 6) for x in J.token_matches(rows, rows.select(F.col("a").alias("b"), F.col("t").alias("u")), "a", "t", "b", "u", 60.0).collect()}
    want = {}
    for a, b in itertools.product(sets, sets):
        x, y = set(sets[a]), set(sets[b])
        if 100 * len(x & y) >= 60 * len(x | y):
            want[a, b] = round(100 * len(x & y) / len(x | y), 6)
    assert got == want


def test_full_outer_newest(spark):
    schema = "k int, v string, at string"
    left = spark.createDataFrame([(1, "l", "2"), (2, "l", "2"), (3, "l", None), (4, "l", "1")], schema)
    right = spark.createDataFrame([(1, "r", "3"), (2, "r", "2"), (3, "r", "1"), (5, "r", None)], schema)
    assert {x.k: x.v for x in J.full_outer_newest(left, right, "k", "at").collect()} == {1: "r", 2: "l", 3: "r", 4: "l", 5: "r"}


def test_mentions_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "Delivery to Saint-Malo today"), (2, "saintmalo"), (3, None)], "i int, text string")
    names = spark.createDataFrame([("SAINT MALO",), ("today",), ("day",), ("",)], "name string")
    assert sorted(map(tuple, J.mentions(texts, names, "i", "text", "name").collect())) == [(1, "SAINT MALO"), (1, "today")]


def test_parties(spark):
    master = spark.createDataFrame([("15000000", 1, "ALSACE CHAUFFAGE", "1 rue A", "67500", "HAGUENAU", "FR1"), ("16000000", 2, "PARIS SANITAIRE", "2 rue B", "75001", "PARIS", "FR2"), ("17000000", 3, "BORDEAUX EAU", "3 rue C", "33000", "BORDEAUX", "")], "id string, ordinal int, name string, street string, postal string, city string, vat string")
    queries = spark.createDataFrame([(1, "Alsace Chauffage", "", "67500", "Haguenau", ""), (2, "", "", "", "", "fr 2"), (3, "Nobody", "", "99999", "Nowhere", ""), (4, None, None, None, None, None)], "q int, name string, street string, postal string, city string, vat string")
    got = {x.q: (x.id, x.status) for x in M.match_parties(queries, master, "q").collect()}
    assert got == {1: ("15000000", "matched"), 2: ("16000000", "matched"), 3: (None, "low"), 4: (None, "low")}  # scored against all rows, without a point


def test_articles(spark):
    lines = spark.createDataFrame([(1, "3700000000001", "C1", "x"), (2, None, "c1", "x"), (3, None, "7099018", None), (4, None, None, "joint torique noir"), (5, None, "??", "nothing like it"), (6, None, "8716796114", None)], "i int, ean string, article string, description string")
    ean = spark.createDataFrame([("3700000000001", "7099018")], "k string, v string")
    code = spark.createDataFrame([("C1", "7738113621")], "k string, v string")
    master = spark.createDataFrame([("7099018", "Joint torique", 1), ("8716796114", "ETIQ REGL GAZ G20", 2), ("7738113621", "CS38 FR GC9000iW", 3)], "matnr string, text string, ordinal int")
    gone, raw = spark.createDataFrame([("7738113621",)], "k string"), spark.createDataFrame([("8716796114",)], "k string")
    got = {x.i: (x.matnr, x.method, x.error) for x in M.resolve_articles(lines, "i", ean, code, master, gone, raw).collect()}
    assert got == {1: ("7099018", "ean", None), 2: ("7738113621", "customer_code", "DISCONTINUED_MATERIAL"), 3: ("7099018", "direct", None), 4: ("7099018", "fuzzy", None), 5: (None, None, "UNKNOWN_MATERIAL"), 6: ("8716796114", "direct", "ROH_NONCOMMERCIAL")}


def test_rule_sets_differ(spark):
    rows = spark.createDataFrame([("A1", 2.0, 0.0, False), ("A1", 0.0, 1.0, True), ("-", 1.0, None, True)], "a string, q double, p double, known boolean")
    codes = lambda s: [[f.code + ":" + f.severity[0] for f in x.f] for x in rows.select(rules.line_rules(s, F.col("a"), F.col("q"), F.col("p"), F.col("known")).alias("f")).collect()]
    assert codes("A") == [["ARTICLE_UNKNOWN:b", "PRICE_MISSING:w"], ["QUANTITY_MISSING:b"], ["ARTICLE_MISSING:b", "PRICE_MISSING:w"]]
    assert codes("B") == [["ARTICLE_UNKNOWN:w"], ["QUANTITY_MISSING:b"], ["ARTICLE_MISSING:b", "PRICE_MISSING:w"]]
    f = rules.line_rules("B", F.col("a"), F.col("q"), F.col("p"), F.col("known"))
    assert [tuple(x) for x in rows.select(rules.decision(f), rules.leading_code(f)).collect()] == [("REVIEW_REQUIRED", "ARTICLE_UNKNOWN"), ("REJECTED", "QUANTITY_MISSING"), ("REJECTED", "ARTICLE_MISSING")]


def test_messages_pass_their_own_checks(spark):
    orders = spark.createDataFrame([(1, "PO'1", "20260624", "15000000", "15019226"), (2, "P2", "20260624", "1", "2")], "k int, po_number string, order_date string, buyer string, site string")
    lines = spark.createDataFrame([(1, 20, "A2", "two", 1.5, "PCE", None), (1, 10, "A1", "o+ne", 2.0, "PCE", 3.25)], "k int, line_number int, article string, description string, quantity double, unit string, price double")
    got = edifact.build_messages(orders, lines, "k").withColumn("bad", edifact.checks(F.col("message"))).collect()
    assert [x.k for x in got] == [1] and got[0].bad == []
    text = got[0].message.replace("\n", "")
    assert "BGM+220+PO?'1+9'" in text and "LIN+10'PIA" in text and text.index("LIN+10") < text.index("LIN+20") and "QTY+21:1.5:PCE'" in text and f"UNT+{got[0].segments}+1'" in text
    broken = spark.createDataFrame([("UNB+x'UNH+1'UNT+9+1'",), ("",)], "m string")
    assert ["WRONG_UNT" in x.b and "MISSING_LIN" in x.b for x in broken.select(edifact.checks(F.col("m")).alias("b")).collect()] == [True, True]


def test_states(spark):
    log = spark.createDataFrame([(1, 1, "a", None, False), (1, 2, None, "x", False), (2, 1, "b", None, False), (2, 2, "b", None, True)], "k int, seq int, a string, b string, deleted boolean")
    assert [(x.k, x.a, x.b) for x in store.latest_state(log, "k").collect()] == [(1, None, "x")]
    assert {x.k: (x.a, x.b) for x in store.patched_state(log, "k", ["a", "b"]).collect()} == {1: ("a", "x"), 2: ("b", None)}
    moves = spark.createDataFrame([("RECEIVED", "PROCESSING"), ("COMPLETED", "RETRY"), ("FAILED", "RETRY")], "before string, after string")
    assert sorted(x.before for x in store.allowed(moves).collect()) == ["FAILED", "RECEIVED"]


def test_geometry(spark):
    words = spark.createDataFrame([(1, 0, 0, "b", 20.0, 0.0, 30.0, 5.0), (1, 0, 0, "a", 0.0, 1.0, 10.0, 6.0), (1, 0, 1, "c", 0.0, 10.0, 10.0, 15.0)], "page int, block int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {x.line: (x.text, x.x0, x.y0, x.x1, x.y1) for x in geometry.lines_from_words(words, ["page"]).collect()}
    assert got[0] == ("a b", 0.0, 0.0, 30.0, 6.0)
    boxes = words.withColumn("i", F.monotonically_increasing_id())
    near = geometry.nearest_anchor(words.filter("text = 'a'").withColumn("box", F.lit(1)), words.filter("text <> 'a'").select("page", F.col("text").alias("anchor"), "x0", "y0", "x1", "y1"), ["page"], "box", "anchor").head()
    assert boxes.count() == 3 and near.anchor == "c"


def test_address_candidates_by_place(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    candidates = spark.createDataFrame([(1, "near", 70, 600.0, 800.0, 50.0, 120.0, 150.0, 140.0), (1, "far", 70, 600.0, 800.0, 500.0, 700.0, 590.0, 720.0), (2, "alone", 70, 600.0, 800.0, 0.0, 0.0, 1.0, 1.0)], f"page int, c string, quality int, width double, height double, {box}")
    anchors = spark.createDataFrame([(1, "positive", 0, 50.0, 100.0, 150.0, 110.0), (1, "negative", 1, 500.0, 690.0, 590.0, 699.0)], f"page int, kind string, place int, {box}")
    got = {x.c: (x.total, x.position) for x in geometry.placed_candidates(candidates, anchors, ["page"], "c").collect()}
    # near: 70 + 64 of 70 at 25 of 280 points' distance - 0, and 12 for the column; far: 70 + 0 - 65 % of 43 + 15 + 10, then - 45
    assert got == {"near": (100, "below"), "far": (0, "below"), "alone": (70, None)}
    rows = spark.createDataFrame([("31770", "COLOMIERS", "RUE", "X", "ok"), ("31770", None, "", "X", "ville_incompatible")], "p string, c string, s string, n string, v string")
    assert [x[0] for x in rows.select(geometry.quality(*map(F.col, "pcsnv"))).collect()] == [95, 0]
