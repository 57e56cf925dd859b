"""Review, cross-resolution and reports on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import resolution as S, review as V


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "", "a"), (1, 2, "N1", ""), (1, 3, "N2", "b"), (1, 4, None, None)], "d int, p int, o string, s string")
    got = {x.p: (x.known_order, x.known_soldto) for x in V.carried(pages, "d", "p", "o", "s").collect()}
    assert got == {1: (None, None), 2: (None, "a"), 3: ("N1", "a"), 4: ("N1", "b")}
    values = spark.createDataFrame([(1, 1, "k", "x"), (1, 2, "k", None), (1, 1, "m", "y"), (1, 9, "m", "z")], "d int, p int, key string, v string")
    assert {x.key: x.v for x in V.merged_pages(values, "d", "p", "key", "v", 5).collect()} == {"k": None, "m": "y"}
    lines = spark.createDataFrame([(1, 0, "## Clients"), (1, 1, "a"), (1, 2, "## Sites"), (1, 3, "b"), (1, 4, "## Other sites"), (1, 5, "c")], "g int, i int, t string")
    assert [x.t for x in V.section(lines, "g", "i", "t", "SITE").orderBy("i").collect()] == ["## Sites", "b"]


def test_corrections(spark):
    schema = "o int, place int, article string, description string, quantity string, unit_price string, unit string"
    extracted = spark.createDataFrame([(1, 1, "A", "", "2", "", ""), (2, 1, "B", "", "3", "", "M"), (3, 1, "C", "", "4", "", None)], schema)
    fixed = spark.createDataFrame([(1, 1, " D ", "", "", "", " "), (1, 2, "Article_Manquant-7", "", None, "", None)], schema)
    got = {(x.o, x.place): (x.article, x.quantity, x.unit, x.source, x.skipped) for x in V.corrected_lines(extracted, fixed, "o", spark.createDataFrame([(3,)], "o int")).collect()}
    assert got == {(1, 1): ("D", "1", "PCE", "review", False), (1, 2): ("Article_Manquant-7", "1", "PCE", "review", True), (2, 1): ("B", "3", "M", "extraction", False)}


def test_checks_and_differences(spark):
    rows = spark.createDataFrame([("confirmed", "1", "1"), ("confirmed", "1", "2"), ("confirmed", "1", ""), ("unknown", "", "2"), ("none", None, None), ("none", None, "3")], "s string, k string, c string")
    assert [x[0] for x in rows.select(V.cross_checked(F.col("s"), F.col("k"), F.col("c"))).collect()] == ["consistent", "conflict", "site_not_validated", "order_unknown", "insufficient", "to_check"]
    gate = V.generation_gate(F.lit(True), {"po": F.col("k"), "soldto": F.col("c")}, F.lit(0))
    assert [x[0] for x in rows.select(gate).collect()] == ["no_lines", "no_lines", "soldto_missing", "po_missing", "po_missing", "po_missing"]
    actual = spark.createDataFrame([(1, '{"a": {"b": "x"}, "lines": [1, 2]}'), (2, "{}")], "d int, body string")
    expected = spark.createDataFrame([(1, "a.b", "x"), (1, "lines_min_count", "2"), (1, "a.c", "y"), (2, "lines_min_count", "1"), (3, "a", "z")], "d int, path string, value string")
    assert sorted((x.d, x.path, x.got) for x in V.differences(actual, expected, "d").collect()) == [(1, "a.c", None), (2, "lines_min_count", "0"), (3, "a", None)]
    empty = V.batch_report(spark.createDataFrame([], "error string, address_score int, site_score int, site_status string")).head()
    assert (empty.files, empty.address_share) == (0, 0.0)


def test_answers_and_settings(spark):
    row = spark.createDataFrame([("<box><100><200><300><400></box> and <box><500><10></box>",), ("none",), (None,)], "a string")
    got = row.select(V.boxes(F.col("a"), F.lit(1000), F.lit(500)).alias("b"), V.points(F.col("a"), F.lit(1000), F.lit(500)).alias("p")).collect()
    assert [tuple(x) for x in got[0].b] == [(100.0, 100.0, 300.0, 200.0)] and [tuple(x) for x in got[0].p] == [(500.0, 5.0)]
    assert got[1].b == [] and got[2].b is None
    raw = spark.createDataFrame([({"host": " h ", "port": "70000", "ttl": "x", "on": "Yes", "other": "1"},)], "m map<string,string>")
    assert raw.select(V.settings(F.col("m"), ["host"], ["on"], {"port": (1, 65535, 22), "ttl": (15, 1440, 480)})).head()[0] == {"host": "h", "port": "65535", "ttl": "480", "on": "true"}


SITES = "soldto string, id string, place int, name string, street string, postal string, city string"


def test_cross_resolution(spark):
    sites = spark.createDataFrame([("1", "1", 1, "DUPONT", "1 RUE A", "75001", "PARIS"), ("1", "11", 2, "DUPONT NORD", "3 AVENUE FOCH", "59000", "LILLE"), ("2", "2", 1, "MARTIN", "", "31000", "TOULOUSE")], SITES)
    docs = spark.createDataFrame([(1, "Dupont 1 rue A 75001 Paris, livraison 59000 Lille", "59000", "Lille"), (2, "31000 toulouse dupont martin", None, None), (3, "rien", None, None), (4, None, None, None), (5, "x", None, None)], "d int, text string, postal string, city string")
    leads = spark.createDataFrame([(1, "vat_siren", 1, "1"), (1, "client_number", 1, "1"), (2, "name_match", 1, "1"), (2, "name_match", 2, "2"), (3, "order_bstnk", 1, "2"), (5, "vat_siren", 1, "9")], "d int, path string, place int, soldto string")
    got = {x.d: (x.soldto, x.path, x.id, x.points, x.confidence, x.status) for x in S.cross_resolve(docs, leads, sites, "d").collect()}
    assert got == {
        1: ("1", "client_number", "11", 105, 95, "validated"), 2: ("2", "name_match_scored", "2", 90, 95, "validated"), 3: ("2", "order_bstnk", "2", 0, 70, "only_site"),
        4: (None, None, None, None, None, "no_customer"), 5: ("9", "vat_siren", None, None, None, "no_site"),
    }


def test_preferred_and_text_points(spark):
    rows = spark.createDataFrame([(1, 1, 90.0, False), (1, 2, 80.0, True), (1, 3, 70.0, True), (2, 1, 50.0, None)], "g int, i int, s double, ok boolean")
    got = {(x.g, x.i): (x["rank"], x.filtered) for x in S.preferred(rows, "g", "s", "i", F.col("ok")).collect()}
    assert got == {(1, 2): (1, True), (1, 1): (2, True), (1, 3): (3, True), (2, 1): (1, False)}
    whole = spark.createDataFrame([("detected", "59000", "LILLE", "3 RUE A", "X", True, "high", "X\n3 RUE A\n59000 LILLE"), ("detected", "59000", None, None, None, False, "medium", "prix 59000 75001"), ("label_only", *[None] * 4, None, None, None), ("none", *[None] * 4, None, None, None)], "a string, b string, c string, e string, f string, g boolean, h string, i string")
    assert [x[0] for x in whole.select(S.text_points(*map(F.col, "abcefghi"))).collect()] == [145, 0, 15, 0]
