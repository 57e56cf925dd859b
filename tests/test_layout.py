"""Tables from words on a page, pooled vectors, drifting answers, cleaned addresses, and functions that no query calls."""

from __future__ import annotations

import math
import time

from pyspark.sql import functions as F

from tallyloom.functions import extract as X2
from tallyloom.operators import answers as A, batch, delivery as D, edifact, evidence as E, intake as I, joins as J, resolution as X, tables as T, vectors as V


def test_columns_follow_the_gaps_and_rows_the_bands(spark):
    box = lambda page, text, x0, y0, width=20: (page, text, float(x0), float(y0), float(x0 + width), float(y0 + 10))
    words = [box(1, "Purchase", 10, 0, 300), box(1, "Order", 315, 0)]  # running text across all columns is no row
    words += [box(1, "Réf.", 10, 50), box(1, "Désignation", 60, 50, 60), box(1, "Qté", 150, 51), box(1, "Prix", 200, 50)]
    words += [box(1, "AB12", 12, 70), box(1, "Steel", 60, 71), box(1, "bolt", 84, 71), box(1, "3", 160, 70, 5), box(1, "12,50", 195, 70, 25)]
    words += [box(1, "CD-34", 8, 90), box(1, "Nut", 65, 90), box(1, "1", 155, 92, 5)]  # no price
    words += [box(1, "PORT", 10, 110), box(1, "x", 70, 110), box(1, "1", 150, 110), box(1, "9,00", 200, 110)]  # freight is no line
    words += [box(1, "EF5", 10, 130), box(1, "y", 70, 130), box(1, "0", 150, 130), box(1, "9,00", 200, 130)]
    words += [box(2, "no", 1, 1), box(2, "table", 40, 1), (2, None, 1.0, 1.0, 2.0, 2.0), (3, "a", None, 1.0, 2.0, 2.0)]
    rows = spark.createDataFrame(words + words[6:7], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    cells = {(x.page, x.band, x.col): x.text for x in T.table_cells(rows, ["page"]).collect()}
    assert {k for k in cells if k[1] == 3} == {(1, 3, c) for c in (1, 2, 3, 4)} and cells[1, 3, 2] == "Steel bolt" and cells[1, 3, 1] == "AB12 AB12" and (2, 1, 1) not in cells
    found = T.table_rows(T.table_cells(rows.dropDuplicates(), ["page"]), ["page"], {"article": "ref", "quantity": "qte", "price": "prix"})
    got = [(x.line, x.article, x.quantity, x.price, x.total) for x in T.line_items(found, ["page"]).orderBy("line").collect()]
    assert got == [(10, "AB12", 3.0, 12.5, 37.5), (20, "CD34", 1.0, None, None)]
    assert T.table_cells(rows.limit(0), ["page"]).count() == 0
    sweep = T.swept(spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 9, 12), (1, 14, 15), (2, 0, 1)], "k int, a int, b int"), ["k"], "a", "b", 1, "n")
    assert sorted((x.k, x.a, x.n) for x in sweep.collect()) == [(1, 0, 1), (1, 2, 1), (1, 9, 1), (1, 14, 2), (2, 0, 1)]


def test_later_parsers_add_what_earlier_ones_lack(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "d int, article string, quantity int")
    got = T.first_of_parsers([rows((1, "A", 1), (1, "B", 2)), rows((1, "A", 1), (1, "A", 5), (2, None, 1)), rows((1, "A", 9), (1, "C", 1), (2, None, 7))], "d", [["article", "quantity"], ["article"]], ["article", "quantity"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "A", 1, 0), (1, "B", 2, 0), (1, "A", 5, 1), (2, None, 1, 1), (1, "C", 1, 2)]))


def test_pooled_vectors(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0], 1), ("a", [0.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [0.0, 0.0], 1), ("c", [1.0], 1), ("c", None, 1), ("d", [None, -2.0], 1), (None, [1.0, 0.0], 1)], "k string, v array<double>, mask int")
    got = {x.k: (x.vector, x.n) for x in V.mean_pooled(rows, "k", "v", 2, F.col("mask") == 1).collect()}
    assert got["a"][1] == 2 and all(math.isclose(x, y) for x, y in zip(got["a"][0], (0.6, 0.8))) and got["b"] == ([0.0, 0.0], 1) and got["d"] == ([0.0, -1.0], 1) and "c" not in got and None in got
    bonus = spark.createDataFrame([(0.55,), (0.549,), (1.0,), (0.99,), (None,), (-1.0,)], "s double").select(V.similarity_bonus(F.col("s")).alias("b"))
    assert [x.b for x in bonus.collect()] == [13, 0, 25, 24, 0, 0]
    scored = spark.createDataFrame([(1, "x", 40.0, ["CITY"]), (1, "y", 45.0, []), (2, "x", 1.0, [])], "doc int, id string, score double, reasons array<string>")
    parts = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.2])], "doc int, vector array<double>")
    sites = spark.createDataFrame([("x", [1.0, 0.5]), ("y", [0.0, 1.0])], "id string, vector array<double>")
    got = {(x.doc, x.id): (x.score, x.reasons) for x in V.with_similarity(scored, parts, sites, "doc", 2).collect()}
    assert got == {(1, "x"): (63.0, ["CITY", "EMBEDDING_MATCH"]), (1, "y"): (45.0, []), (2, "x"): (1.0, [])}


def test_answers_keep_what_drifts(spark):
    bodies = ['{"po": 12, "lines": [{"ref": "a", "n": "1 200,50"}, {"code": 7, "n": 2}], "extra": {"x": 1}}', 'Sure!\n```json\n{"order_key": " A1 ", "lines": {"ref": "b", "n": true}}\n```', "[1, 2]", '{"order_key": {"no": 1}, "po": null}', "", None, '{"order_key": "x", "lines": null}', "{broken"]
    fields = {"number": (["$.order_key", "$.po"], "text"), "lines": (["$.lines"], "list")}
    rows = A.answer_fields(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"), "body", fields)
    got = {x.k: (x.number, x.drift) for x in rows.select("k", "number", "drift").collect()}
    assert got == {0: ("12", ["number"]), 1: ("A1", ["lines"]), 2: (None, []), 3: (None, []), 4: (None, []), 5: (None, []), 6: ("x", []), 7: (None, [])}
    lines = A.answer_lines(rows, "k", "lines", {"article": (["$.ref", "$.code"], "text"), "n": (["$.n"], "number"), "flag": (["$.n"], "flag"), "whole": (["$.n"], "whole")})
    assert sorted(map(tuple, lines.collect())) == [(0, 1, "a", 1200.5, None, None), (0, 2, "7", 2.0, None, 2), (1, 1, "b", None, True, None)]
    assert rows.filter("k = 0").select(F.try_variant_get("answer", "$.extra.x", "int").alias("x")).head().x == 1  # a field that nobody asked for


def test_addresses_are_cleaned_and_rebuilt(spark):
    schema = "k int, name string, street string, complement string, postal string, city string, country string, address string"
    rows = [
        (1, "A livrer a l'adresse ci-dessous : / PPC", "28 rue Croix Barret", None, "69007", "LYON", "FRANCE", "A livrer a l'adresse ci-dessous :\nPPC\n28 rue Croix Barret\n69007 LYON\nFRANCE\ncolisages separes a identifier"),
        (2, "Chantier DUPONT / DUPONT / Livraison : Hall 3 Tel : 01", "93700 DRANCY", "BP 12 / BP 12", "69007", "LYON", "fr", "12 avenue Foch - quai 2\n93700 DRANCY\n69007 LYON"),
        (3, None, None, None, None, None, None, None),
        (4, "a DURAND et fils", "1234 rue Haute", None, "75001", "PARIS", "Belgique", "x@y.fr"),
        (5, "ACME, 9 quai Sud", "9 quai Sud", "etage 2", "75001", "PARIS", "France", "PARIS\n9 quai Sud"),
    ]
    own = [{"organisations": ["acme"], "streets": ["quai sud"], "numbers": ["9"]}]
    got = {x.k: x for x in D.purified(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].address, got[1].name, got[1].cleaned) == ("PPC\n28 rue Croix Barret\n69007 LYON\nFRANCE", "PPC", True) and got[1].raw == rows[0][-1]
    assert (got[2].name, got[2].street, got[2].complement, got[2].country) == ("DUPONT / Hall 3", "12 avenue Foch", "BP 12", "FRANCE") and got[2].address == "DUPONT\nHall 3\n12 avenue Foch\nBP 12\n69007 LYON\nFRANCE"
    assert (got[3].name, got[3].street, got[3].address, got[3].country) == (None, None, "FRANCE", "FRANCE")
    assert (got[4].name, got[4].street, got[4].country) == ("DURAND et fils / x", "1234 rue Haute", "Belgique")  # a house number is no postal code
    inside = D.purified(spark.createDataFrame(rows[4:], schema), internal=own).head()
    assert inside.street is None and inside.complement == "etage 2" and got[5].street == "9 quai Sud"


def test_long_letters_take_little_longer(spark):
    block = ["ACME SARL", "12 rue de la Paix", "75001 PARIS", "adresse de livraison", "atelier nord", "69001 LYON", "facture a", "France"]
    docs = spark.createDataFrame([(1, "\n".join(block[k % 8] for k in range(4000)))], "doc int, text string")
    assert D.delivery_addresses(docs, "doc").head().postal == "69001"
    began = time.perf_counter()
    D.delivery_addresses(docs, "doc").collect()
    assert time.perf_counter() - began < 20  # a quadratic plan took over a minute


def test_numbers_of_forms_are_no_postal_codes(spark):
    lines = ["Reference 75001 PARIS", "bon de commande 69001 LYON", "Livre 13001 MARSEILLE", "PUTEAUX-92800PUTEAUX", "75 001PARIS", "BP 12 44000 NANTES"]
    got = [[tuple(y) for y in x.p] for x in spark.createDataFrame([(x,) for x in lines], "l string").select(D.line_pairs(F.col("l")).alias("p")).collect()]
    assert got == [[], [], [("13001", "MARSEILLE")], [("92800", "PUTEAUX")], [("75001", "PARIS")], []]


def test_functions_without_a_query(spark):
    row = spark.range(1)
    claim = lambda score, read, place, same: row.select(D.relaxed_claim(F.lit(score), F.lit(read), F.lit(place), F.lit(same)).alias("x")).head().x
    assert claim(10, False, "below", False) and claim(80, True, "above", True) and not claim(80, True, "above", False) and not claim(70, True, "above", True) and not claim(80, None, "above", True)
    precise = spark.createDataFrame([("a", " ", "c"), ("a", None, ""), (" ", "b", "c")], "s string, p string, c string").select(D.precise(F.col("s"), F.col("p"), F.col("c")).alias("x"))
    assert [x.x for x in precise.collect()] == [True, False, False]
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")]))
    assert [tuple(x) for x in I.copied_once(old, new, "k", False).collect()] == [(2, "c")] and I.copied_once(old, new, "k", True).count() == 0
    lines = spark.createDataFrame([(["LIN+1", "QTY+21:2:PCE", "PRI+AAA:1"], "03/05/2024"), (["LIN+1"], "03/05/2024"), (["QTY+21:2:PCE"], "soon")], "segments array<string>, delivery_date string")
    assert [x.segments for x in batch.dated_lines(lines).collect()] == [["LIN+1", "QTY+21:2:PCE", "DTM+2:20240503:102", "PRI+AAA:1"], ["LIN+1"], ["QTY+21:2:PCE"]]
    assert row.select(edifact.party_warnings("BY", F.lit(" "), F.lit("x"), F.lit(None).cast("string")).alias("x")).head().x == ["BY_CODE_MISSING", "BY_CITY_MISSING"]
    keys, found = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "e")], "k int, id string")
    searched = spark.createDataFrame([(1, "s"), (2, "s"), (2, "t")], "k int, id string")
    assert sorted(map(tuple, J.with_search(keys, found, searched, "k").collect())) == [(1, "e", "evidence"), (2, "s", "searched"), (2, "t", "searched")]


def test_sites_in_several_arrays_score_as_in_one(spark, monkeypatch):
    docs = spark.createDataFrame([(k, k % 2, f"Adresse de livraison 12 rue Verte 7500{k % 5} PARIS\nfacture a 69001 LYON", "69001") for k in range(6)] + [(9, 5, None, None)], "d int, soldto int, text string, soldto_postal string")
    sites = spark.createDataFrame([(k % 2, f"s{k}", k, f"N{k}", "12 rue Verte" if k % 3 else None, ["75000", "75001", "750", "", None][k % 5], "PARIS") for k in range(40)] + [(None, "x", 1, "a", "b", "c", "d")], "soldto int, id string, ordinal int, name string, street string, postal string, city string")
    leads = spark.createDataFrame([(k, "vat", p, s) for k in range(6) for p, s in ((0, k % 2), (1, 7))], "d int, path string, place int, soldto int")
    found = docs.select("d", "text", F.lit("75001").alias("postal"), F.lit("PARIS").alias("city"))
    spots = sites.withColumnRenamed("ordinal", "place")
    path = X.PATHS[-1]
    docs, sites, leads, spots = (x.withColumn("soldto", F.col("soldto").cast("string")) for x in (docs, sites, leads, spots))
    run = lambda: (sorted(map(repr, map(tuple, E.score_sites(docs, sites, "d").collect()))), sorted(map(repr, map(tuple, X.cross_resolve(found, leads.withColumn("path", F.lit(path)), spots, "d").collect()))))
    whole = run()
    monkeypatch.setattr(E.together, "__defaults__", (3,))
    assert run() == whole and len(whole[0]) == 120 and len(whole[1]) == 7


def test_candidate_fields_and_checklists(spark):
    text = "Tél 01 23 45 67 89, tel +33 1 23 45 67 89\nMONTANT TOTAL : 1 234,50 EUR\nmontant  total : 1 234,50 eur\nClient Été SA\nclient ete sa\na@b.fr A@B.fr 12/05/2024 2024-05-12\nDE89 3704 0044 0532 0130 00 / FR14 2004 1010 0505 0001 3M02 606 / DE00 3704 0044 0532 0130 00"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(X2.candidate_fields(F.col("t")).alias("x")).select("x.*").collect()
    assert got[0].phones == ["01 23 45 67 89", "0532 0130 00"] and got[0].emails == ["a@b.fr"] and got[0].dates == ["12/05/2024", "2024-05-12"] and got[0].clients == ["Client Été SA"] and got[0].totals == ["MONTANT TOTAL : 1 234,50 EUR"]
    assert all(x == [] for x in got[1])
    ibans = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("FR1420041010050500013M02606",), ("DE00370400440532013000",), ("",), (None,)], "i string").select(X2.valid_iban(F.col("i")).alias("ok"))
    assert [x.ok for x in ibans.collect()] == [True, True, False, False, None]
    points = spark.createDataFrame([("UNA:+.? 'UNB+UNOC:3+S+R'UNH+1'BGM+220'DTM+137:1'NAD+BY+1'NAD+DP+1'LIN+1'PIA+1'QTY+21'UNZ+1'",), (None,)], "m string").select(edifact.checklist(F.col("m"), "+S+", "+R'").alias("c")).collect()
    assert len(points[0].c) == 13 and all(x.ok for x in points[0].c) and not any(x.ok for x in points[1].c) and [x.required for x in points[0].c] == [True] * 11 + [False] * 2


def test_cells_of_a_page_are_worked_out_once(spark):
    head = [("Ref Qte", 1), ("Qte", 2), ("Prix", 3), ("Prix", 4)]
    cells = [(1, 1, "ref", 1), *((1, 2, *x) for x in head), (1, 3, "a", 1), (1, 3, "2", 2), (1, 4, "x", 4), (1, 5, "b", 1), (1, 5, "9", 3), (1, 5, "8", 4), (2, 1, "ref", 1), (2, 2, "c", 1), (None, 1, "ref", 1), (None, 1, "qte", 2), (None, 2, "d", 1)]
    found = T.table_rows(spark.createDataFrame(cells, "page int, band int, text string, col int"), ["page"], {"article": r"\bref\b", "quantity": r"\bqte\b", "price": r"\bprix\b"})
    assert sorted(map(tuple, found.select("page", "band", "article", "quantity", "price").collect())) == [(1, 3, "a", "2", None), (1, 5, "b", None, "9")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
