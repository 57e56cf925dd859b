"""Reviews, delivery addresses and readers on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import extract as X, normalize as N
from tallyloom.operators import addresses as A, delivery as D, geometry as G, intake as I, joins as J, line_items as L, matching as M, review as V
from tallyloom.sources import pages, tables


def one(spark, column):
    return spark.range(1).select(column).head()[0]


def test_lines_and_their_kinds(spark):
    text = "a  b\r\n\n| x | --- |  y z |\n12 rue du Pont"
    assert one(spark, D.document_lines(F.lit(text))) == ["a b", "x", "y z", "12 rue du Pont"]
    assert one(spark, D.document_lines(F.lit(None).cast("string"))) == []
    street = lambda x: one(spark, D.is_street(F.lit(x)))
    assert [street(x) for x in ("12 av. Foch", "rue Haute", "75001 rue x", "12 maisons", "truelle")] == [True, True, False, False, False]
    assert one(spark, D.is_complement(F.lit("B.P. 12"))) and not one(spark, D.is_complement(F.lit("Bpx")))
    assert one(spark, D.no_postal_code(F.lit("Réf. 75001"))) and not one(spark, D.no_postal_code(F.lit("75001 Paris")))
    assert one(spark, D.street_fragment(F.lit("ZI ll rue Haute - lot 3"))) == "11 rue Haute"
    assert one(spark, D.street_fragment(F.lit("Haute"))) == "Haute"
    pairs = lambda x: [tuple(p) for p in one(spark, D.line_pairs(F.lit(x)))]
    assert pairs("Depot 75 001 Paris, 69002Lyon - sud, 31000 quantite") == [("75001", "PARIS"), ("69002", "LYON"), ("31000", "")]
    assert one(spark, D.keyword_lines(F.lit("Total 1\nx\nTOTAL 1\nTotal 1"), ["total"])) == ["Total 1", "TOTAL 1"]
    assert one(spark, D.needs_reading(F.lit("short"))) and not one(spark, D.needs_reading(F.lit("Adresse de livraison: chez nous, au fond de la cour")))


RULES = [{"postals": ["75001"], "cities": ["paris"], "streets": ["rue du siege"], "numbers": ["4"], "organisations": ["notre maison"]}]


def test_own_addresses(spark):
    inside = lambda x: one(spark, D.internal_address(F.lit(x), RULES))
    assert [inside(x) for x in ("4 Rue du Siège", "9 rue du siege 75001 Paris", "notre maison rue du siege 75001 PARIS", "75001 Paris", "")] == [True, False, True, False, False]


def test_delivery_addresses_of_odd_texts(spark):
    own = "Adresse de livraison\n4 rue du siege\n75001 Paris\nautre\n.\n.\n.\n.\nDepot Nord\n8 rue Basse\n69001 Lyon\nFrance\nL69"
    texts = [None, "", "rien", "Adresse de livraison", own, "Adresse de livraison\nAtelier\nBP 3\n69001 Lyon\nFacturation\n", "Ne seront pas retires adresse de livraison\n69001 Lyon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {x.doc: x for x in D.delivery_addresses(docs, "doc", internal=RULES).collect()}
    assert [got[k].status for k in range(7)] == ["none", "none", "none", "label_only", "detected", "detected", "none"]
    assert (got[4].street, got[4].postal, got[4].city, got[4].country, got[4].site) == ("8 rue Basse", "69001", "LYON", "France", "L69")
    assert (got[5].street, got[5].complement, got[5].name, got[5].confidence) == (None, "BP 3", None, "medium")
    assert D.delivery_addresses(docs.limit(0), "doc").count() == 0


def test_layouts_and_options(spark):
    cands = spark.createDataFrame([(1, "a", "S", "75001", "Paris", "1 rue Haute", 60), (1, "b", "S", "1", "x", "autre chose", 90)], "doc long, candidate string, soldto string, postal string, city string, street string, geometry int")
    sites = spark.createDataFrame([("S", "s1", "75001", "PARIS", "1 rue haute"), ("S", "s2", "69001", "Lyon", "zzz")], "soldto string, id string, postal string, city string, street string")
    got = {(x.candidate, x.id): x.score for x in D.layout_scores(cands, sites, "doc").collect()}
    assert got == {("a", "s1"): 35 + 25 + 25 + 21, ("a", "s2"): 0, ("b", "s1"): 0, ("b", "s2"): 0}
    part = spark.createDataFrame([(1, "1 av Foch", "1000", "Bourg"), (1, "2 rue x", "75001", "Paris")], "doc long, street string, postal string, city string")
    again = spark.createDataFrame([(1, "1 avenue foch", "01000", "BOURG cedex"), (1, None, None, None)], "doc long, street string, postal string, city string")
    assert sorted((x.source, x.street) for x in D.united([part, again], "doc").collect()) == [(0, "1 av Foch"), (0, "2 rue x"), (1, None)]
    options = spark.createDataFrame([(1, True, False, True, None, 5, 1), (1, True, False, True, 3.0, 1, 2), (1, False, True, True, 0.0, 9, 3)], "doc long, valid boolean, matches boolean, closer boolean, distance double, score int, ordinal int")
    assert [x.ordinal for x in D.best_options(options, "doc", 2).orderBy("ordinal").collect()] == [1, 2]
    lines = spark.createDataFrame([(1, "LIEU DE", 600.0, 800.0, 10.0, 10.0, 60.0, 20.0), (1, "Livraison", 600.0, 800.0, 12.0, 22.0, 70.0, 32.0), (1, "livraison", 600.0, 800.0, 500.0, 700.0, 560.0, 710.0)], "page long, text string, width double, height double, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(x) for x in G.split_anchors(lines, ["page"]).collect()] == [(1, 10.0, 10.0, 70.0, 32.0)]


def test_parties_without_anything_in_common(spark):
    kind = "name string, street string, postal string, city string, vat string"
    queries = spark.createDataFrame([(1, "x", "", "", "", ""), (2, None, None, None, None, None), (3, "alpha sarl", "3 rue a", "75001", "paris", "")], f"q long, {kind}")
    master = spark.createDataFrame([(10, 1, "alpha", "3 rue a", "75001", "Paris", ""), (11, 2, "beta", "", "75009", "Paris", "")], f"id long, ordinal long, {kind}")
    got = {x.q: (x.id, x.score, x.second, x.gap, x.status) for x in M.match_parties(queries, master, "q").collect()}
    assert got[1] == got[2] == (None, 0.0, 0.0, 0.0, "low")
    assert got[3] == (10, 97.5, 45.0, 52.5, "matched")
    assert {x.status for x in M.match_parties(queries, master.limit(0), "q").collect()} == {"none"}


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    rows = [(k, [float((k * 7 + j * j) % 11 - 5) for j in range(4)]) for k in range(60)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.filter("id % 5 = 0").withColumnRenamed("id", "q")
    whole = sorted(map(tuple, M.cosine_top_k(q, v, "q", "id", "v", 3).collect()))
    monkeypatch.setattr(M, "QUERY_BYTES", 100)
    assert sorted(map(tuple, M.cosine_top_k(q, v, "q", "id", "v", 3).collect())) == whole and len(whole) == 36


def test_partners(spark):
    customers = spark.createDataFrame([("1", "FR 1"), ("2", "fr1"), ("3", None)], "soldto string, vat string")
    sites = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("2", "b", "y"), ("3", "c", "z")], "soldto string, id string, city string")
    got = sorted((x.soldto, x.id) for x in J.partners_of_vat(customers, sites, "soldto").collect())
    assert got == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "c")]
    orders = spark.createDataFrame([(1, "po 1"), (2, "none")], "k long, order_no string")
    sales = spark.createDataFrame([("PO1", "1", 1, 1), ("PO1", "2", 2, 2)], "order_no string, soldto string, at int, ordinal int")
    names = spark.createDataFrame([("2", "Two")], "soldto string, name string")
    assert sorted((x.k, x.soldto, x.partner) for x in J.with_partner_names(orders, sales, names, "k").collect()) == [(1, "2", "Two"), (2, None, None)]


def test_answers(spark):
    blocks = spark.createDataFrame([([("image", None), ("text", ""), ("text", "yes")],), ([("other", "so")],), ([],)], "b array<struct<kind:string,text:string>>")
    assert [x for x, in blocks.select(X.block_text(F.col("b"))).collect()] == ["yes", "so", None]
    got = one(spark, X.section_fields(F.lit("Nom\n 1 rue a\n75001 Paris \nTVA: FR12345678901")))
    assert tuple(got) == ("Nom", "1 rue a", "75001", "Paris", "FR12345678901")
    assert I.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "e": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 6}
    steps = one(spark, I.trace(F.lit(I.REVIEW), F.lit(False)))
    assert [x.state for x in steps] == ["completed"] * 4 + ["current", "pending", "pending"]
    lines = spark.createDataFrame([("m", k, t) for k, t in enumerate(["## A", "one", "Two", "three"])], "g string, i int, line string")
    assert [x.context for x in V.search_memo(lines, "g", "i", "line", "TWO", 1).collect()] == ["one\nTwo\nthree"]
    assert tuple(A.reference_counts(spark.createDataFrame([("1", ["a", "b"]), ("2", ["A"])], "postal string, cities array<string>")).head()) == (2, 2)


def test_tables_in_other_encodings(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Kunde;Ort\n7;Orléans – 5 €\n".encode("cp1252"))
    rows = tables.read_master(spark, f"{tmp_path}/w.csv", {"id": ["Kunde"]}, ["id"]).filter("id = '7'").collect()
    assert [x.asDict() for x in rows] == [{"id": "7", "ort": "Orléans – 5 €"}]
    (tmp_path / "u.csv").write_bytes("﻿Kunde;Ort\n7;é\n7;ü\n;x\n".encode())
    rows = tables.read_master(spark, f"{tmp_path}/u.csv", {"id": ["Kunde"]}, ["id"])
    assert [(x.id, x.ort) for x in tables.last_wins(rows, "id").collect()] == [("7", "ü")]
    with pytest.raises(ValueError):
        tables.read_master(spark, f"{tmp_path}/u.csv", {}, ["lacking"])
    contents = spark.createDataFrame([(bytearray("é€".encode()),), (bytearray("é€".encode("cp1252")),), (bytearray(b"\xe9\x81"),)], "b binary")
    assert [x for x, in contents.select(tables.decoded(F.col("b"))).collect()] == ["é€", "é€", "é\x81"]
    assert tables.missing_paths(spark, [f"{tmp_path}/u.csv", f"{tmp_path}/none"]) == [f"{tmp_path}/none"]
    profile = spark.createDataFrame([("A", "x")], "profile_id string, sender_id string")
    assert tables.check_profile(profile, {"profile_id": "A", "sender_id": "y"}) == ["sender_id is 'x', not 'y'"]
    assert tables.check_profile(profile.union(profile), {"profile_id": "A"}) == ["more than one profile"]
    assert [x.text for x in tables.read_texts(spark, str(tmp_path), "u.csv", 9).collect()] == ["Kunde;"]


def test_selected_pages(spark):
    rows = spark.createDataFrame([("f", k, "t") for k in range(1, 6)] + [("g", 1, "t"), ("h", 1, "t")], "path string, page int, text string")
    wanted = spark.createDataFrame([("f", "2,4-9"), ("h", "7")], "path string, selection string")
    assert sorted((x.path, x.page) for x in pages.selected_pages(rows, wanted).collect()) == [("f", 2), ("f", 4), ("f", 5), ("g", 1)]


def test_times(spark):
    assert str(one(spark, N.utc_time(F.lit("2024-01-02T03:04:05.5+01:00")))) == "2024-01-02 02:04:05.500000"
    assert one(spark, N.utc_time(F.lit("2024-01-02 at noon"))) is None


def test_answers_become_parameters(spark):
    body = '{"order_key": " A1 ", "document_date": "1/2/24", "soldto_keys": {"vat": "fr 12", "name": "Nom", "city": "X"}, "shipto_keys": {"name": "", "street": "s"}, "line_items": [{"article_code": "port x", "qty": 1}, {"article_code": "a9", "qty": "2,5", "unit_price": "1.20"}, {"article_code": "b", "qty": "none"}]}'
    rows = spark.createDataFrame([(1, body), (2, "{}"), (3, "no json"), (4, None)], "k int, body string")
    got = {x.k: x for x in I.build_parameters(rows, "k", "body").collect()}
    assert (got[1].order_number, got[1].order_date, got[1].soldto.code, got[1].shipto.name, got[1].shipto.street, got[1].shipto.city, got[1].shipto.country) == ("A1", "20240201", "FR12", "Nom", "s", "X", "FR")
    assert [(x.article, x.description, x.quantity, x.unit_price) for x in got[1].lines] == [("A9", "A9", 2.5, 1.2), ("B", "B", 1.0, 0.0)] and got[1].warnings == []
    assert len(got[2].warnings) == len(got[3].warnings) == len(got[4].warnings) == 4 and got[2].confidence == 0.5
    lines = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "o int, article string, amount double")
    orders = spark.createDataFrame([(1,), (2,)], "o int")
    assert sorted(map(tuple, I.preview(orders, lines, "o").collect())) == [(1, 2, 1, 3.0), (2, 0, 0, 0.0)]


def test_simple_lines(spark):
    docs = spark.createDataFrame([(1, "AB123; 2,5; Joint torique; 3.20 EUR\nno\nXYZ99 4 Vanne EAN: 1234567890123"), (2, None)], "d int, text string")
    got = [(x.article, x.quantity, x.unit_price, x.ean) for x in L.simple_lines(docs, "d").collect()]
    assert got == [("AB123", "2,5", "3.20", ""), ("XYZ99", "4", "", "1234567890123")]
