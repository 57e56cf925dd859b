"""Scalar functions on small tables of inputs and expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import extract as X, normalize as N

CASES = [
    (N.fold_text, "Éàç-ŒUF", "eac-œuf"), (N.compact_text, "  a \t b\n", "a b"), (N.address_compare, "8, Chemin  de(s) Naudinats", "8 chemin de s naudinats"),
    (N.name_key, "Sté Générale", "STE GENERALE"), (N.alnum_key, "Sté Générale", "STEGENERALE"), (N.vat_key, "fr 46.444-768550", "FR46444768550"),
    (N.postal_padded, "1000", "01000"), (N.postal_padded, " 2A004 ", "2A004"), (N.postal_digits, "F-31770 X", "31770"), (N.order_key, "cm- 003\t1", "CM-0031"),
    (N.scoring_text, "12 av. St-Jean".replace(".", ""), "12 AVENUE SAINT JEAN"), (N.city_key, "Dijon Cedex 9", "dijon"), (N.street_key, "3 Bd Victor", "3 boulevard victor"),
    (N.article_code, "ELM 12-34", "1234"), (N.article_code, "PORTAIL", None), (N.article_code, "12345678901234", None), (N.edifact_escape, "a+b:c'd?", "a?+b?:c?'d??"), (N.edifact_safe, "a+b", "a b"),
    (N.order_shape, "CM-0031", "A2-94"), (N.format_decimal, "1 234,50", "1234.5"), (N.format_decimal, "0", None), (N.format_decimal, "2.0000005", "2.000001"), (N.format_decimal, "x", None),
    (N.compact_date, "31/12/2024", "20241231"), (N.compact_date, "2024-02-30", None), (N.compact_date, "20240131", "20240131"), (N.compact_date, "31012024", "20240131"), (N.compact_date, "soon", None),
    (N.siren_vat, "444 768 550", "FR46444768550"), (N.siren_vat, "542097944", "FR89542097944"), (N.siren_vat, "12", None), (N.luhn_valid, "4111 1111 1111 1111", True), (N.luhn_valid, "4111 1111 1111 1112", False), (N.luhn_valid, "", False),
    (N.lenient_double, "1.234,56 EUR", 1234.56), (N.lenient_double, "1,234.56", 1234.56), (N.lenient_double, "-", None), (N.significant_tokens, "SAS Dupont et Fils", ["DUPONT", "FILS"]),
    (X.plausible_order, "660093502", True), (X.plausible_order, "12,50", False), (X.salvaged_json, 'ok ```json {"a": 1}``` bye', '{"a": 1}'), (X.salvaged_json, "no", None),
    (lambda c: X.label_amount(c, "Total TTC"), "Total TTC : 1 234,56 EUR", "1 234,56"), (lambda c: X.label_amount(c, "Total TTC"), "Total TTC\n30,00", "30,00"), (X.order_number, "Bon de commande n° 660093502 Page 1", "660093502"),
    (lambda c: X.page_selection(c, F.lit(9)), "1, 3-5,3,12", [1, 3, 4, 5]), (lambda c: X.page_selection(c, F.lit(99)), "1-9", None), (lambda c: X.found(c, X.POSTAL), "31770 X 67500 31770", ["31770", "67500"]),
]


def test_scalars(spark):
    row = spark.range(1).select(*(make(F.lit(given)).alias(f"c{k}") for k, (make, given, _) in enumerate(CASES))).head()
    wrong = [(given, row[k], want) for k, (_, given, want) in enumerate(CASES) if row[k] != (pytest.approx(want) if isinstance(want, float) else want)]
    assert not wrong


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(*(f(null) for f in (N.fold_text, N.compact_text, N.name_key, N.postal_padded, N.article_code, N.format_decimal, N.compact_date, N.siren_vat))).head()
    assert list(row) == [None] * 8
