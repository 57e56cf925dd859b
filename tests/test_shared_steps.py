"""Steps that many queries share do their work once, with the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import normalize as N
from tallyloom.operators import edifact, intake as I, matching as M
from tallyloom.plans import layout


def test_normalisers_pass_over_a_text_once(spark, capsys):
    blanks = spark.range(1, 0x10000).filter("id not between 55296 and 57343").select(F.decode(F.encode(F.chr(F.lit(65)), "UTF-8"), "UTF-8").alias("a"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert blanks.select(N.compact_text(F.concat("a", "c", "c", "a")).alias("got"), F.trim(F.regexp_replace(F.concat("a", "c", "c", "a"), r"(?U)\s+", " ")).alias("want")).filter("got <> want").count() == 0
    rows = spark.createDataFrame([("Élan  d'Été - 12, av Foch",), ("plain -- text  7",), ("ẞ ñ Å",), ("",), (None,)], "x string")
    x = F.col("x")
    old = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(x, N.ACCENTED, N.PLAIN)), "[^a-z0-9 ]", " "), " +", " "))
    got = rows.select(N.matcher_text(x).alias("a"), old.alias("b"), N.street_key(x).alias("s"), N.postal_digits(x).alias("d"), N.tokens(x).alias("w"))
    assert all(r.a == r.b for r in got.collect()) and [r.s for r in got.collect()][:2] == ["elan d ete 12 avenue foch", "plain text 7"] and [r.d for r in got.collect()][:2] == ["12", "7"]
    rows.select(N.tokens(x).alias("w")).explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(") == 1 and "octet_length(" in plan and "lambda" not in plan


def test_a_small_file_of_costly_rows_is_many_tasks(spark, tmp_path):
    spark.range(1, 50).selectExpr("id as c_custkey", "0 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "LYON")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert layout.purified_addresses(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_a_checklist_works_its_message_out_once(spark, capsys):
    spark.createDataFrame([("una",)], "m string").select(edifact.checklist(F.upper("m"), "S", "R").alias("x")).explain()
    assert capsys.readouterr().out.count("upper(") == 1


def test_the_first_trailer_is_the_one_that_counts(spark):
    text = "UNB+'UNH+1'BGM+220'NAD+BY+'NAD+DP+'LIN+1'UNT+x'CNT+2:y'CNT+2:1'UNT+7'"
    assert spark.createDataFrame([(text,)], "m string").select(edifact.checks(F.col("m")).alias("x")).head().x == ["WRONG_UNT", "WRONG_CNT"]


def test_similarities_are_held_a_few_at_a_time(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 5)]) for k in range(1, 60)], "id long, v array<double>")
    asked = rows.filter("id % 3 = 0").withColumnRenamed("id", "q")
    plain = lambda: sorted(map(tuple, M.cosine_top_k(asked, rows, "q", "id", "v", 3).collect()))
    whole = plain()
    monkeypatch.setattr(M, "CELLS", 40)
    assert plain() == whole and len(whole) == 19 * 3
    assert 38 in {x[1] for x in whole if x[0] == 3}  # the only equal vector


def test_equal_descriptions_are_looked_for_once(spark, monkeypatch):
    seen, match = [], M.token_matches
    monkeypatch.setattr(M, "token_matches", lambda a, b, *more: seen.append((a.count(), b.count())) or match(a, b, *more))
    lines = spark.createDataFrame([(k, None, None, ["red big bolt", "blue small nut", ""][k % 3]) for k in range(30)], "id int, ean string, article string, description string")
    master = spark.createDataFrame([(f"m{k}", f"{['bolt red big', 'nut blue small tin'][k % 2]} {k}", k) for k in range(40)], "matnr string, text string, ordinal int")
    none = spark.createDataFrame([], "k string, v string")
    got = {x.id: (x.matnr, x.method) for x in M.resolve_articles(lines, "id", none, none, master, none.select("k"), none.select("k")).collect()}
    assert seen == [(2, 2)] and got == {k: [("m0", "fuzzy"), (None, None), (None, None)][k % 3] for k in range(30)}


def test_words_that_no_order_asks_for_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(I, "COMMON", 3, raising=False)
    orders = spark.createDataFrame([(k, None, None, f"ORDER{k}_x.pdf") for k in range(20)], "id int, path string, upload_id string, file_name string")
    files = spark.createDataFrame([(f"/f/{k}", f"upl-order{k}_x.pdf") for k in range(20)], "path string, name string")
    plan = I.document_paths(orders, spark.createDataFrame([], "upload_id string, path string"), files, "id")
    assert {x.id: x.path for x in plan.collect()} == {k: f"/f/{k}" for k in range(20)}
    assert "LeftAnti" in plan._jdf.queryExecution().executedPlan().toString()
