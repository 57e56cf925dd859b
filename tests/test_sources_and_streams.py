"""Readers, writers and streams: what is read back, and that a stream gives its batch form's rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import sinks, tables as S
from tallyloom.sources.pages import read_pages
from tallyloom.streaming import flows


def test_master_files(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("﻿SOLDTO;NAME1;PSTLZ;Other\n00015; A ;01000;x\n00016;B;;y\n", encoding="utf-8")
    rows = S.read_master(spark, str(path), {"soldto": ["SOLDTO", "KUNNR"], "name": ["NAME1"], "postal": ["PSTLZ"]}, ["soldto", "name"])
    assert rows.columns == ["soldto", "name", "postal", "other"] and [tuple(x) for x in rows.collect()] == [("00015", "A", "01000", "x"), ("00016", "B", "", "y")]
    with pytest.raises(ValueError):
        S.read_master(spark, str(path), {}, ["vat"])
    look = tmp_path / "l.csv"
    look.write_text("# comment\nean,matnr\na1,1\nA1,2\n,3\n")
    assert [tuple(x) for x in S.read_lookup(spark, str(look), "ean", "matnr").collect()] == [("A1", "2")]


def test_json_and_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(x.a for x in S.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect() if x.a) == [1, 2]
    (tmp_path / "p.json").write_text('[{"nom": "DRANCY", "codesPostaux": ["93700"]}, {"nom": "DIJON", "codesPostaux": ["21000", "21100"]}]')
    postal, city = S.read_postal_reference(spark, str(tmp_path / "p.json"))
    assert postal.count() == 3 and {x.city: x.postals for x in city.collect()}["DIJON"] == ["21000", "21100"]
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "b binary")
    assert [x[0] for x in raw.select(S.decoded(F.col("b"))).collect()] == ["é", "é"]


def test_delivery_is_tried_again(spark):
    rows = spark.createDataFrame([("a", "m"), ("bad", "m")], "file string, message string")

    def send(file, message):
        if file == "bad":
            raise OSError("refused")

    got = {x.file: (x.status, x.attempts, x.error) for x in sinks.deliver(rows, send, wait=lambda s: None).collect()}
    assert got == {"a": ("DELIVERED", 1, ""), "bad": ("FAILED", 3, "refused")}


def test_streams_equal_their_batch_form(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"u{k % 3}", 1_700_000_000 + 400 * k) for k in range(40)], "id int, user string, s long").select("id", "user", F.timestamp_seconds("s").alias("ts"))
    rows.unionAll(rows.filter("id < 5")).write.parquet(f"{tmp_path}/in")
    stream = flows.file_stream(spark, f"{tmp_path}/in", "id int, user string, ts timestamp")
    flows.run_available(flows.deduplicated(stream, ["id"], "ts", "1 day"), f"{tmp_path}/once", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 40
    flows.routed(stream.withColumn("decision", F.when(F.col("id") % 2 == 0, "send").otherwise("review")), {"send": f"{tmp_path}/send", "review": f"{tmp_path}/review"}, f"{tmp_path}/c2")
    assert spark.read.parquet(f"{tmp_path}/send").count() + spark.read.parquet(f"{tmp_path}/review").count() == 45
    assert flows.session_counts(rows, "ts", "user", "10 minutes").agg(F.sum("n")).head()[0] == 40


def test_pages_by_the_first_reader_that_gives_text(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 100)), ("b", bytearray(b"y"))], "path string, content binary")

    def first(content):
        raise ValueError("not mine") if content[:1] == b"x" else None

    got = {x.path: (x.page, x.reader, x.error) for x in read_pages(files, [("one", lambda c: [""] if c[:1] == b"y" else first(c)), ("two", lambda c: [c.decode()])]).collect()}
    assert got["a"] == (1, "two", None) and got["b"][0] is None and "under 80" in got["b"][2]
