"""Jobs and their outcomes as streams, deliveries made once, versions of master data, paged documents."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import Row, functions as F

from tallyloom.sources import documents as D, outbox, settings, sinks, snapshots as S
from tallyloom.streaming import flows
from tallyloom.streaming.jobs import MOVES, Job, Limits, _Machine, job_moves, moved, outcomes, state_in_rocksdb

LIMITS = Limits(processing=100, backoff=10, remembered=1000, attempts=2)
SECOND = 1_000_000


def test_moves_of_a_job():
    at = lambda s, seq, state: (s * SECOND, seq, state)
    job, rows = moved(Job(), LIMITS, 0, [at(1, 1, "PROCESSING"), at(2, 2, "RECEIVED"), at(3, 3, "PROCESSING"), at(5, 4, "RETRY"), at(120, 5, "PROCESSING"), at(130, 6, "DUPLICATE"), at(131, 7, None)])
    assert [(x[0], x[1] // SECOND, *x[2:]) for x in rows] == [
        (1, 1, None, "PROCESSING", False, "ILLEGAL", 0), (2, 2, None, "RECEIVED", True, "", 0), (3, 3, "RECEIVED", "PROCESSING", True, "", 1), (4, 5, "PROCESSING", "RETRY", False, "ILLEGAL", 1),
        (None, 103, "PROCESSING", "FAILED", True, "TIMEOUT", 1), (None, 113, "FAILED", "RETRY", True, "BACKOFF", 1), (5, 120, "RETRY", "PROCESSING", True, "", 2), (6, 130, "PROCESSING", "DUPLICATE", True, "", 2), (7, 131, "DUPLICATE", None, False, "ILLEGAL", 2),
    ]
    assert job == Job("DUPLICATE", 130 * SECOND, 2) and moved(job, LIMITS, 1130 * SECOND) == (Job(), [])
    again, rows = moved(Job("PROCESSING", 0, 2), LIMITS, 10**6 * SECOND)
    assert again == Job("FAILED", 100 * SECOND, 2) and len(rows) == 1  # no attempt is left


def test_a_stream_in_pieces_moves_jobs_as_one(spark, tmp_path):
    states = "RECEIVED PROCESSING COMPLETED FAILED RETRY".split()
    rows = [(k % 7, k, 1_700_000_000 + 17 * k, states[k * k % 5]) for k in range(200)] + [(None, 900, 1_700_000_000, "RECEIVED"), (3, 901, None, "RECEIVED")]
    schema = "job_id long, seq long, at timestamp, wanted string"
    table = spark.createDataFrame(rows, "job_id long, seq long, s long, wanted string").select("job_id", "seq", F.timestamp_seconds("s").alias("at"), "wanted").cache()
    want = []
    for job in range(7):
        mine = sorted((s * SECOND, seq, w) for j, seq, s, w in rows if j == job and s)
        want += [(job, *x) for x in moved(Job(), LIMITS, (1_700_000_000 + 17 * 199) * SECOND, mine)[1]]
    with state_in_rocksdb(spark):
        for pieces in (1, 4):
            folder = f"{tmp_path}/{pieces}"
            for k in range(pieces):
                table.filter((F.coalesce("seq", F.lit(0)) >= k * 200 // pieces) & ((F.col("seq") < (k + 1) * 200 // pieces) | (F.lit(k == pieces - 1)))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
                flows.run_available(job_moves(flows.file_stream(spark, f"{folder}/in", schema), LIMITS, "0 seconds"), f"{folder}/out", f"{folder}/state")
            got = spark.read.schema(MOVES).parquet(f"{folder}/out").withColumn("at", F.unix_micros("at")).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), pieces


def test_outcomes_of_streams_equal_those_of_tables(spark, tmp_path):
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c) * 3600)
    jobs = spark.createDataFrame([(k, 10 * k) for k in range(30)] + [(99, 5000)], "job_id long, h long").select("job_id", at("h").alias("at"))
    results = spark.createDataFrame([(k, 10 * k + d, f"r{d}") for k in range(0, 30, 2) for d in (-1, 0, 24, 25)] + [(77, 3, "x"), (99, 5000, "end")], "job_id long, h long, result string").select("job_id", at("h").alias("at"), "result")
    want = outcomes(jobs, results, "24 hours").collect()
    jobs.write.parquet(f"{tmp_path}/jobs")
    results.write.parquet(f"{tmp_path}/results")
    stream = outcomes(flows.file_stream(spark, f"{tmp_path}/jobs", "job_id long, at timestamp"), flows.file_stream(spark, f"{tmp_path}/results", "job_id long, at timestamp, result string"), "24 hours")
    sinks = {x: f"{tmp_path}/{x}" for x in ("DELIVERED", "MISSING", "LATE")}
    flows.routed(stream, sinks, f"{tmp_path}/state", "status")
    got = [x for path in sinks.values() for x in spark.read.schema(stream.schema).parquet(path).drop("batch").collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert {x.status for x in got} == set(sinks) and sum(x.status == "MISSING" for x in got) == 15 and sum(x.status == "LATE" for x in got) == 31


def test_a_delivery_is_made_once(spark, tmp_path):
    class Folder:
        """A transport to a local folder that counts what is sent, and refuses some names at first."""

        def __init__(self, root: str):
            self.root = Path(root)

        def size(self, name: str) -> int | None:
            path = self.root / name
            return path.stat().st_size if path.exists() else None

        def put(self, name: str, content: bytes) -> None:
            with open(self.root / "log.txt", "a") as log:
                log.write(f"{name}\n")
            tries = (self.root / "log.txt").read_text().split().count(name)
            if name.startswith("bad") or name.startswith("slow") and tries < 2:
                raise OSError("refused")
            (self.root / name).write_bytes(content)

        def rename(self, old: str, new: str) -> None:
            os.rename(self.root / old, self.root / new)

    box, path = tmp_path / "box", f"{tmp_path}/ledger"
    box.mkdir()
    put = lambda: (box / "log.txt").read_text().split()
    rows = spark.createDataFrame([("a", "one"), ("a", "zwei"), ("b", "é"), ("bad", "x"), ("slow", "y"), (None, "z"), ("n", None)], "file string, message string")
    connect = lambda root=str(box): Folder(root)
    send = lambda batch, rows=rows: outbox.deliver_once(rows, connect, path, batch, 3, lambda s: None)
    first = send(0)
    for _ in range(2):  # read twice, and asked for twice
        assert {x.file: (x.status, x.attempts, x.size) for x in first.collect()} == {"a": ("DELIVERED", 1, 3), "b": ("DELIVERED", 1, 2), "bad": ("FAILED", 3, 1), "slow": ("DELIVERED", 2, 1)}
        first = send(0)
    assert sorted(put()) == sorted(x + outbox.UPLOADING for x in ["a", "b", "bad", "bad", "bad", "slow", "slow"]) and (box / "a").read_text() == "one"
    # a later batch sends only what is new or failed
    assert {x.file: x.status for x in send(1).collect()} == {"a": "DUPLICATE", "b": "DUPLICATE", "slow": "DUPLICATE", "bad": "FAILED"}
    # a run that ended before its ledger was whole: what it sent is found, not sent again
    os.remove(f"{path}/batch=0/_SUCCESS")
    before = len(put())
    assert {x.file: (x.status, x.attempts) for x in send(0).collect() if x.file != "bad"} == {"a": ("DELIVERED", 0), "b": ("DELIVERED", 0), "slow": ("DELIVERED", 0)}
    assert len(put()) == before + 3
    rows.filter("file in ('a', 'b')").withColumn("file", F.concat(F.lit("s"), "file")).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        outbox.delivering(flows.file_stream(spark, f"{tmp_path}/in", "file string, message string"), connect, f"{tmp_path}/other", f"{tmp_path}/state")
    assert [x for x in put() if x.startswith("s") and not x.startswith("slow")].count("sb" + outbox.UPLOADING) == 1


def test_a_broken_load_leaves_the_old_rows(spark, tmp_path):
    root = f"{tmp_path}/customers"
    make = lambda rows: spark.createDataFrame(rows, "soldto string, name string, n int")
    audit = S.Audit(mandatory=["soldto", "name"], key=["soldto"], least_rows=2, least_share=0.5, faults={"negative": "n < 0"})
    with pytest.raises(ValueError):
        S.snapshot(spark, root)
    good = [(f"{k:05d}", f"c{k}", k) for k in range(10)]
    assert S.publish(make(good), root, audit) == (1, [])
    pinned = S.snapshot(spark, root)
    for bad, why in (([("1", " ", 1), ("2", "x", 2), *good], "empty name: 1"), ([*good, good[0]], "repeated keys: 1"), (good[:4], "4 rows after 10"), ([], "0 rows, fewer than 2"), ([*good, ("x", "y", -1)], "negative: 1")):
        version, reasons = S.publish(make(bad), root, audit)
        assert why in reasons and S.latest_version(spark, root) == 1 and S.snapshot(spark, root).count() == 10
        with pytest.raises(ValueError):
            S.snapshot(spark, root, version)
    assert S.publish(make(good).drop("name"), root, audit)[1] == ["no column name"]
    version, reasons = S.publish(make(good[:6]), root, audit)
    assert not reasons and S.snapshot(spark, root).count() == 6 and pinned.count() == 10 and S.snapshot(spark, root, 1).count() == 10
    assert [(x.version, x.accepted) for x in S.manifest(spark, root).collect()] == [(k, k in (1, version)) for k in range(1, version + 1)]
    os.makedirs(f"{root}/rows/version={version + 1}")  # a load that broke off
    assert S.publish(make(good), root, audit) == (version + 1, [])


def test_only_the_pages_asked_for_are_read(spark, tmp_path):
    for name, n in (("a.txt", 8), ("b.txt", 2), ("empty.txt", 0)):
        (tmp_path / name).write_text("\f".join(f"{name} page {k}" for k in range(1, n + 1)))
    (tmp_path / "bad.txt").write_text("broken")
    log = str(tmp_path / "log")

    def count(path):
        text = Path(path).read_text()
        if text == "broken":
            raise RuntimeError("no such format")
        return text.count("\f") + bool(text)

    def pages(path, wanted):
        every = Path(path).read_text().split("\f")
        for k in wanted:
            with open(log, "a") as file:
                file.write(f"{Path(path).name}:{k}\n")
            if "b.txt page 2" in every[k - 1]:
                raise RuntimeError("torn page")
            yield k, every[k - 1]

    paths = [str(tmp_path / x) for x in ("a.txt", "b.txt", "bad.txt", "empty.txt")]
    read = lambda **more: D.read_documents(spark, paths, D.Reader(count, pages), per_task=3, **more)
    seen = lambda: sorted(Path(log).read_text().split()) if os.path.exists(log) else []
    assert sorted((Path(x.path).name, x.page or 0) for x in read(pages="1,3-5", columns=("path", "page")).collect()) == [("a.txt", 1), ("a.txt", 3), ("a.txt", 4), ("a.txt", 5), ("b.txt", 1), ("bad.txt", 0)] and seen() == []
    got = {(Path(x.path).name, x.page): (x.text, x.error) for x in read(pages="1,3-5").collect()}
    assert seen() == ["a.txt:1", "a.txt:3", "a.txt:4", "a.txt:5", "b.txt:1"] and got["a.txt", 4] == ("a.txt page 4", None) and "no such format" in got["bad.txt", None][1]
    os.remove(log)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read().filter("page >= 7 or page is null").collect()
        assert len(rows) == 3
        os.remove(log)
        assert sorted(x.page for x in read().filter("page in (2, 7) and path like '%a.txt'").collect()) == [2, 7] and seen() == ["a.txt:2", "a.txt:7", "b.txt:2"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    errors = {(Path(x.path).name, x.page): x.error for x in read().collect()}
    assert "torn page" in errors["b.txt", 2] and errors["b.txt", 1] is None
    assert all("no list of pages" in x.error for x in read(pages="3-1").collect() if "bad" not in x.path)


def test_settings_are_layered(spark, tmp_path):
    ini, defaults = tmp_path / "c.ini", {"edi": {"sender": "A", "profile": "STANDARD"}, "run": {"dry": False, "minutes": 5, "root": "/x"}, "box": {"user": ""}}
    ini.write_text("\ufeff[edi]\nsender = ${SENDER}\n[run]\ndry = Yes\nminutes = 7\n[box]\nuser = ${USER_OF}${NOBODY} \n", encoding="utf-8")
    read = lambda **more: settings.read_settings(spark, str(ini), defaults, {"SENDER": "B", "USER_OF": "u1"}, **more)
    assert read(mandatory=("box.user",), fixed={"edi.profile": "STANDARD"}) == {"edi": {"sender": "B", "profile": "STANDARD"}, "run": {"dry": True, "minutes": 7, "root": "/x"}, "box": {"user": "u1"}}
    with pytest.raises(ValueError, match="box.password is missing; edi.sender is 'B', not 'A'"):
        read(mandatory=("box.password", "run.root"), fixed={"edi.sender": "A"})
    ini.write_text("[run]\nminutes = soon\n")
    with pytest.raises(ValueError, match="run.minutes"):
        read()
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("run:\n  minutes: 9\n  words: [a, '${SENDER}']\n")
    assert settings.read_settings(spark, str(tmp_path / "c.yaml"), defaults, {"SENDER": "B"})["run"] == {"dry": False, "minutes": 9, "root": "/x", "words": ["a", "B"]}


def test_reports_hide_and_order(spark):
    rows = spark.createDataFrame([(2, "b", "x", 1), (1, "z", "x", 2), (1, "a", "x", 3)], "k int, n string, source string, v int")
    got = sinks.reported(rows, ["k", "n"])
    assert got.columns == ["k", "n", "v"] and [tuple(x) for x in got.collect()] == [(1, "a", 3), (1, "z", 2), (2, "b", 1)]


def test_a_job_costs_few_calls_and_no_frame():
    calls, row = [], Row("us", "seq", "wanted")

    class State:
        def __init__(self, value):
            self.value = value

        def __getattr__(self, name):
            return lambda *value: calls.append(name) or (self.value if name == "get" else None)

    machine = _Machine(Limits())
    machine.handle, machine.job = State(None), State(None)
    wanted = [row(2_000_000, 2, "PROCESSING"), row(1_000_000, 1, None), row(1_000_000, 1, "RECEIVED")]  # two at one time and place, of which one wants nothing
    got = [(x.job_id, x.seq, x["at"].timestamp(), x.after, x.accepted) for x in machine.handleInputRows((7,), iter(wanted), None)]
    assert got == [(7, 1, 1.0, None, False), (7, 1, 1.0, "RECEIVED", True), (7, 2, 2.0, "PROCESSING", True)]
    assert calls == ["get", "update", "registerTimer"]
