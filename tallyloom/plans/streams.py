"""Streaming queries run to their end over a table, so that they can be held against SQL. QUERIES: name to (plan, SQL).

Paths end in a pattern, since a stream of files takes a folder or a pattern but not one file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.tables import table
from tallyloom.sources.shared import shared_folder
from tallyloom.sources.snapshots import Audit, manifest, publish, snapshot
from tallyloom.streaming.flows import deduplicated, file_stream, routed, run_available
from tallyloom.streaming.jobs import LOG, Limits, job_moves, outcomes, state_in_rocksdb, worked_off

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_dedupe(spark, d):
    """Each user's kinds of events once. A watermark of a year forgets kinds that old, so that the state stays bounded; these tables span a month."""
    to = shared_folder(spark, "stream")
    once = deduplicated(file_stream(spark, f"{d}/events.parque[t]", _EVENTS).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "365 days").select("user_id", "event_type")
    run_available(once, f"{to}/out", f"{to}/state")
    return spark.read.schema(once.schema).parquet(f"{to}/out")


STREAM_DEDUPE = "SELECT DISTINCT user_id, event_type FROM events"


def stream_intake(spark, d):
    """New orders of a queue as job rows with the state that they start in."""
    to = shared_folder(spark, "stream")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    jobs = file_stream(spark, f"{d}/orders.parque[t]", schema).filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job_id"), F.lit("RECEIVED").alias("status"), F.sha2(F.concat_ws(":", "o_orderkey", "o_custkey"), 256).alias("dedupe_key"))
    run_available(jobs, f"{to}/out", f"{to}/state")
    return spark.read.schema(jobs.schema).parquet(f"{to}/out")


STREAM_INTAKE = "SELECT o_orderkey AS job_id, 'RECEIVED' AS status, sha256(o_orderkey || ':' || o_custkey) AS dedupe_key FROM orders WHERE o_orderstatus <> 'P'"

LIMITS = Limits(processing=6 * 3600, backoff=3600, remembered=1000 * 86400, attempts=3)


def job_state_machine(spark, d):
    """Events as wanted moves of jobs, a user's five days one job: accepted and illegal moves, timeouts and retries by timers."""
    to = shared_folder(spark, "stream")
    state = F.when(F.col("event_type") == "signup", "RECEIVED").when(F.col("event_type") == "view", "PROCESSING").when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("RETRY")
    wanted = file_stream(spark, f"{d}/events.parque[t]", _EVENTS).select((F.col("user_id") * 100 + F.floor(F.dayofmonth("ts") / 5)).alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), state.alias("wanted"))
    with state_in_rocksdb(spark):
        moves = job_moves(wanted, LIMITS, "0 seconds")
        run_available(moves, f"{to}/out", f"{to}/state")
    return spark.read.schema(moves.schema).parquet(f"{to}/out").withColumn("at", F.unix_micros("at")).fillna({"seq": -1, "before": "-"})


# what is due before each event of a job, one step of the recursion an event, and in the end what is due by the watermark
JOB_STATE_MACHINE = """WITH RECURSIVE e AS (SELECT user_id * 100 + day(ts) // 5 AS job_id, event_id AS seq, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RETRY' END AS w FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, seq) AS i FROM e),
last AS (SELECT * FROM n UNION ALL SELECT job_id, -1, (SELECT max(t) // 1000 * 1000 FROM e), NULL, max(i) + 1 FROM n GROUP BY job_id),
legal(x, y) AS (VALUES ('-', 'RECEIVED'), ('RECEIVED', 'PROCESSING'), ('RETRY', 'PROCESSING'), ('PROCESSING', 'COMPLETED'), ('PROCESSING', 'FAILED'), ('FAILED', 'RETRY')),
r(job_id, i, seq, t, w, state, since, tries, old, old_tries, f_at, b_at, ok) AS (
  SELECT DISTINCT job_id, 0::BIGINT, -1::BIGINT, 0::BIGINT, NULL::VARCHAR, '-', 0::BIGINT, 0, '-', 0, NULL::BIGINT, NULL::BIGINT, false FROM e
  UNION ALL
  SELECT job_id, i, seq, t, w, CASE WHEN ok THEN w ELSE cur END, CASE WHEN ok THEN t ELSE cur_since END, tries + (ok AND w = 'PROCESSING')::INT, cur, tries, f_at, b_at, ok
  FROM (SELECT *, EXISTS (SELECT 1 FROM legal WHERE x = cur AND y = w) AS ok FROM (
    SELECT *, CASE WHEN b_at IS NOT NULL THEN 'RETRY' WHEN f_at IS NOT NULL THEN 'FAILED' ELSE state END AS cur, coalesce(b_at, f_at, since) AS cur_since FROM (
      SELECT *, CASE WHEN (state = 'FAILED' OR f_at IS NOT NULL) AND tries < 3 AND coalesce(f_at, since) + wait <= t THEN coalesce(f_at, since) + wait END AS b_at FROM (
        SELECT last.job_id, last.i, last.seq, last.t, last.w, r.state, r.since, r.tries, CASE WHEN r.state = 'PROCESSING' AND r.since + 21600000000 <= last.t THEN r.since + 21600000000 END AS f_at, (3600000000 * 2 ** greatest(0, r.tries - 1))::BIGINT AS wait
        FROM r JOIN last ON last.job_id = r.job_id AND last.i = r.i + 1))))
)
SELECT job_id, seq, t AS "at", old AS before, w AS after, ok AS accepted, CASE WHEN ok THEN '' ELSE 'ILLEGAL' END AS reason, CASE WHEN ok THEN tries ELSE old_tries END::INT AS attempts FROM r WHERE w IS NOT NULL
UNION ALL SELECT job_id, -1, f_at, 'PROCESSING', 'FAILED', true, 'TIMEOUT', old_tries::INT FROM r WHERE f_at IS NOT NULL
UNION ALL SELECT job_id, -1, b_at, 'FAILED', 'RETRY', true, 'BACKOFF', old_tries::INT FROM r WHERE b_at IS NOT NULL"""


def job_outcomes(spark, d):
    """Orders as jobs and their lines as results within 30 days: an interval join of two streams, late results to a side output.

    Both streams end with a row far ahead, as time going on would show, so that the watermark passes all others.
    """
    to = shared_folder(spark, "stream")
    orders = "o_orderkey long, o_orderdate timestamp"
    lines = "l_orderkey long, l_linenumber int, l_shipdate timestamp"
    ahead = spark.sql("SELECT -1L AS job_id, timestamp '9000-01-01' AS at, 0 AS result")
    ahead.write.parquet(f"{to}/ahead")
    end = lambda: file_stream(spark, f"{to}/ahead", "job_id long, at timestamp, result int")
    jobs = file_stream(spark, f"{d}/orders.parque[t]", orders).toDF("job_id", "at").unionByName(end().drop("result"))
    results = file_stream(spark, f"{d}/lineitem.parque[t]", lines).select(F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("result")).unionByName(end())
    stream = outcomes(jobs, results, "30 days", "1 day")
    sinks = {x: f"{to}/{x}" for x in ("DELIVERED", "MISSING", "LATE")}
    routed(stream, sinks, f"{to}/state", "status")
    found = [spark.read.schema(stream.schema).parquet(path) for path in sinks.values()]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).filter("job_id >= 0")
    return rows.select("job_id", "status", F.coalesce("result", F.lit(-1)).alias("result"), F.coalesce(F.unix_micros("at"), F.lit(-1).cast("long")).alias("at"), F.coalesce(F.unix_micros("result_at"), F.lit(-1).cast("long")).alias("result_at"))


JOB_OUTCOMES = """SELECT coalesce(o_orderkey, l_orderkey) AS job_id, CASE WHEN l_orderkey IS NULL THEN 'MISSING' WHEN o_orderkey IS NULL THEN 'LATE' ELSE 'DELIVERED' END AS status, coalesce(l_linenumber, -1)::INT AS result,
coalesce(epoch_us(o_orderdate), -1) AS "at", coalesce(epoch_us(l_shipdate), -1) AS result_at
FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY"""

def master_snapshots(spark, d):
    """Loads of customers as versions: a whole one, one with empty names, one cut short, one of all but every tenth; readers get the last that passed, and the manifest says why the others did not."""
    root = shared_folder(spark, "master")
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    audit = Audit(mandatory=["c_custkey", "c_name"], key=["c_custkey"], least_share=0.8)
    key = F.col("c_custkey")
    for load in (rows, rows.withColumn("c_name", F.when(key % 7 > 0, F.col("c_name"))), rows.filter(key % 2 == 0), rows.filter(key % 10 > 0), rows.unionAll(rows)):
        publish(load, root, audit)
    counts = manifest(spark, root).select(F.concat(F.lit("load "), F.col("version").cast("string")).alias("c_name"), F.when(F.col("accepted"), F.col("n")).otherwise(-F.col("n")).alias("c_custkey"))
    return snapshot(spark, root).select("c_custkey", "c_name").unionByName(counts)


MASTER_SNAPSHOTS = """SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 > 0
UNION ALL SELECT * FROM (SELECT count(*) AS n, 'load 1' FROM customer UNION ALL SELECT -count(*), 'load 2' FROM customer UNION ALL SELECT -count(*), 'load 3' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT count(*), 'load 4' FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT -2 * count(*), 'load 5' FROM customer)"""

def stream_worker(spark, d):
    """Orders of a queue that is read in two parts, the second with some of the first again, worked off into a log of states: orders with lines and a customer are done, those without lines rejected, the rest fail."""
    to = shared_folder(spark, "stream")
    orders, lines, customers = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    queue = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("customer"))
    log = f"{to}/log"

    def work(rows):
        have = lines.select(F.col("l_orderkey").alias("job_id"), F.lit(True).alias("lines")).distinct()
        judged = rows.join(customers.filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("customer")), "customer").join(have, "job_id", "left")
        return judged.select("job_id", F.when(F.col("lines"), "COMPLETED").otherwise("REJECTED").alias("status"), F.when(F.col("lines").isNull(), "NO_LINES").alias("reason"))

    for part in ("job_id % 3 > 0", "job_id % 3 = 0 or job_id % 5 = 0"):
        queue.filter(part).write.mode("append").parquet(f"{to}/queue")
        worked_off(file_stream(spark, f"{to}/queue", "job_id long, at timestamp, customer long"), work, log, f"{to}/state")
    return spark.read.schema(LOG).parquet(log).select("job_id", "seq", "status", "reason")


STREAM_WORKER = """WITH j AS (SELECT o_orderkey AS k, o_custkey % 10 > 0 AS known, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders)
SELECT k AS job_id, 1 AS seq, 'PROCESSING' AS status, '' AS reason FROM j
UNION ALL SELECT k, 2, CASE WHEN NOT known THEN 'FAILED' WHEN lines THEN 'COMPLETED' ELSE 'REJECTED' END, CASE WHEN NOT known THEN 'NOT_DONE' WHEN lines THEN '' ELSE 'NO_LINES' END FROM j
UNION ALL SELECT k, 2, 'DUPLICATE', 'SEEN_BEFORE' FROM j WHERE k % 3 > 0 AND k % 5 = 0"""

QUERIES = {"stream_worker": (stream_worker, STREAM_WORKER), "master_snapshots": (master_snapshots, MASTER_SNAPSHOTS), "job_state_machine": (job_state_machine, JOB_STATE_MACHINE), "job_outcomes": (job_outcomes, JOB_OUTCOMES), "stream_dedupe": (stream_dedupe, STREAM_DEDUPE), "stream_intake": (stream_intake, STREAM_INTAKE)}
