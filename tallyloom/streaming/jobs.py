"""Jobs as a keyed state machine over a stream of wanted moves, and their outcomes as an interval join of two streams."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.ranking import first_occurrence
from tallyloom.operators.store import STATES

MOVES = "job_id long, seq long, at timestamp, before string, after string, accepted boolean, reason string, attempts int"
_MOVE, _EPOCH = Row(*(field.split()[0] for field in MOVES.split(", "))), datetime(1970, 1, 1, tzinfo=UTC)
ENDS = frozenset(s for to in STATES.values() for s in to if s not in STATES)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Limits:
    """Seconds: how long a job may be PROCESSING, how long the first RETRY waits (twice that the next), how long an ended job is remembered; and how often it is PROCESSING at most before it stays FAILED."""

    processing: int = 3600
    backoff: int = 60
    remembered: int = 30 * 86400
    attempts: int = 3


@dataclass(frozen=True)
class Job:
    state: str | None = None
    since: int = 0  # microseconds
    attempts: int = 0

    def due(self, limits: Limits) -> tuple[int, str, str] | None:
        """When the job moves of itself, where to and why; to no state: it is forgotten."""
        after = lambda seconds: self.since + seconds * 1_000_000
        if self.state == "PROCESSING":
            return after(limits.processing), "FAILED", "TIMEOUT"
        if self.state == "FAILED" and self.attempts < limits.attempts:
            return after(limits.backoff * 2 ** max(0, self.attempts - 1)), "RETRY", "BACKOFF"
        return (after(limits.remembered), "", "") if self.state in ENDS else None

    def allows(self, wanted: str | None) -> bool:
        return wanted == "RECEIVED" if self.state is None else wanted in STATES.get(self.state, ())


def moved(job: Job, limits: Limits, until: int, wanted: list[tuple[int, int, str | None]] = []) -> tuple[Job, list[tuple]]:
    """The job after wanted moves (at, seq, state; in order) and all that is due by then or by until, and rows of MOVES without job_id."""
    rows = []

    def catch_up(job: Job, at: int) -> Job:
        while (due := job.due(limits)) and due[0] <= at:
            when, after, reason = due
            if not after:
                return Job()
            rows.append((None, when, job.state, after, True, reason, job.attempts))
            job = Job(after, when, job.attempts)
        return job

    for at, seq, state in wanted:
        job = catch_up(job, at)
        if job.allows(state):
            rows.append((seq, at, job.state, state, True, "", job.attempts + (state == "PROCESSING")))
            job = Job(state, at, job.attempts + (state == "PROCESSING"))
        else:
            rows.append((seq, at, job.state, state, False, "ILLEGAL", job.attempts))
    return catch_up(job, until), rows


class _Machine(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, since long, attempts int")

    def _step(self, key: tuple, until: int, wanted: list[tuple[int, int, str | None]]) -> Iterator[Row]:
        old = Job(*(self.job.get() or ()))  # each call goes to the JVM, so no more of them than it takes
        new, rows = moved(old, self.limits, until, wanted)
        if new != old:
            if new.state is None:
                self.job.clear()
            else:
                self.job.update((new.state, new.since, new.attempts))
        before, after = ((x.due(self.limits) or (None,))[0] for x in (old, new))
        if before != after:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            if after is not None:
                self.handle.registerTimer(-(-after // 1000))
        for seq, at, *rest in rows:
            yield _MOVE(key[0], seq, _EPOCH + timedelta(microseconds=at), *rest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        wanted = sorted(((x.us, x.seq, x.wanted) for x in rows), key=lambda x: (x[0], x[1], x[2] or ""))
        yield from self._step(key, -(1 << 62), wanted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._step(key, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass


def job_moves(wanted: DataFrame, limits: Limits = Limits(), delay: str = "1 hour") -> DataFrame:
    """All moves of jobs (MOVES) of a stream of wanted ones (job_id, seq, at, wanted).

    A job begins with RECEIVED and follows STATES; a move that they don't permit is a row with accepted false and
    leaves the job as it is. A job that is PROCESSING for too long fails by a timer, a failed one is retried by a timer
    after a wait that doubles each time; ended jobs are forgotten by a timer, so that the state stays bounded. Moves of a
    micro-batch are taken by time, then seq; what was due before a move comes before it, whether its timer has fired or not, so that
    the rows do not depend on how the stream was cut into batches. Moves later than the watermark are dropped. Run it within state_in_rocksdb().
    """
    rows = wanted.filter("job_id is not null and at is not null").select("job_id", F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"), "at", "wanted", F.unix_micros("at").alias("us")).withWatermark("at", delay)
    # the worker that plans the stream knows the environment's modules only, so the machine travels as a whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.groupBy("job_id").transformWithState(_Machine(limits), MOVES, "append", "eventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def outcomes(jobs: DataFrame, results: DataFrame, within: str, delay: str = "1 hour") -> DataFrame:
    """job_id, at, result_at, result and status of two streams: jobs (job_id, at), results (job_id, at, result).

    DELIVERED: a result no earlier than its job and at most `within` later; MISSING: a job without any such result; LATE: a
    result without such a job, for a side output. Rows of the last two come when the watermark says that nothing can join them any more.
    On tables the same join gives the same rows at once.
    """
    marked = lambda df, at: df.withWatermark(at, delay) if df.isStreaming else df
    a = marked(jobs.select(F.col("job_id").alias("_j"), F.col("at").alias("_from")), "_from")
    b = marked(results.select(F.col("job_id").alias("_r"), F.col("at").alias("_to"), "result"), "_to")
    joined = a.join(b, F.expr(f"_j = _r and _to >= _from and _to <= _from + interval {within}"), "full")
    status = F.when(F.col("_r").isNull(), "MISSING").when(F.col("_j").isNull(), "LATE").otherwise("DELIVERED")
    return joined.select(F.coalesce("_j", "_r").alias("job_id"), F.col("_from").alias("at"), F.col("_to").alias("result_at"), "result", status.alias("status"))


LOG = "job_id long, seq int, at timestamp, status string, reason string, batch long"


def worked_off(stream: DataFrame, work: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, every: str | None = None) -> None:
    """Jobs of a queue (job_id, at, ...), each claimed, worked on and entered in the log by one micro-batch after the other.

    work: from the rows of a batch to job_id, status and reason of those that it could do; it runs as Spark jobs of its own. A
    job that work leaves out is FAILED, one that stands in the queue again is DUPLICATE, of rows with one job_id in a batch the
    first by time counts. The log has for each job PROCESSING (seq 1) and what came of it (seq 2). A batch that is run again writes
    its own folder again (batch=<id>), so that nothing is entered twice. every: how often the queue is looked at, like `5 seconds`; without it all that is there is worked off.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        before = spark.read.schema(LOG).parquet(log).filter(F.col("batch") < number) if there else spark.createDataFrame([], LOG)
        first = first_occurrence(rows.filter("job_id is not null"), "job_id", ["at"])
        known = before.select("job_id", F.lit(True).alias("_known")).distinct()
        claimed = first.join(known, "job_id", "left").persist()
        fresh = claimed.filter("_known is null").drop("_known")
        done = work(fresh).select("job_id", "status", "reason").dropDuplicates(["job_id"])
        begun = fresh.select("job_id", F.lit(1).alias("seq"), "at", F.lit("PROCESSING").alias("status"), F.lit("").alias("reason"))
        ended = fresh.select("job_id", "at").join(done, "job_id", "left").select("job_id", F.lit(2).alias("seq"), "at", F.coalesce("status", F.lit("FAILED")).alias("status"), F.coalesce("reason", F.when(F.col("status").isNull(), "NOT_DONE").otherwise("")).alias("reason"))
        again = claimed.filter("_known").select("job_id", F.lit(2).alias("seq"), "at", F.lit("DUPLICATE").alias("status"), F.lit("SEEN_BEFORE").alias("reason"))
        begun.unionByName(ended).unionByName(again).write.mode("overwrite").parquet(f"{log}/batch={number}")
        claimed.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
    query.awaitTermination()
