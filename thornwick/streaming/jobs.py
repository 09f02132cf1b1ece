"""Incremental surfaces as Structured Streaming: the job log's state, and scans of arriving packages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from thornwick.functions.text import slug
from thornwick.operators.relations import keep_first
from thornwick.sources.store import Store

STATES = ("queued", "scanning", "completed", "failed")
ENDS = ("completed", "failed")


def latest_states(events: DataFrame) -> DataFrame:
    """The last state of each job (job_id, status, seq), in batch or as a streaming aggregate in update or complete mode."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> bool:
    """Handles all that has arrived, batch by batch, and stops; a rerun goes on after the last finished batch. With a budget
    in seconds no batch begins once it is spent; what was not begun stays for the next run. Whether all was handled."""
    begun, spent = clock(), []

    def within(rows: DataFrame, batch: int) -> None:
        if seconds is not None and clock() - begun >= seconds:
            spent.append(batch)
            raise TimeoutError(f"the budget of {seconds} seconds is spent before batch {batch}")
        each(rows, batch)

    query = stream.writeStream.foreachBatch(within).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not spent:
            raise
    return not spent


def keep_states(events: DataFrame, store: Store, checkpoint: str) -> None:
    """Keeps each job's last state (job_id, status, seq) in a store as events arrive: in each batch, of the jobs that it changes."""
    query = latest_states(events).writeStream.outputMode("update").foreachBatch(lambda rows, _: store.upsert("states", rows, "job_id"))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


ARRIVAL = "pkg string, path string, content string, version long"
ARRIVED = f"{ARRIVAL}, batch long"


def scan_arrivals(
    spark: SparkSession, folder: str, store: Store, scan: Callable[[DataFrame], DataFrame], checkpoint: str, per_batch: int = 100, rescan: bool = False,
    seconds: float | None = None, clock: Callable[[], float] = time.monotonic, counters: dict[str, Column] | None = None,
) -> Arrivals:
    """Scans packages that arrive in folder and are not stored yet; stores scores by slug. Rows: pkg, path, content and, where
    the files have it, version (null or none: 0).

    A file holds whole packages, or a package's files lie in more than one: then the package is scanned again, whole, in the
    batch of its last file, from all the rows of its version that have arrived. A greater version replaces a package as a
    whole, paths that it leaves out included; rows of a smaller one than the greatest so far count for nothing. Within a
    version a path that comes again has its last content (of two in one batch, the greater).

    A batch reads and writes the buckets of its own packages only, and does the same again if it is run again after a crash
    (a store goes with one checkpoint: its batches' numbers say what came last).
    seconds is a budget (see run_available). counters are aggregates over the rows of scan, gathered while they are stored."""
    batches: list[dict] = []

    def each(files: DataFrame, batch: int) -> None:
        files = files.withColumn("version", F.coalesce("version", F.lit(0).cast("long")))
        came = files.select("pkg").distinct().withColumn("slug", slug(F.col("pkg")))
        seen = store.lookup("arrived", came, "pkg")
        seen = spark.createDataFrame([], ARRIVED) if seen is None else seen
        if rescan:
            todo = came
        else:
            stored = store.lookup("results", came)
            fresh = came if stored is None else came.join(stored.select("slug").distinct(), "slug", "left_anti")
            todo = fresh.select("pkg", "slug").unionByName(came.join(seen.select("pkg").distinct(), "pkg", "left_semi")).distinct()
        rows = files.select("pkg", "path", "content", "version", F.lit(batch).cast("long").alias("batch")).unionByName(seen).join(todo.select("pkg"), "pkg", "left_semi")
        newest = rows.withColumn("newest", F.max("version").over(Window.partitionBy("pkg"))).filter("version = newest")
        whole = newest.groupBy("pkg", "path", "version").agg(F.max_by("content", F.struct("batch", "content")).alias("content"), F.max("batch").alias("batch"))
        store.upsert("arrived", whole, "pkg")
        # what lookups gave is of a fixed version of the store, so todo is still what it was
        ours = store.lookup("arrived", came, "pkg")
        if ours is None:
            return
        ours = ours.join(todo.select("pkg"), "pkg", "left_semi")
        found = scan(ours.select("pkg", "path", "content")).withColumn("slug", slug(F.col("pkg")))
        if counters:
            watch = Observation()
            found = found.observe(watch, *[c.alias(n) for n, c in counters.items()])
        store.upsert("results", found)
        if counters:
            batches.append({"batch": batch} | watch.get)

    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return Arrivals(run_available(stream, each, checkpoint, seconds, clock), batches)


@dataclass
class Arrivals:
    """Whether all that had arrived was handled, and each batch's counters."""

    all_handled: bool
    batches: list[dict]


# --- a state machine of jobs with timers ------------------------------------------------------------------------------

TOLD = "job_id long, status string, reason string, us long"
STUCK = "no result in time"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_BUCKETS = 1024
_NONE = np.iinfo(np.int64).max  # no such time, or nothing told
_TOLD = len(STATES) + 1  # a job's columns: its id, the first time of each state (microseconds), what was last told


class JobMachine(StatefulProcessor):
    """queued, scanning, then completed or failed, with no way back, by the times of a job's events.

    A job scans from its first scanning event on. It ends with its first completed or failed event (ties: completed; of one
    job, equal times, the smaller name), if that comes within `wait` milliseconds of the start of its scan or without one;
    else it fails when that time is over, as soon as the watermark has passed it. What a job has ended with stays; `keep`
    milliseconds (of event time) later it is forgotten. Order of rows within a batch does not matter; state is six numbers a
    job, whatever the number of its events.

    Jobs are held in hash buckets, each one key with one value and one timer (that of its next job), so that a batch asks for
    state once a bucket and works on all jobs of a bucket as arrays. A batch writes the buckets of its jobs anew."""

    def __init__(self, wait: int, keep: int) -> None:
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "timer long, jobs binary")

    def _load(self) -> tuple[int | None, np.ndarray]:
        timer, raw = self.jobs.get() or (None, b"")
        return timer, np.frombuffer(bytes(raw), np.int64).reshape(-1, _TOLD + 1).copy()

    def _save(self, timer: int | None, known: np.ndarray, passed: int) -> None:
        """Stores the jobs, and moves the timer to the first millisecond at which a scan's time is over or an ended job is forgotten."""
        told = known[:, _TOLD]
        _, at, over = self._status(known, passed)
        ended = (told == 2) | (told == 3)
        due = np.r_[-(-over[told == 1] // 1000), at[ended] // 1000 + self.keep]
        first = max(int(due.min()), passed + 1) if len(due) else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if len(known):
            self.jobs.update((first, known.tobytes()))
        else:
            self.jobs.clear()

    def _status(self, known: np.ndarray, passed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By job: the number of its state, since when, and when its scan's time is over."""
        _, queued, scanning, completed, failed, _ = known.T
        over = np.where(scanning == _NONE, _NONE, np.minimum(scanning, _NONE - self.wait * 1000) + self.wait * 1000)
        end = np.minimum(completed, failed)
        cases = [(end < _NONE) & (end <= over), (over < _NONE) & ((end < _NONE) | (over <= passed * 1000)), scanning < _NONE]
        return np.select(cases, [np.where(completed <= failed, 2, 3), 3, 1], 0), np.select(cases, [end, over, scanning], queued), over

    def _tell(self, known: np.ndarray, passed: int) -> Iterator[pd.DataFrame]:
        """The jobs whose state is not what was last told; what is told of an end stays."""
        status, at, _ = self._status(known, passed)
        told = known[:, _TOLD]
        new = (status != told) & (told != 2) & (told != 3)
        told[new] = status[new]
        if new.any():
            stuck = (status == 3) & (at < known[:, 3:5].min(axis=1))  # no end came in time
            yield pd.DataFrame({"job_id": known[new, 0], "status": np.asarray(STATES, object)[status[new]], "reason": np.where(stuck[new], STUCK, None), "us": at[new]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, known = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            jobs, place = np.unique(frame["job_id"].to_numpy(np.int64), return_inverse=True)
            came = jobs[~np.isin(jobs, known[:, 0])]
            if len(came):
                more = np.full((len(came), _TOLD + 1), _NONE)
                more[:, 0] = came
                known = np.r_[known, more]
                known = known[np.argsort(known[:, 0])]
            at = np.searchsorted(known[:, 0], jobs)[place]
            state = pd.Categorical(frame["status"], STATES).codes.astype(np.int64)
            open_ = (known[at, _TOLD] != 2) & (known[at, _TOLD] != 3)
            np.minimum.at(known, (at[open_], state[open_] + 1), frame["us"].to_numpy(np.int64)[open_])
        yield from self._tell(known, passed)
        self._save(timer, known, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, known = self._load()  # an expired timer is gone
        passed = timerValues.getCurrentWatermarkInMs()
        _, at, _ = self._status(known, passed)
        ended = (known[:, _TOLD] == 2) | (known[:, _TOLD] == 3)
        known = known[~(ended & (at // 1000 + self.keep <= passed))]
        yield from self._tell(known, passed)
        self._save(None, known, passed)

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, wait: int, keep: int, late: str, buckets: int = JOB_BUCKETS) -> DataFrame:
    """Changes of status of jobs (job_id, status, reason, at) in a stream of events (job_id long, status string, ts timestamp): see JobMachine; late is
    how far the watermark stays behind. Rows of a null job, time or unknown status count for nothing. The session's state
    store must be ROCKSDB. The number of buckets stays as it was when the stream began."""
    rows = events.filter(F.col("job_id").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(*STATES)).withWatermark("ts", late)
    rows = rows.select("job_id", "status", F.unix_micros("ts").alias("us"), "ts", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"))
    told = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=JobMachine(wait, keep), outputStructType=TOLD, outputMode="Update", timeMode="EventTime")
    return told.select("job_id", "status", "reason", F.timestamp_micros("us").alias("at"))


def keep_job_changes(events: DataFrame, store: Store, checkpoint: str, wait: int, keep: int, late: str, name: str = "jobs_now") -> None:
    """Keeps each job's last status in a store as its changes come. A batch may hold two changes of a job (what its events and
    then its timer say): the end counts, else the later."""
    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # read when the query starts

    def each(rows: DataFrame, _: int) -> None:
        store.upsert(name, keep_first(rows, [F.col("job_id")], [F.col("status").isin(*ENDS).desc(), F.col("at").desc(), F.col("status").desc()]), "job_id")

    try:
        query = job_changes(events, wait, keep, late).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stateful_jobs(events: DataFrame) -> DataFrame:
    """Streaming job states that never go back: an event counts if its seq is the job's highest so far (job_id, status, seq)."""
    def advance(key, frames, state):
        status, seq = state.get if state.exists else (None, -1)
        for frame in frames:
            for s, n in zip(frame["status"], frame["seq"], strict=True):
                if n > seq and status not in ("completed", "failed"):
                    status, seq = s, int(n)
        state.update((status, seq))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "seq": [seq]})

    return events.groupBy("job_id").applyInPandasWithState(advance, "job_id long, status string, seq long", "status string, seq long", "update", "NoTimeout")
