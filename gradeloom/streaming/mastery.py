"""Streams with event-time state: mastery in order of time, the hourly limit, each content once, and the nightly repair.

The file source gives rows in any order. What lies within the watermark's delay is kept and put in order; what is older
is dropped, and the batch recomputation of `reconciled` puts it right. Spark itself drops rows by the watermark of the
trigger before, so each processor holds its rows against that of its own trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from gradeloom.operators.grouped import CAP, GUESS, LEARN, OTHER, PRIOR, SLIP, SOURCES
from gradeloom.plans.domain import _ADJ, _FOLD, _STEPS
from gradeloom.plans.evidence import query
from gradeloom.runtime import run_folder, ship
from gradeloom.sources.keyed import VERSION, KeyedTable

#: The observations of the view `obs`, as expressions over events: a stream takes no common table expressions.
OBSERVED = [
    "user_id AS student_id", "event_type AS concept_key", "least(1e0, value / 1e2) AS score", "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 1e2 AS confidence",
    "CASE event_id % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'repair' WHEN 2 THEN 'static' WHEN 3 THEN 'structural' WHEN 4 THEN 'report' ELSE 'manual' END AS source", "ts", "unix_micros(ts) AS at", "event_id AS obs_id",
]
OUT = "student_id bigint, concept_key string, estimate double, n bigint"
#: A table's files may hold any times, so over a whole table nothing is late.
WHOLE = "4000 days"
HOUR_US, MOST_AN_HOUR = 3_600_000_000, 20
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that list states and timers need, for queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def updated(m: float, score: float, confidence: float, source: str) -> float:
    """The estimate after one observation."""
    s, g = SOURCES.get(source, OTHER)
    spread = 2 - min(1.0, max(0.0, confidence))
    slip, guess = min(CAP, SLIP * s * spread), min(CAP, GUESS * g * spread)
    right = m * (1 - slip) / (m * (1 - slip) + (1 - m) * guess)
    wrong = m * slip / (m * slip + (1 - m) * (1 - guess))
    after = score * right + (1 - score) * wrong
    return after + (1 - after) * LEARN


def _fold(known: dict, rows: list[tuple]) -> None:
    """Put the observations, in order of time, into the estimate and count of their concepts."""
    for _, _, concept, score, confidence, source in rows:
        m, n = known.get(concept, (PRIOR, 0))
        known[concept] = updated(m, score, confidence, source), n + 1


class MasteryFold(StatefulProcessor):
    """The fold of a student's observations, each concept's in order of time.

    State: the estimates over what is older than the watermark, and the observations since, which a row that comes late may
    still precede. A timer past the latest of them folds them in when a student falls silent. A call of the state costs far
    more than a row, so all concepts of a student are read and written at once.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getListState("settled", "concept_key string, m double, n bigint")
        self.recent = handle.getListState("recent", "at bigint, obs_id bigint, concept_key string, score double, confidence double, source string")

    def _settle(self, rows: list[tuple], watermark_us: int) -> tuple[dict, list[tuple]]:
        """The estimate and count by concept over the rows before the watermark, and the rows from it on; both are put into the state."""
        known = {concept: (m, n) for concept, m, n in self.settled.get()}
        old = [r for r in rows if r[0] < watermark_us]
        if old:
            _fold(known, old)
            self.settled.put([(concept, float(m), int(n)) for concept, (m, n) in known.items()])
        if rows := rows[len(old) :]:
            self.recent.put(rows)
        else:
            self.recent.clear()
        return known, rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(r.at, r.obs_id, r.concept_key, r.score, r.confidence, r.source) for r in rows if r.at >= watermark_us]
        if not new:
            return
        kept = sorted([*(tuple(r) for r in self.recent.get()), *new], key=lambda r: r[:2])
        known, rest = self._settle(kept, watermark_us)
        _fold(known, rest)
        self.handle.registerTimer(kept[-1][0] // 1000 + 1)
        for concept in sorted({r[2] for r in new}):
            m, n = known[concept]
            yield Row(student_id=key[0], concept_key=concept, estimate=float(round(m, 6)), n=int(n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if rows := [tuple(r) for r in self.recent.get()]:
            self._settle(rows, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([])

    def close(self) -> None:
        pass


class HourlyCount(StatefulProcessor):
    """Each submission with its student's submissions in the hour up to it.

    State: the submissions that a row within the watermark may still meet, which are those from an hour before it on. A row
    that comes late raises the counts of the hour after it, which are given again; the largest count of a submission is
    the right one. A timer clears the state of a student that falls silent.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at bigint, event_id bigint")

    def _kept(self, rows: list[tuple], watermark_us: int) -> None:
        if rows := [r for r in rows if r[0] >= watermark_us - HOUR_US]:
            self.times.put(rows)
            self.handle.registerTimer((rows[-1][0] + HOUR_US) // 1000 + 1)
        else:
            self.times.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, watermark_us = pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs() * 1000
        new = new[new["at"] >= watermark_us]
        if not len(new):
            return
        fresh = np.sort(new["at"].to_numpy(np.int64))
        known = [tuple(r) for r in self.times.get()] if self.times.exists() else []
        known = sorted(known + list(zip(new["at"].tolist(), new["event_id"].tolist(), strict=True)))
        at = np.array([r[0] for r in known], np.int64)
        upto = np.searchsorted(at, at, "right")
        n = upto - np.searchsorted(at, at - HOUR_US, "left")
        changed = np.searchsorted(fresh, at, "right") > np.searchsorted(fresh, at - HOUR_US, "left")
        self._kept(known, watermark_us)
        ids = np.array([r[1] for r in known], np.int64)
        yield pd.DataFrame({"event_id": ids[changed], "user_id": key[0], "n": n[changed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.times.exists():
            self._kept([tuple(r) for r in self.times.get()], timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([])

    def close(self) -> None:
        pass


def mastery_stream(observations: DataFrame, delay: str) -> DataFrame:
    """The estimate and count of every key that a trigger touched; observations as in OBSERVED, late by `delay` at most."""
    ship(observations.sparkSession)
    return observations.withWatermark("ts", delay).groupBy("student_id").transformWithState(MasteryFold(), OUT, "Update", "EventTime")


def hourly_stream(events: DataFrame, delay: str) -> DataFrame:
    """event_id, user_id and n of every submission and of those whose hour it falls into; late by `delay` at most."""
    ship(events.sparkSession)
    keyed = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", delay)
    return keyed.groupBy("user_id").transformWithStateInPandas(HourlyCount(), "event_id bigint, user_id bigint, n bigint", "Update", "EventTime")


def content_stream(events: DataFrame, delay: str) -> DataFrame:
    """student_id, assignment_id and content_hash of each submission whose content its student has not sent within `delay`."""
    sent = events.select("ts", F.col("user_id").alias("student_id"), F.col("event_type").alias("assignment_id"), F.sha2(F.col("props"), 256).alias("content_hash"))
    return sent.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["student_id", "assignment_id", "content_hash"]).drop("ts")


def ran(stream: DataFrame, name: str, mode: str, deliveries: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """A stream run over what its source holds; all that it gave out, reread from the shared folder.

    With `deliveries` it is run after each of them, on from where it stopped. A trigger writes a folder of its own, so one
    that is run again after a failure replaces what it had written.
    """
    spark = stream.sparkSession
    out, marks = run_folder(spark, name), run_folder(spark, f"{name}-marks")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    with keyed_state(spark):
        for deliver in deliveries or [lambda: None]:
            deliver()
            stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", out).parquet(out).drop("trigger")


def arriving(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """Parquet files as a stream of the columns of `like`, ts as a timestamp; `files` a trigger."""
    reader = spark.readStream.schema(like.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet"))


def last_estimates(given: DataFrame) -> DataFrame:
    """The estimate of each key with the most observations in it."""
    return given.groupBy("student_id", "concept_key").agg(F.max_by("estimate", "n").alias("estimate"), F.max("n").alias("n"))


def t1_streamed_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery by a stream over all events; the last estimate of every key."""
    return last_estimates(ran(mastery_stream(_events(spark, sf_dir).selectExpr(*OBSERVED), WHOLE), "mastery", "update"))


def t2_streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content of a student and an assignment once, as the stream lets it through."""
    return ran(content_stream(_events(spark, sf_dir), WHOLE), "contents", "append")


def t3_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submission with the number of its student's submissions in the hour up to it, and whether the limit rejects it."""
    counts = ran(hourly_stream(_events(spark, sf_dir), WHOLE), "hourly", "update").groupBy("event_id", "user_id").agg(F.max("n").alias("n"))
    return counts.withColumn("rejected", F.col("n") >= MOST_AN_HOUR)


BATCH = f"WITH {_ADJ}, {{}} SELECT student_id, concept_key, round(m, 6) AS estimate, CAST(n AS BIGINT) AS n FROM traced"


def reconciled(table: KeyedTable, batch: DataFrame) -> DataFrame:
    """The stream's table after the nightly repair: rows that differ from the batch fold are rewritten, others keep their version.

    The last digit of an estimate may differ between the two folds, so nearly equal ones count as equal.
    """
    have = table.read()
    same = batch.alias("b").join(have.alias("h"), ["student_id", "concept_key"]).filter((F.col("b.n") == F.col("h.n")) & (F.abs(F.col("b.estimate") - F.col("h.estimate")) < 2e-6))
    table.upsert(batch.join(same.select("student_id", "concept_key"), ["student_id", "concept_key"], "left_anti"))
    return table.read()


def t5_reconciled_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, each a trigger whatever its files are, with a watermark of a day: most of the second is late and dropped, and the repair puts it in."""
    folder, events = run_folder(spark, "deliveries"), spark.read.parquet(f"{sf_dir}/events.parquet")
    deliveries = [lambda part=part: events.filter(F.pmod("event_id", F.lit(2)) == part).write.parquet(f"{folder}/part={part}") for part in (0, 1)]
    stream = arriving(spark, f"{folder}/part=*", events).selectExpr(*OBSERVED)
    table = KeyedTable(spark, run_folder(spark, "mastery"), ["student_id", "concept_key"], buckets=16)
    table.upsert(last_estimates(ran(mastery_stream(stream, "1 day"), "deliveries", "update", deliveries)))
    return reconciled(table, query(BATCH.format(_FOLD))(spark, sf_dir)).drop(VERSION)


def queries() -> dict:
    return {f.__name__: f for f in (t1_streamed_mastery, t2_streamed_once, t3_rate_windows, t5_reconciled_mastery)}


def oracle_sql() -> dict[str, str]:
    """The batch forms: the fold, each content once, and the window over all submissions."""
    fold = BATCH.format(_STEPS)
    return {
        "t1_streamed_mastery": fold,
        "t2_streamed_once": "SELECT DISTINCT user_id AS student_id, event_type AS assignment_id, sha256(props) AS content_hash FROM events",
        "t3_rate_windows": f"SELECT event_id, user_id, count(*) OVER s AS n, count(*) OVER s >= {MOST_AN_HOUR} AS rejected FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)",
        "t5_reconciled_mastery": fold,
    }
