"""Streams over several triggers with rows out of order, repeated and late, against the batch forms."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.runtime import run_folder, shared_root
from gradeloom.sources.keyed import KeyedTable
from gradeloom.streaming import mastery as M

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def delivered(spark, deliveries, delay_files=1):
    """Deliveries of rows, each a file and a trigger of its own."""
    folder = run_folder(spark, "arrivals")
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return M.arriving(spark, folder, spark.createDataFrame([], SCHEMA), delay_files)


def events(n, seed, hours):
    rng = random.Random(seed)
    at = sorted(rng.uniform(0, hours * 3600) for _ in range(n))
    return [(i, START + dt.timedelta(seconds=int(t)), rng.randint(1, 3), rng.choice(["view", "click"]), rng.uniform(0, 120), '{"k": %d}' % rng.randint(0, 99)) for i, t in enumerate(at)]


def folded(rows):
    """Batch mastery in Python: {(student, concept): (estimate, n)}."""
    out = {}
    for e, _, u, c, v, p in sorted(rows, key=lambda r: (r[1], r[0])):
        m, n = out.get((u, c), (M.PRIOR, 0))
        source = ["test", "repair", "static", "structural", "report", "manual"][e % 6]
        out[(u, c)] = M.updated(m, min(1.0, v / 100), int("".join(filter(str.isdigit, p))) / 100, source), n + 1
    return {k: (round(m, 6), n) for k, (m, n) in out.items()}


def hourly(rows):
    return {r[0]: sum(o[2] == r[2] and r[1] - dt.timedelta(hours=1) <= o[1] <= r[1] for o in rows) for r in rows}


@pytest.fixture(scope="module")
def disordered():
    """Twelve days of events in six deliveries; each event comes up to ten hours after its time, so deliveries overlap."""
    rows, rng = events(600, 3, 288), random.Random(8)
    late = {r[0]: (r[1] - START).total_seconds() + rng.uniform(0, 36_000) for r in rows}
    return rows, [d for i in range(7) if (d := [r for r in rows if i * 48 * 3600 <= late[r[0]] < (i + 1) * 48 * 3600])]


def test_mastery_out_of_order_within_the_delay_is_the_batch_fold(spark, disordered):
    rows, deliveries = disordered
    assert any(a[1] > b[1] and a[2:4] == b[2:4] for x, y in zip(deliveries, deliveries[1:], strict=False) for a in x for b in y)
    got = M.last_estimates(M.ran(M.mastery_stream(delivered(spark, deliveries).selectExpr(*M.OBSERVED), "11 hours"), "t", "update"))
    assert {(r.student_id, r.concept_key): (r.estimate, r.n) for r in got.collect()} == folded(rows)


def test_hourly_counts_out_of_order_within_the_delay_are_those_of_the_window(spark, disordered):
    rows, deliveries = disordered
    got = M.ran(M.hourly_stream(delivered(spark, deliveries), "11 hours"), "t", "update").groupBy("event_id").agg(F.max("n").alias("n"))
    assert {r.event_id: r.n for r in got.collect()} == hourly(rows) and max(hourly(rows).values()) > 2


def test_state_of_silent_students_is_cleared_by_timers(spark):
    early, far = events(40, 1, 2), (999, START + dt.timedelta(days=9), 77, "view", 1.0, '{"k": 1}')
    stream = M.hourly_stream(delivered(spark, [early, [far], [(1000, far[1] + dt.timedelta(days=1), 77, "view", 1.0, '{"k": 1}')]]), "1 hour")
    with M.keyed_state(spark):
        q = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", run_folder(spark, "marks")).trigger(availableNow=True).start()
        q.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert left[-1] < left[0], left


def test_each_content_once_over_triggers(spark):
    rows = events(60, 5, 20)
    again = [(1000 + r[0], r[1] + dt.timedelta(minutes=7), *r[2:]) for r in rows[::3]]
    late = [(2000, rows[0][1], 9, "view", 5.0, '{"k": 7}'), (2001, rows[0][1], *rows[0][2:])]
    got = M.ran(M.content_stream(delivered(spark, [rows[:40], rows[40:] + again, late]), "3 days"), "t", "append").collect()
    assert len(got) == len({(r[2], r[3], r[5]) for r in rows + again + late})
    assert len({tuple(r) for r in got}) == len(got)


def test_every_content_of_the_table_comes_once(spark):
    """The table's own events: a submission's id is new each time, its content need not be."""
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    contents = table.select("user_id", "event_type", "props").distinct().count()
    assert M.t2_streamed_once(spark, "/root/testdata/sf0.001").count() == contents < table.count()


def test_a_late_row_is_dropped_and_then_repaired(spark):
    rows = events(200, 6, 100)
    late, rest = rows[3], rows[:3] + rows[4:]
    stream = M.mastery_stream(delivered(spark, [rest, [late]]).selectExpr(*M.OBSERVED), "1 hour")
    table = KeyedTable(spark, run_folder(spark, "t5"), ["student_id", "concept_key"], buckets=4)
    table.upsert(M.last_estimates(M.ran(stream, "t", "update")))
    have = {(r.student_id, r.concept_key): (r.estimate, r.n) for r in table.read().collect()}
    assert have == folded(rest) != folded(rows)
    batch = spark.createDataFrame([(*k, *v) for k, v in folded(rows).items()], M.OUT)
    after = M.reconciled(table, batch).collect()
    assert {(r.student_id, r.concept_key): (r.estimate, r.n) for r in after} == folded(rows)
    assert {(r.student_id, r.concept_key) for r in after if r.version == 2} == {late[2:4]}


def test_a_delivery_is_one_trigger_however_many_files_it_has(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    for other in set(os.listdir("/root/testdata/sf0.001")) - {"events.parquet"}:
        os.symlink(f"/root/testdata/sf0.001/{other}", f"{tmp_path}/{other}")
    before = set(glob.glob(f"{shared_root(spark)}/gradeloom/deliveries-*/trigger=*"))
    got = M.t5_reconciled_mastery(spark, str(tmp_path)).collect()
    triggers = set(glob.glob(f"{shared_root(spark)}/gradeloom/deliveries-*/trigger=*")) - before
    assert len(got) == table.select("user_id", "event_type").distinct().count()
    assert len(triggers) <= 4, triggers  # two with data, and those in which timers end
