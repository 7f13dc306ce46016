"""Sinks that write: keyed upserts, a rebuild that carries labels, a cascading delete, an audit log and quoted CSV, all reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.plans.authoring import _ITEM_FLAG, _ITEMS
from gradeloom.plans.domain import _ADJ, _FOLD, _STEPS
from gradeloom.plans.evidence import VIEWS, query
from gradeloom.runtime import run_folder
from gradeloom.sources.keyed import VERSION, KeyedTable

#: The first of two runs sees the log and the orders up to here.
SEEN, ORDERED = "TIMESTAMP '2024-01-22 00:00:00'", "TIMESTAMP '1997-01-01 00:00:00'"
EARLY = VIEWS.replace("event_id AS obs_id FROM events)", f"event_id AS obs_id FROM events WHERE ts < {SEEN})").replace("ON l_orderkey = o_orderkey)", f"ON l_orderkey = o_orderkey WHERE o_orderdate < {ORDERED})")

# Digits kept of a stored estimate, estimates kept of a trajectory, least failures of an assignment's clusters.
DIGITS, TRAIL, LEAST_FAILURES = 4, 40, 3
_KEPT = f"round(m, {DIGITS}) AS estimate, round(least(1e0, 0.65e0 / sqrt(1e0 + n) + 0.35e0 * (1e0 - 2e0 * abs(m - 0.5e0))), {DIGITS}) AS uncertainty, CAST(n AS BIGINT) AS evidence_count"
_STATES = f"SELECT student_id, concept_key, {_KEPT} FROM traced"
MASTERY = f"WITH {_ADJ}, {_FOLD} {_STATES}"
ITEMS = f"WITH {_ITEMS} SELECT item_key, assignment_id, n, round(difficulty, 6) AS difficulty, round(discrimination, 5) AS discrimination, round(alignment, 5) AS alignment, {_ITEM_FLAG} AS flag FROM items"
#: A cluster's signature: the failed sources and the concept of a student's failures in an assignment.
CLUSTERS = f"""WITH failure AS (SELECT student_id, assignment_id, @JOINED(@DISTINCT(@LIST(source))) AS failed, @JOINED(@DISTINCT(@LIST(concept_key))) AS concepts FROM obs WHERE score < 0.5e0 GROUP BY student_id, assignment_id),
course AS (SELECT assignment_id FROM failure GROUP BY assignment_id HAVING count(*) >= {LEAST_FAILURES})
SELECT f.assignment_id, concat(failed, ' | ', concepts) AS signature, count(*) AS size, min(student_id) AS representative FROM failure f JOIN course c ON c.assignment_id = f.assignment_id GROUP BY f.assignment_id, concat(failed, ' | ', concepts) HAVING count(*) >= 2"""
#: Labels that an instructor gave after the first run.
_NAMED = "size >= 3"


def upserted(spark: SparkSession, sf_dir: str, sql: str, keys: list[str]) -> DataFrame:
    """The table after a run over the early rows and one over all; `version` is the run that last changed a row."""
    table = KeyedTable(spark, run_folder(spark, "keyed"), keys, buckets=16)
    table.upsert(query(sql, EARLY)(spark, sf_dir))
    table.upsert(query(sql)(spark, sf_dir))
    return table.read()


def snk1_mastery_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced mastery by student and concept, upserted twice."""
    return upserted(spark, sf_dir, MASTERY, ["student_id", "concept_key"])


def snk2_item_stats_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item statistics by item and cohort, upserted twice."""
    return upserted(spark, sf_dir, ITEMS, ["item_key", "assignment_id"])


def snk3_label_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters rebuilt over all failures; the labels given after the first run come along by signature."""
    table = KeyedTable(spark, run_folder(spark, "clusters"), ["assignment_id", "signature"], buckets=16)
    table.rebuild(query(CLUSTERS, EARLY)(spark, sf_dir), ["label", "named_by"])
    named = table.read().filter(_NAMED).drop(VERSION)
    table.upsert(named.withColumns({"label": F.concat(F.lit("seen "), "size"), "named_by": F.lit("instructor")}))
    table.rebuild(query(CLUSTERS)(spark, sf_dir), ["label", "named_by"])
    return table.read().withColumn("label", F.coalesce("label", F.lit(""))).drop(VERSION)


def deleted_assignment(tables: dict[str, KeyedTable], runs: DataFrame, assignment: str, confirm: str) -> dict[str, int]:
    """The assignment's runs and all rows that hang on them go, from the leaves up; the versions now. `confirm` repeats its name."""
    if confirm != assignment:
        raise ValueError("the confirmation does not repeat the assignment's name")
    own = runs.filter(F.col("assignment_id") == assignment).select("run_id").distinct()
    return {name: table.delete(own) for name, table in tables.items()}


def snk6_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, verdicts and runs left after one assignment's deletion, by table, and the sum of their ids."""
    sources = {"item": ("SELECT run_id, item_key, student_id, score FROM item", ["run_id", "item_key", "student_id", "score"]), "verdict": ("SELECT run_id, total FROM verdict", ["run_id"]), "run": ("SELECT run_id, student_id, assignment_id FROM run", ["run_id"])}
    tables = {}
    for name, (sql, keys) in sources.items():
        tables[name] = KeyedTable(spark, run_folder(spark, name), keys, buckets=16)
        tables[name].upsert(query(sql)(spark, sf_dir))
    deleted_assignment(tables, tables["run"].read(), "1-URGENT", "1-URGENT")
    left = [t.read().agg(F.count(F.lit(1)).alias("n"), F.sum("run_id").alias("ids")).select(F.lit(name).alias("name"), "n", "ids") for name, t in tables.items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


AUDIT = "SELECT 'run.{0}' AS kind, CAST(student_id AS STRING) AS actor, CAST(run_id AS STRING) AS subject, started_at AS at FROM run WHERE state = '{0}'"


def snk7_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log after two appends; an append adds files and rewrites none."""
    path = run_folder(spark, "audit")
    for state in ("released", "overridden"):
        rows = query(AUDIT.format(state))(spark, sf_dir)
        rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


MARKS = "SELECT student_id, round(max(CASE WHEN assignment_id = '1-URGENT' THEN total END), 6) AS a1, round(max(CASE WHEN assignment_id = '2-HIGH' THEN total END), 6) AS a2, round(max(CASE WHEN assignment_id = '3-MEDIUM' THEN total END), 6) AS a3, CAST(count(*) AS BIGINT) AS n FROM verdict GROUP BY student_id"


def snk8_marks_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by student and assignment, written as quoted CSV with a header and reread; no mark is the empty text."""
    path = run_folder(spark, "marks")
    rows = query(MARKS)(spark, sf_dir)
    rows.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"', nullValue="")


def queries() -> dict:
    return {f.__name__: f for f in (snk1_mastery_upsert, snk2_item_stats_upsert, snk3_label_carry, snk6_cascade_delete, snk7_audit_append, snk8_marks_pivot)}


def oracle_sql(rendered) -> dict[str, str]:
    """SQL by name; `rendered(sql, duck, views)` puts views in front."""

    def both(sql: str, tail: str) -> str:
        return f"WITH early AS ({rendered(sql, True, EARLY)}), late AS ({rendered(sql, True)}) {tail}"

    mastery = f"WITH {_ADJ}, {_STEPS} {_STATES}"
    version = "SELECT a.*, CAST(CASE WHEN EXISTS (SELECT 1 FROM early e WHERE {}) THEN 1 ELSE 2 END AS BIGINT) AS version FROM late a"
    same = lambda *names: " AND ".join(f"e.{c} IS NOT DISTINCT FROM a.{c}" for c in names)
    left = "SELECT '{0}' AS name, count(*) AS n, CAST(sum(run_id) AS BIGINT) AS ids FROM {0} WHERE run_id NOT IN (SELECT run_id FROM run WHERE assignment_id = '1-URGENT')"
    return {
        "snk1_mastery_upsert": both(mastery, version.format(same("student_id", "concept_key", "estimate", "uncertainty", "evidence_count"))),
        "snk2_item_stats_upsert": both(ITEMS, version.format(same("item_key", "assignment_id", "n", "difficulty", "discrimination", "alignment", "flag"))),
        "snk3_label_carry": both(CLUSTERS, "SELECT a.*, CASE WHEN e.size >= 3 THEN 'seen ' || e.size ELSE '' END AS label, CASE WHEN e.size >= 3 THEN 'instructor' END AS named_by FROM late a LEFT JOIN early e ON e.assignment_id = a.assignment_id AND e.signature = a.signature"),
        "snk6_cascade_delete": rendered(" UNION ALL ".join(left.format(t) for t in ("(SELECT DISTINCT run_id, item_key, student_id, score FROM item)", "verdict", "run")).replace("'(SELECT DISTINCT run_id, item_key, student_id, score FROM item)'", "'item'"), True),
        "snk7_audit_append": rendered(AUDIT.format("released") + " UNION ALL " + AUDIT.format("overridden"), True),
        "snk8_marks_pivot": rendered(MARKS, True),
    }
