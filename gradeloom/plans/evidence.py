"""Domain views over the driver's tables, as common table expressions that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = """
obs AS (SELECT user_id AS student_id, event_type AS concept_key, least(1e0, value / 1e2) AS score, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 1e2 AS confidence,
  CASE event_id % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'repair' WHEN 2 THEN 'static' WHEN 3 THEN 'structural' WHEN 4 THEN 'report' ELSE 'manual' END AS source,
  ts AS observed_at, CAST(date_trunc('week', ts) AS DATE) AS assignment_id, event_id AS obs_id FROM events),
prereq AS (SELECT * FROM (VALUES ('purchase', 'signup', 0), ('signup', 'click', 0), ('click', 'view', 0), ('error', 'click', 0)) AS p(concept, prereq, pos)),
concepts AS (SELECT * FROM (VALUES ('view', 1, 'CO1'), ('click', 2, 'CO1'), ('signup', 4, 'CO2'), ('error', 5, 'CO2'), ('purchase', NULL, 'CO3')) AS c(concept, week, outcome)),
item AS (SELECT l_orderkey AS run_id,@PLACE() o_custkey AS student_id, o_orderpriority AS assignment_id, l_linenumber AS item_key, greatest(0e0, 1e0 - l_discount * 1e1) AS score, l_quantity AS weight, l_partkey % 5 AS concept, l_returnflag AS flag, l_shipdate AS submitted_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
run AS (SELECT o_orderkey AS run_id, o_custkey AS student_id, o_orderpriority AS assignment_id, CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'escalated' ELSE 'overridden' END AS state, o_orderdate AS started_at, o_totalprice AS price FROM orders),
mark AS (SELECT run_id, @TOTAL(score * weight) / @TOTAL(weight) AS total FROM item GROUP BY run_id),
verdict AS (SELECT r.*, m.total FROM run r JOIN mark m ON r.run_id = m.run_id),
student AS (SELECT c_custkey AS student_id, c_name AS name, c_mktsegment AS segment, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mastery AS (SELECT student_id, concept_key, @MEAN(score) AS m, count(*) AS n, 0.65e0 / sqrt(1e0 + count(*)) + 0.35e0 * (1e0 - 2e0 * abs(@MEAN(score) - 0.5e0)) AS u FROM obs GROUP BY student_id, concept_key)
"""

#: @NAME(argument): its form in Spark and in DuckDB.
_FORMS = {
    "SEC": ("unix_seconds(CAST({} AS TIMESTAMP))", "CAST(floor(epoch({})) AS BIGINT)"),
    "LIST": ("collect_list({})", "list({})"),
    "SORTED": ("array_sort(collect_list({}))", "list_sort(list({}))"),
    "SHA": ("sha2({}, 256)", "sha256({})"),
    "SIZE": ("CAST(size({}) AS BIGINT)", "CAST(len({}) AS BIGINT)"),
    "SPACES": ("split({}, '[ \\\\n]+')", "string_split_regex({}, '[ \\n]+')"),
    "JOINED": ("array_join({}, ',')", "array_to_string({}, ',')"),
    "DISTINCT": ("array_sort(array_distinct({}))", "list_sort(list_distinct({}))"),
    "INTER": ("array_intersect({})", "list_intersect({})"),
    "UNITE": ("array_union({})", "list_distinct(list_concat({}))"),
    "EXTALL": ("regexp_extract_all({}, 0)", "regexp_extract_all({})"),
    "RALL": ("regexp_replace({})", "regexp_replace({}, 'g')"),
    "EACH": ("explode({})", "unnest({})"),
    # summed in the log's order, in that of the lines in their files, or in that of the values, whatever the partitions are: thresholds hang on the last bits
    "MEAN": ("(aggregate(array_sort(collect_list(struct(obs_id, {0} AS v))), 0e0, (a, x) -> a + coalesce(x.v, 0e0)) / nullif(count({0}), 0))", "avg({})"),
    "EVEN": ("(aggregate(array_sort(collect_list({0})), 0e0, (a, x) -> a + x) / nullif(count({0}), 0))", "avg({})"),
    "PLACE": (" l_place AS place,", ""),
    "TOTAL": ("if(count({0}) > 0, aggregate(array_sort(collect_list(struct(place, {0} AS v))), 0e0, (a, x) -> a + coalesce(x.v, 0e0)), null)", "sum({})"),
    "ISO": ("date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime({}, '%Y-%m-%dT%H:%M:%S')"),
}
_CALL = re.compile(r"@(\w+)\(((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*)\)")


def rendered(sql: str, duck: bool, views: str = VIEWS) -> str:
    """The query with its views in front, in one dialect."""
    text = f"WITH RECURSIVE {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH RECURSIVE {views} {sql}"
    text = text.replace("@RLIKE", "SIMILAR TO" if duck else "RLIKE")
    while m := _CALL.search(text):
        text = text[: m.start()] + _FORMS[m[1]][duck].format(m[2]) + text[m.end() :]
    return text


def load(spark: SparkSession, sf_dir: str, tables: tuple | list = TABLES) -> None:
    """Views of the tables; lineitem has l_place, a line's place in its file, and the file where there are several."""
    for t in tables:
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "lineitem":
            row = F.col("_metadata.row_index")
            rows = rows.select("*", (F.struct("_metadata.file_path", row) if len(rows.inputFiles()) > 1 else row).alias("l_place"))
        rows.createOrReplaceTempView(t)


#: Lines of orders that one task joins and sorts, about 340 bytes each there.
LINES_A_TASK = 500_000
_ITEMS = "FROM lineitem JOIN orders"
#: Views that join orders, and the side of theirs that grows with the lines: files that compress well look small enough to be sent to all tasks.
_MERGED = {"item AS (SELECT l_orderkey": "orders", "verdict AS (SELECT r.*": "r, m"}


def spread(spark: SparkSession, text: str) -> str:
    """The text with joins of items by merges, and with as many tasks for them as their number asks for, where the session's partitions are fewer."""
    tasks = -(-spark.table("lineitem").count() // LINES_A_TASK)
    if tasks > 1:
        for view, side in _MERGED.items():
            text = text.replace(view, view.replace("SELECT", f"SELECT /*+ MERGE({side}) */"))
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return text
    return text.replace(_ITEMS, f"FROM (SELECT /*+ REPARTITION({tasks}, l_orderkey) */ * FROM lineitem) AS lineitem JOIN orders")


def query(sql: str, views: str = VIEWS):
    """A registered query: loads the tables it names and runs its Spark form."""
    text = rendered(sql, duck=False, views=views)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    of_items = re.search(r"\b(item|mark|verdict)\b", sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        load(spark, sf_dir, used)
        return spark.sql(spread(spark, text) if of_items else text)

    return run
