"""Briefs to checkable requirements and rubric drafts, as DataFrame expressions.

Each rule is a pattern over one sentence; sentences are exploded, rules become rows, and the first row of each dedupe key
stays, in the order of the brief.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Patterns with one captured name: kind, pattern, text before and after the name, weight.
NAMED = [
    ("api_absent", r"(?i)(?:without using|do not use|don't use|may not use|must not use|no use of|cannot use)\s+(?:the\s+)?(?:built-?in\s+)?[`'\"]?(\w+)", "Does not use ", ", as the brief requires", 4.0),
    ("function_defined", r"(?i)(?:implement|define|write|provide|complete)\s+(?:a\s+|the\s+)?(?:function|method|procedure)\s+(?:called\s+|named\s+)?[`'\"]?(\w+)", "Defines ", "() with the required signature", 6.0),
    ("class_defined", r"(?i)(?:implement|define|write|create)\s+(?:a\s+|the\s+)?class\s+(?:called\s+|named\s+)?[`'\"]?(\w+)", "Defines the class ", "", 6.0),
    ("api_called", r"(?i)(?:use|using|call|apply|via)\s+(?:the\s+)?[`'\"]?(\w+)[`'\"]?\s*(?:\(\))?\s*(?:function|method|module|library)", "Uses ", " as the brief specifies", 5.0),
]
FILLERS = ["a", "the", "this", "it", "your", "any"]
# Word rules: dedupe key, kind, words, text, category, weight. Of rules with one key the first in a sentence counts.
WORDED = [
    ("recursion", "recursion_present", ["recursive", "recursion", "recursively"], "Uses recursion, as the brief requires", "correctness", 8.0),
    ("iteration", "uses_iteration", ["iterative", "iteratively", "using a loop", "with a loop"], "Uses iteration, as the brief requires", "correctness", 6.0),
    ("empty", "guard_present", ["empty", "zero-length", "no elements", "nothing is passed", "blank input"], "Handles the empty-input case without crashing", "robustness", 6.0),
    ("empty", "guard_present", ["edge case", "boundary", "corner case", "single element", "one element"], "Guards the boundary cases the brief calls out", "robustness", 5.0),
    ("errors", "error_handling", ["exception", "error handling", "handle errors", "invalid input", "raise", "gracefully"], "Handles invalid input rather than failing silently", "robustness", 5.0),
    ("decompose", "min_functions", ["helper function", "break the problem", "decompose", "separate functions", "modular"], "Decomposes the problem into more than one function", "style", 4.0),
    ("globals", "no_global_state", ["without global", "no global", "avoid global"], "Avoids mutating global state", "style", 4.0),
    ("docs", "documented", ["comment", "document", "docstring", "readable", "explain your code"], "Documents the code so a reader can follow the intent", "style", 4.0),
    ("report", None, ["report", "write-up", "writeup", "justify", "explain your approach", "discuss"], "The report explains the approach actually submitted", "communication", 5.0),
]
ALGORITHM_WORDS = {
    "binary_search": ["binary search", "halving search", "bisect"],
    "divide_and_conquer_sort": ["merge sort", "quick sort", "quicksort", "divide and conquer"],
    "quadratic_sort": ["bubble sort", "insertion sort", "selection sort", "exchange sort"],
    "linear_scan": ["linear search", "linear scan", "single pass", "one pass"],
    "hash_lookup": ["hash map", "hash table", "dictionary", "constant-time lookup"],
    "dynamic_programming": ["dynamic programming", "memoisation", "memoization", "tabulation"],
    "recursive_traversal": ["traversal", "traverse", "depth-first", "breadth-first", "dfs", "bfs"],
}
COMPLEXITY = {"1": ("O(1)", 0), "n": ("O(n)", 1), "logn": ("O(log n)", 1), "nlogn": ("O(n log n)", 1), "n^2": ("O(n^2)", 2), "n2": ("O(n^2)", 2), "n^3": ("O(n^3)", 3)}
MOST_ITEMS = 12
#: Rules that a sentence can meet only where an earlier one of the same family did not.
_YIELDS_TO = {1: 0, 3: 2}


def _has(words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("low"), w))


def sentences(briefs: DataFrame, text: str = "brief") -> DataFrame:
    """briefs with pos and sentence: the bullets where there are any, else sentences of over eight characters. Null: none."""
    bullets = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+(.{4,})$"), 1)
    plain = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: F.length(s) > 8)
    return briefs.select("*", F.posexplode(F.when(F.size(bullets) > 0, F.transform(bullets, F.trim)).otherwise(plain)).alias("pos", "sentence"))


def _found(key: Column, kind: str | None, text: Column, category: str, weight: float, target: Column | None = None, checks: tuple = ("static",)) -> Column:
    return F.struct(
        key.alias("dedupe"), F.lit(kind).cast("string").alias("kind"), (F.lit(None) if target is None else target).cast("string").alias("target"),
        text.alias("text"), F.lit(category).alias("category"), F.lit(weight).alias("weight"), F.array(*map(F.lit, checks)).alias("checks"),
    )


def _namer(kind: str, before: str, after: str, weight: float):
    """The requirement that a captured name makes."""
    return lambda n: _found(F.concat(F.lit(kind + ":"), n), kind, F.concat(F.lit(before), n, F.lit(after)), "correctness", weight, n)


def requirements(briefs: DataFrame, *, key: str = "id", text: str = "brief", entry: str = "solve") -> DataFrame:
    """key, ord (from 1), kind, target, text, category, weight and checks of each requirement.

    A brief without a required function, an empty or a null one included, has its entry point as its first requirement.
    """
    rules = []
    for kind, pattern, before, after, weight in NAMED:
        names = F.regexp_extract_all("sentence", F.lit(pattern), 1)
        if kind == "api_called":
            names = F.filter(names, lambda n: ~F.lower(n).isin(FILLERS))
        rules.append(F.transform(names, _namer(kind, before, after, weight)))

    def worded(i: int) -> Column:
        dedupe, kind, words, line, category, weight = WORDED[i]
        met = _has(words) & ~_has(WORDED[_YIELDS_TO[i]][2]) if i in _YIELDS_TO else _has(words)
        return F.when(met, F.array(_found(F.lit(dedupe), kind, F.lit(line), category, weight, F.lit("input_length") if kind == "guard_present" else None, ("static",) if kind else ("report",)))).otherwise(F.array())

    rules += [worded(i) for i in range(4)]
    raw = F.transform(F.regexp_extract_all("sentence", F.lit(r"(?i)\bO\s*\(\s*([^)]{1,20})\s*\)"), 1), lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"\*\*", "^"))
    label = F.create_map(*[F.lit(x) for k, (name, _) in COMPLEXITY.items() for x in (k, name)])
    depth = F.create_map(*[F.lit(x) for k, (_, d) in COMPLEXITY.items() for x in (k, d)])
    known = F.filter(raw, lambda c: F.map_contains_key(label, c))
    rules.append(F.transform(known, lambda c: _found(F.lit("complexity"), "loop_nesting", F.concat(F.lit("Runs in the required complexity class, "), label[c]), "efficiency", 6.0, depth[c], ("static", "report"))))
    named = F.coalesce(*[F.when(_has(words), F.lit(name)) for name, words in ALGORITHM_WORDS.items()])
    approach = _found(F.lit("algorithm"), "algorithm_class", F.concat(F.lit("Implements the required approach ("), F.translate(named, "_", " "), F.lit(")")), "correctness", 8.0, named, ("static", "structural"))
    rules.append(F.when(named.isNotNull(), F.array(approach)).otherwise(F.array()))
    rules += [worded(i) for i in range(4, len(WORDED))]

    read = sentences(briefs.select(key, text), text).withColumn("low", F.lower("sentence"))
    rows = read.select(key, "pos", F.posexplode(F.concat(*rules)).alias("at", "r")).select(key, "pos", "at", "r.*")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key, "dedupe").orderBy("pos", "at"))).filter("__n = 1").drop("__n")
    have = first.filter("kind = 'function_defined'").select(key)
    implied = briefs.select(key).join(have, key, "left_anti").select(
        key, F.lit(-1).alias("pos"), F.lit(0).alias("at"), _found(F.lit("entry"), "function_defined", F.lit(f"Defines the required entry point {entry}()"), "correctness", 3.0, F.lit(entry)).alias("r")
    )
    every = first.unionByName(implied.select(key, "pos", "at", "r.*"))
    return every.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos", "at")).alias("ord"), "kind", "target", "text", "category", "weight", "checks")


def rubric(briefs: DataFrame, *, key: str = "id", text: str = "brief", mode: str = "executable", report: bool = False, entry: str = "solve") -> DataFrame:
    """Draft items: the first requirements of each brief, and those that its grading mode needs beside them."""
    checks = F.col("checks")
    if mode == "executable":
        checks = F.when(F.col("kind").isNull() & ~F.array_contains(checks, "report"), F.array_append(checks, "test")).otherwise(checks)
    if not report:
        less = F.array_remove(checks, "report")
        checks = F.when(F.size(less) > 0, less).otherwise(F.array(F.lit("static")))
    items = requirements(briefs, key=key, text=text, entry=entry).filter(F.col("ord") <= MOST_ITEMS).withColumn("checks", checks)
    has = items.groupBy(key).agg(F.max("ord").alias("n"), F.collect_set("kind").alias("kinds"), F.bool_or(F.array_contains("checks", "test")).alias("tested"))

    def extra(when: Column, kind: str | None, line: str, category: str, weight: float, check: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(line).alias("text"), F.lit(category).alias("category"), F.lit(weight).alias("weight"), F.array(F.lit(check)).alias("checks")))

    if mode == "executable":
        more = [extra(~F.col("tested"), None, "Produces correct output for the specified behaviour", "correctness", 20.0, "test")]
    else:
        thin = F.col("n") < 3
        more = [
            extra(thin & ~F.array_contains("kinds", "min_functions"), "min_functions", "Decomposes the problem into named functions rather than one block", "style", 4.0, "static"),
            extra(thin & ~F.array_contains("kinds", "documented"), "documented", "Explains its intent in comments a reader can follow", "style", 4.0, "static"),
        ]
    added = has.select(key, "n", F.posexplode(F.array_compact(F.array(*more))).alias("i", "x")).select(key, (F.col("n") + F.col("i") + 1).cast("int").alias("ord"), F.lit(None).cast("string").alias("target"), "x.*")
    whole = items.unionByName(added)
    return whole.withColumn("item_key", F.concat(F.lit("rb_"), F.lpad(F.col("ord").cast("string"), 2, "0")))


# Fixed sample of briefs: named function with arity, bullets, forbidden call with complexity, vague, empty, null.
SAMPLE = [
    (1, "Implement a function called solve(xs, t). Use recursion and handle the empty list."),
    (2, "Tasks:\n- Write a class Stack with a loop\n- Comment your code\n- Discuss it in a report\n"),
    (3, "Do not use sorted. It must run in O(n log n) with merge sort; without using sorted!"),
    (4, "Make it nice."),
    (5, ""),
    (6, None),
]


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, "id int, brief string")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns as briefs."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("brief"))


def queries() -> dict:
    return {
        "b1_requirements": lambda spark, d: requirements(spoken(spark, d)),
        "e17_rubric_draft": lambda spark, d: rubric(spoken(spark, d)),
        "x1_drafter_static": lambda spark, d: rubric(sample(spark), mode="static", report=True),
    }
