"""Static checks as column expressions over the facts of a source, and property predicates over array columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.operators.grouped import code_facts
from gradeloom.operators.source import column, named, sample

FACTS = (
    "struct<parsed:boolean, functions:array<struct<name:string, params:int, depth:int, recursive:boolean, guards:array<string>, handles:boolean, globals:boolean, calls:array<string>>>,"
    " classes:array<string>, imports:array<string>, comments:double, loop_depth:int, branches:int, recursive:boolean>"
)
LOOPS, DEFS = (ast.For, ast.AsyncFor, ast.While), (ast.FunctionDef, ast.AsyncFunctionDef)


def _depth(node: ast.AST) -> int:
    return isinstance(node, LOOPS) + max((_depth(c) for c in ast.iter_child_nodes(node)), default=0)


def _recursive(calls: dict[str, set[str]]) -> set[str]:
    """Functions that can reach themselves."""
    out = set()
    for start in calls:
        seen, todo = set(), [start]
        while todo:
            for n in calls.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if start in seen:
            out.add(start)
    return out


def facts_of(source: str) -> dict:
    """Facts of one source; of one that does not parse, only its comments."""
    lines = [x for x in source.splitlines() if x.strip()]
    out = {"parsed": True, "functions": [], "classes": [], "imports": [], "comments": sum(x.lstrip().startswith("#") for x in lines) / max(1, len(lines)), **{k: v for k, v in code_facts(source).items() if k in ("loop_depth", "branches", "recursive")}}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return {**out, "parsed": False}
    nodes = list(ast.walk(tree))
    defs = [n for n in nodes if isinstance(n, DEFS)]
    calls = {d.name: {ast.unparse(c.func) for c in ast.walk(d) if isinstance(c, ast.Call)} for d in defs}
    cyclic = _recursive(calls)
    for d in defs:
        own = list(ast.walk(d))
        args = d.args.posonlyargs + d.args.args + d.args.kwonlyargs
        out["functions"].append({
            "name": d.name, "params": len(args), "depth": _depth(d), "recursive": d.name in cyclic,
            "guards": [f"{ast.unparse(n.test)} {'param' if {a.arg for a in args} & {x.id for x in ast.walk(n.test) if isinstance(x, ast.Name)} else ''}".strip().lower() for n in own if isinstance(n, (ast.If, ast.IfExp, ast.Assert))],
            "handles": any(isinstance(n, ast.Try) for n in own), "globals": any(isinstance(n, ast.Global) for n in own), "calls": sorted(calls[d.name]),
        })
    out["classes"] = [n.name for n in nodes if isinstance(n, ast.ClassDef)]
    out["imports"] = [a.name for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    return out


def facts(source: str) -> Column:
    """The facts of a text column, computed once a row; the checks read them natively. The named algorithms are rules over them."""
    found = column(lambda text: [facts_of(text)], f"array<{FACTS}>", source)
    own = lambda f: named(F.coalesce(F.col(source), F.lit("")), f["loop_depth"], f["branches"], f["recursive"])
    return F.transform(found, lambda f: f.withField("algorithms", F.transform(own(f), lambda x: x["algorithm"])))[0]


def _some(test: Callable[[Column], Column]) -> Callable[[Column, Column, Column], Column]:
    return lambda f, target, number: F.exists(f["functions"], test)


def _called(f: Column, target: Column, number: Column) -> Column:
    return F.exists(f["functions"], lambda x: F.exists(x["calls"], lambda c: (c == target) | F.endswith(c, F.concat(F.lit("."), target)))) | F.array_contains(f["imports"], target)


def _guarded(f: Column, target: Column, number: Column) -> Column:
    length = target.isin("input_length", "length")
    hit = lambda g: F.contains(g, F.lower(target)) | (length & (F.contains(g, F.lit("len(")) | F.endswith(g, F.lit(" param"))))
    return F.exists(f["functions"], lambda x: F.exists(x["guards"], hit))


def _shallow(f: Column, target: Column, number: Column) -> Column:
    return F.forall(f["functions"], lambda x: x["depth"] <= F.coalesce(number, F.lit(1.0)))


#: Checks by kind: (facts, target, number) to a boolean column.
CHECKS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "guard_present": _guarded,
    "recursion_present": _some(lambda x: x["recursive"]),
    "api_called": _called,
    "api_absent": lambda f, t, n: ~_called(f, t, n),
    "loop_nesting": _shallow,
    "complexity_class": _shallow,
    "error_handling": _some(lambda x: x["handles"]),
    "function_defined": lambda f, t, n: F.exists(f["functions"], lambda x: (x["name"] == t) & (n.isNull() | (x["params"] == n))),
    "class_defined": lambda f, t, n: F.when(t.isNull(), F.size(f["classes"]) > 0).otherwise(F.array_contains(f["classes"], t)),
    "algorithm_class": lambda f, t, n: F.when(t.isNull(), F.size(f["algorithms"]) > 0).otherwise(F.array_contains(f["algorithms"], t)),
    "uses_iteration": _some(lambda x: x["depth"] > 0),
    "min_functions": lambda f, t, n: F.size(f["functions"]) >= F.coalesce(n, F.lit(2.0)),
    "no_global_state": lambda f, t, n: ~F.exists(f["functions"], lambda x: x["globals"]),
    "documented": lambda f, t, n: f["comments"] >= F.coalesce(n, F.lit(0.05)),
}
#: Kinds whose result is a hint, not a verdict.
ADVISORY = frozenset({"loop_nesting", "complexity_class", "algorithm_class"})


def checked(rows: DataFrame, *, kind: str = "kind", target: str = "target", number: str = "number", source: str = "source") -> DataFrame:
    """rows with passed and advisory. An unknown kind, and a check that has no answer, are advisory failures."""
    f, t, n = F.col("__facts"), F.col(target), F.col(number).cast("double")
    result = F.coalesce(*[F.when(F.col(kind) == k, check(f, t, n)) for k, check in CHECKS.items()])
    read = rows.withColumn("__facts", facts(source)).withColumn("__r", result)
    return read.select(*rows.columns, F.coalesce("__r", F.lit(False)).alias("passed"), (F.col("__r").isNull() | F.col(kind).isin(*ADVISORY)).alias("advisory"))


def _distinct(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


#: Predicates by name: (input array, output array) to a boolean column.
PREDICATES: dict[str, Callable[[Column, Column], Column]] = {
    "is_ascending": lambda i, o: F.array_sort(o) == o,
    "is_descending": lambda i, o: F.sort_array(o, asc=False) == o,
    "multiset_equal_to_input": lambda i, o: F.array_sort(i) == F.array_sort(o),
    "same_length_as_input": lambda i, o: F.size(i) == F.size(o),
    "subset_of_input": lambda i, o: F.size(F.array_except(o, i)) == 0,
    "no_duplicates": lambda i, o: _distinct(o),
    "is_not_none": lambda i, o: o.isNotNull(),
    "non_negative": lambda i, o: F.forall(o, lambda x: x >= 0),
    "empty_in_empty_out": lambda i, o: (F.size(i) > 0) | (F.size(o) == 0),
    "keys_are_input_values": lambda i, o: F.array_sort(F.array_distinct(i)) == F.array_sort(F.array_distinct(o)),
}


def failed_predicates(names: list[str], given: Column, made: Column) -> Column:
    """The names of the predicates that do not hold; an unknown one, or one without an answer, is a failure."""
    holds = [F.when(~F.coalesce(PREDICATES[n](given, made) if n in PREDICATES else F.lit(False), F.lit(False)), F.lit(n)) for n in names]
    return F.array_compact(F.array(*holds))


def queries() -> dict:
    def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
        specs = spark.createDataFrame([(k, "solve" if k == "function_defined" else "binary_search" if k == "algorithm_class" else "len" if k.startswith("api") else "input_length" if k == "guard_present" else None, None) for k in CHECKS], "kind string, target string, number double")
        return checked(sample(spark).select("id", "source").crossJoin(specs)).drop("source", "number")

    def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return rows.select("vec_id", F.array_join(failed_predicates(list(PREDICATES), F.col("embedding"), F.array_sort("embedding")), ",").alias("failed"))

    return {"e5_static_checks": checks, "x4_static_registry": checks, "x3_predicates": predicates}
