"""Program sources: normalised tokens, tree profiles, dead code, diffs, repair and named algorithms.

Each function reads one source; the column forms at the end run them in Arrow batches.
"""

from __future__ import annotations

import ast
import difflib
import io
import keyword
import re
import tokenize
from collections import Counter
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.operators.grouped import code_graph
from gradeloom.runtime import ship

# Names kept by the normalisation beside the language's keywords.
KEPT = frozenset(
    "len range print int str float list dict set tuple sorted sum min max abs enumerate zip map filter any all reversed round pow divmod isinstance type open".split()
) | frozenset(keyword.kwlist) | {"match", "case"}
#: Token types that say nothing of the program.
LAYOUT = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
_LEXEME = re.compile(r"(?P<str>\"[^\"\n]*\"|'[^'\n]*')|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>[^\s\w])")


def _kinds(source: str):
    """(kind, text) of each token; a source that does not tokenize is scanned by pattern, comments left out."""
    try:
        found = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, SyntaxError):
        for line in source.splitlines():
            for m in _LEXEME.finditer(line.split("#", 1)[0]):
                yield m.lastgroup, m[0]
        return
    kind = {tokenize.NAME: "name", tokenize.NUMBER: "num", tokenize.STRING: "str", tokenize.OP: "op"}
    yield from ((kind[t.type], t.string) for t in found if t.type not in LAYOUT and t.type in kind)


def normalised_tokens(source: str) -> list[str]:
    """Tokens without identity: names by order of first use, numbers NUM, strings STR; layout and comments vanish."""
    place: dict[str, str] = {}
    fixed = {"num": "NUM", "str": "STR"}
    return [fixed.get(kind) or (place.setdefault(t, f"v{len(place)}") if kind == "name" and t not in KEPT else t) for kind, t in _kinds(source)]


def tree_profile(source: str, p: int = 2, q: int = 3) -> list[str] | None:
    """The distinct pq-grams of the syntax tree, sorted; None where it does not parse.

    The stem is a node with its nearest ancestors (at most p), the base q neighbouring children with blanks around them.
    """
    try:
        todo = [(ast.parse(source), ())]
    except (SyntaxError, ValueError):
        return None
    grams = set()
    while todo:
        node, above = todo.pop()
        stem = (*above, type(node).__name__)[-p:]
        below = list(ast.iter_child_nodes(node))
        row = ["*"] * (q - 1) + [type(c).__name__ for c in below] + ["*"] * (q - 1) if below else ["*"] * q
        grams.update("/".join((*stem, *base)) for base in zip(*(row[i:] for i in range(q)), strict=False))
        todo += [(c, stem) for c in below]
    return sorted(grams)


def live_source(source: str, roots: tuple[str, ...] = ("solve", "main")) -> str:
    """The source without top-level functions that nothing reaches, and without statements after a return."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return source
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    calls = lambda n: {f.id if isinstance(f, ast.Name) else f.attr for c in ast.walk(n) if isinstance(c, ast.Call) for f in [c.func] if isinstance(f, (ast.Name, ast.Attribute))}
    own = {n.name: n for n in tree.body if isinstance(n, kinds)}
    if not own:
        return source
    live: set[str] = set()
    wave = ({n for n in own if n in roots} | (calls(tree) & own.keys())) or set(own)
    while wave:
        live |= wave
        wave = {c for n in wave for c in calls(own[n]) & own.keys()} - live
    tree.body = [n for n in tree.body if not isinstance(n, kinds) or n.name in live]
    for n in tree.body:
        if isinstance(n, kinds):
            ends = [i for i, s in enumerate(n.body) if isinstance(s, ast.Return)]
            n.body = n.body[: ends[0] + 1] if ends else n.body
    return ast.unparse(tree)


def unified_diff(expected: str, actual: str, most: int = 40) -> str:
    """The first lines of the unified diff."""
    return "\n".join(islice(difflib.unified_diff(expected.splitlines(), actual.splitlines(), "expected", "actual", lineterm=""), most))


def _fault(source: str) -> SyntaxError | None:
    try:
        ast.parse(source)
    except SyntaxError as e:
        return e
    except ValueError as e:
        return SyntaxError(str(e))


def _one_letter_off(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _edits(lines: list[str], at: int, names: set[str]):
    """(kind, line, new text) of single-line changes at the reported line and those beside it."""
    for i in (at, at - 1, at + 1):
        if not 0 <= i < len(lines) or not lines[i].strip():
            continue
        line = lines[i]
        text = line.strip()
        lead = line[: len(line) - len(line.lstrip())]
        if re.match(r"(def|class|if|elif|else|for|while|try|except|finally|with)\b", text) and not text.endswith(":"):
            yield "insert_colon", i, line.rstrip() + ":"
        for left, right in ("()", "[]", "{}"):
            gap = line.count(left) - line.count(right)
            if gap > 0:
                stop = line.rstrip()
                yield "close_delimiter", i, stop[:-1] + right * gap + ":" if stop.endswith(":") else stop + right * gap
            elif gap < 0:
                cut = line.rindex(right)
                yield "delete_delimiter", i, line[:cut] + line[cut + 1 :]
        for mark in "\"'":
            if line.count(mark) % 2:
                yield "close_string", i, line.rstrip() + mark
                if line.rstrip().endswith(")"):
                    yield "close_string", i, line.rstrip()[:-1] + mark + ")"
        if re.match(r"(if|elif|while)\b", text):
            yield "fix_comparison", i, re.sub(r"(?<![=!<>])=(?!=)", "==", line, count=1)
        if text.endswith(";"):
            yield "drop_semicolon", i, line.rstrip().rstrip(";")
        for word in sorted(set(re.findall(r"[A-Za-z_]\w*", text)) - names):
            near = sorted(n for n in names if _one_letter_off(word, n))
            if len(near) == 1:
                yield "fix_typo", i, re.sub(rf"\b{word}\b", near[0], line, count=1)
        if i and lines[i - 1].rstrip().endswith(":"):
            before = lines[i - 1]
            yield "fix_indent", i, before[: len(before) - len(before.lstrip())] + "    " + text
        elif i and lead != (base := lines[i - 1][: len(lines[i - 1]) - len(lines[i - 1].lstrip())]):
            yield "fix_indent", i, base + text


def repaired(source: str, most_edits: int = 3, most_tried: int = 400, beam: int = 24) -> tuple[str | None, list[str]]:
    """The nearest source that parses and the edits to it, searched by number of edits; (None, []) past the bounds."""
    names = set(re.findall(r"\bdef\s+(\w+)", source)) | KEPT | {"self"}
    wave, seen, tried = [(source, [])], {source}, 0
    if _fault(source) is None:
        return source, []
    for _ in range(most_edits):
        later = []
        for text, done in wave:
            lines = text.splitlines()
            fault = _fault(text)
            for kind, i, new in _edits(lines, max(0, (fault.lineno or 1) - 1), names):
                tried += 1
                if tried > most_tried:
                    return None, []
                changed = "\n".join([*lines[:i], new, *lines[i + 1 :]])
                if changed in seen:
                    continue
                seen.add(changed)
                trail = [*done, f"{kind}:{i + 1}"]
                if _fault(changed) is None:
                    return changed, trail
                later.append((changed, trail))
        wave = later[:beam]
    return None, []


# What each named algorithm asks of a source, and the words that are evidence of its name.
DEMANDS = """
binary_search           requires_loop_or_recursion 1
binary_search           min_branches               2
divide_and_conquer_sort requires_recursion         1
divide_and_conquer_sort min_branches               1
quadratic_sort          min_loop_depth             2
linear_scan             min_loop_depth             1
linear_scan             max_loop_depth             1
dynamic_programming     min_loop_depth             1
recursive_traversal     requires_recursion         1
"""
WORDS = """
binary_search           // mid lo hi left right
divide_and_conquer_sort merge sort mid half
quadratic_sort          swap temp range
hash_lookup             dict {} set( in_
dynamic_programming     dp memo cache table
recursive_traversal     left right node child
"""
LEAST_CONFIDENCE, MOST_MATCHES = 0.6, 3


def named(source: Column, loop_depth: Column, branches: Column, recursive: Column) -> Column:
    """The named algorithms of a source with their confidence, the surest first.

    A demand is met or not; of an algorithm's words half are enough. Their mean is the confidence, and no name is given
    without one of its words, where it has any.
    """
    demand = {
        "min_branches": lambda n: branches >= n, "min_loop_depth": lambda n: loop_depth >= n, "max_loop_depth": lambda n: loop_depth <= n,
        "requires_recursion": lambda n: recursive, "requires_loop_or_recursion": lambda n: recursive | (loop_depth >= 1),
    }
    low, total = F.lower(source), lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    rules: dict[str, tuple[list[Column], list[Column]]] = {}
    for name, kind, bound in map(str.split, DEMANDS.strip().splitlines()):
        rules.setdefault(name, ([], []))[0].append(demand[kind](int(bound)))
    for name, *words in map(str.split, WORDS.strip().splitlines()):
        rules.setdefault(name, ([], []))[1].extend(low.rlike(rf"\b{w}\b") if w.isalpha() else F.contains(low, F.lit(w.replace("_", " "))) for w in words)
    found = []
    for name, (asked, words) in rules.items():
        share = F.least(F.lit(1.0), total(words) / max(1.0, len(words) / 2)) if words else F.lit(0.0)
        sure = (total(asked) + share) / (len(asked) + bool(words))
        found.append(F.when((sure >= LEAST_CONFIDENCE) & (total(words) > 0 if words else F.lit(True)), F.struct((-F.round(sure, 3)).alias("c"), F.lit(name).alias("a"))))
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, MOST_MATCHES), lambda x: F.struct(x.a.alias("algorithm"), (-x.c).alias("confidence")))


def algorithms(facts: DataFrame, text: str = "source") -> DataFrame:
    """id and found, the named algorithms of each source; facts has id, the source and its code facts."""
    return facts.select("id", named(*(F.col(c) for c in (text, "loop_depth", "branches", "recursive"))).alias("found"))


def shape(source: str) -> dict[str, float]:
    """Counts of control-flow nodes, calls and literal kinds; of a broken source, of the keywords that a scan recovers."""
    kinds = {"For": "loops", "While": "loops", "If": "branches", "IfExp": "branches", "Return": "returns", "FunctionDef": "functions", "AsyncFunctionDef": "functions", "Call": "calls", "Try": "guards", "Dict": "dicts", "List": "lists", "Set": "sets", "arg": "params"}
    try:
        names = [type(n).__name__ for n in ast.walk(ast.parse(source))]
    except (SyntaxError, ValueError):
        words = {"for": "For", "while": "While", "if": "If", "elif": "If", "return": "Return", "def": "FunctionDef", "try": "Try"}
        names = [words[t] for _, t in _kinds(source) if t in words]
    return {k: float(v) for k, v in sorted(Counter(kinds[n] for n in names if n in kinds).items())}


def column(function, kind: str, *names: str) -> Column:
    """The function of one row's texts as a batched column; null texts are empty."""

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([function(*(x or "" for x in r)) for r in zip(*(rows[c] for c in rows.columns), strict=True)], dtype=object)

    return run(F.struct(*names))


def jaccard(a: str, b: str) -> Column:
    """Similarity of two array columns as sets; null or empty: 0."""
    both = F.size(F.array_union(a, b))
    return F.coalesce(F.when(both > 0, F.size(F.array_intersect(a, b)) / both), F.lit(0.0))


# Fixed sample: a correct search, its renamed copy, an unbuildable one, another algorithm, nothing, dead code.
SAMPLE = [
    "def solve(xs, t):\n    lo, hi = 0, len(xs) - 1\n    while lo <= hi:\n        mid = (lo + hi) // 2\n        if xs[mid] == t:\n            return mid\n        if xs[mid] < t:\n            lo = mid + 1\n        else:\n            hi = mid - 1\n    return -1\n",
    "def solve(seq, key):\n    left, right = 0, len(seq) - 1\n    while left <= right:\n        mid = (left + right) // 2\n        if seq[mid] == key:\n            return mid\n        if seq[mid] < key:\n            left = mid + 1\n        else:\n            right = mid - 1\n    return -1\n",
    "def solve(xs, t)\n    for i in range(len(xs)):\n        if xs[i] == t:\n            return i\n    return -1\n",
    "def solve(xs):\n    return sorted(xs, key=lambda x: -x)\n",
    "",
    "def pad(x):\n    return x\n\ndef solve(x):\n    return helper(x)\n    x = 1\n\ndef helper(x):\n    return x + 1\n",
]


def sample(spark: SparkSession) -> DataFrame:
    ship(spark)
    return spark.createDataFrame(list(enumerate(SAMPLE)), "id int, source string").withColumn("reference", F.lit(SAMPLE[0]))


def queries() -> dict:
    texts = "array<string>"
    one = lambda name, f, kind: lambda spark, d: sample(spark).select("id", column(f, kind, "source").alias(name))
    similar = lambda spark, d: sample(spark).select("id", column(tree_profile, texts, "source").alias("a"), column(tree_profile, texts, "reference").alias("b")).select("id", F.round(jaccard("a", "b"), 6).alias("similarity"))
    return {
        "f9_lexical_tokens": lambda spark, d: sample(spark).filter("id = 2").select("id", column(normalised_tokens, texts, "source").alias("tokens")),
        "f10_exact_tokens": one("tokens", normalised_tokens, texts),
        "f13_unified_diff": lambda spark, d: sample(spark).select("id", column(unified_diff, "string", "reference", "source").alias("diff")),
        "f18_recovered_shape": one("shape", shape, "map<string,double>"),
        "g11_live_source": one("live", live_source, "string"),
        "i2_structural_vector": one("shape", shape, "map<string,double>"),
        "e15_function_facts": one("shape", shape, "map<string,double>"),
        "e2_tree_similarity": similar,
        "e3_algorithms": lambda spark, d: algorithms(code_graph(sample(spark).select("id", "source"))),
        "e6_repair": one("edits", lambda s: repaired(s)[1], texts),
    }
