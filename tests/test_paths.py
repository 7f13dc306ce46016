"""Path and text rules: the patterns in Python and in columns against the rules by steps and lines."""

import re

from pyspark.sql import functions as F

from gradeloom.functions import paths as P

PATHS = ["a/b.py", "/etc/x", "../x", "C:/x", "a/../b", "a/./b//c", "./a", ".", "", "a/", "a/.", "..a/b..", "a/..", "a/./", "a//", "./.", "/".join("abcdefgh"), "/".join("abcdefghi"), "a/./b/./c/./d/./e/./f/./g/./h", "a\\..\\b", "x:y", "\\root"]
TEXTS = ["", "x", "x\n", "x \t\n\n\n", "a\r\nb\rc", "  \n \n", "a\n\n b  \n", "\n\na", "a\x0b\nb\f"]


def expected(path):
    path = path.replace("\\", "/")
    steps = [x for x in path.split("/") if x not in ("", ".")]
    return "absolute path" if path[:1] == "/" or re.match("[A-Za-z]:", path) else "path traversal" if ".." in steps else "nested deeper than 8" if len(steps) > 8 else None, "/".join(steps)


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", P.path_fault(F.col("p")).alias("f"), P.plain_path(F.col("p")).alias("q")).collect()
    for r in rows:
        why, plain = expected(r.p)
        assert (r.f, P.fault(r.p.replace("\\", "/"))) == (why, why), r.p
        assert why == "absolute path" or r.q == plain, r.p


def test_endings():
    kept = {"a.py": True, "a.PY": True, "Makefile": True, "x/GNUmakefile": True, "a.exe": False, "a.py.exe": False, "noext": True, "a.b/c": False, ".gitignore": False, "dockerfile": True, "x.mk": True}
    assert {k: bool(re.search(P.KEPT, k)) for k in kept} == kept


def test_texts(spark):
    def lines(t):
        body = "\n".join(x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")).rstrip("\n")
        return body + "\n" if body else ""

    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", P.normal_text(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: lines(t) for t in TEXTS}
