"""Rules for uploaded paths and texts, as patterns that Spark's columns and the archive reader share."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Levels of a path, endings of files that are kept, names that need no ending, names of the report.
DEPTH = 8
EXTENSIONS = ("py", "c", "h", "cpp", "cc", "hpp", "java", "js", "ts", "go", "rs", "txt", "md", "json", "yaml", "yml", "toml", "cfg", "ini", "csv", "makefile", "mk", "sql", "sh")
REPORT = r"(?i)(report|readme|writeup|analysis)\.(md|txt)$"

#: Steps that go nowhere: '.' and empty ones.
IDLE = r"/(?:\.?/)*\.?$|(?:^|(?<=/))(?:\.?/)+|(?:^|(?<=/))\.$"
#: A file is kept for its ending, for its name, or for having no dot anywhere.
KEPT = r"(?i)\.(?:" + "|".join(EXTENSIONS) + r")$|(?:makefile|dockerfile)$|^[^.]*$"
#: The end of a text, in both engines' patterns.
_END = r"(?![\s\S])"
#: Changes to a text, in order: line ends, blanks before them, empty lines at the end, one line feed there.
NORMAL = ((r"\r\n?", "\n"), (rf"[^\S\n]+(?=\n|{_END})", ""), (rf"\n+{_END}", ""), (rf"(?<=[^\n]){_END}", "\n"))


#: Why a path with forward slashes is refused, and the pattern that shows it.
FAULTS = (("absolute path", r"^(?:/|[A-Za-z]:)"), ("path traversal", r"(?:^|/)\.\.(?:/|$)"))


def _deep(depth: int) -> tuple[str, str]:
    """The same for a path without idle steps that has more levels."""
    return f"nested deeper than {depth}", rf"^(?:[^/]+/){{{depth}}}"


def fault(path: str, depth: int = DEPTH) -> str | None:
    """The first rule that refuses a path with forward slashes."""
    why, deep = _deep(depth)
    return next((name for name, pattern in FAULTS if re.search(pattern, path)), why if re.search(deep, re.sub(IDLE, "", path)) else None)


def path_fault(path: Column, depth: int = DEPTH) -> Column:
    """As `fault`, of any slashes; null for a path that is safe or null."""
    why, deep = _deep(depth)
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(*[F.when(slashed.rlike(pattern), F.lit(name)) for name, pattern in FAULTS], F.when(plain_path(path).rlike(deep), F.lit(why)))


def plain_path(path: Column) -> Column:
    """The path with forward slashes and without idle steps."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), IDLE, "")


def normal_text(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, one line feed at the end; a text of blanks is empty."""
    for pattern, by in NORMAL:
        text = F.regexp_replace(text, pattern, by)
    return text


def content_hash(path: Column, text: Column) -> Column:
    """An aggregate: one hash of a bundle's paths and texts, whatever their order and line ends."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path.alias("p"), normal_text(text).alias("t")))), lambda x: F.concat(x.p, F.lit("\0"), x.t)), "\0"), 256)


def f2_path_safety(spark, sf_dir: str):
    """Every page's address without its host: the rule that refuses it as a path, or its plain form."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    bad = path_fault(path)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", bad.alias("fault"), F.when(bad.isNull(), plain_path(path)).alias("path"))


def f3_extensions(spark, sf_dir: str):
    """Every page's host name as a file name: its ending and whether files of it are kept."""
    name = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), name.rlike(KEPT).alias("kept"))


#: Documents of a bundle.
BUNDLE = 20


def f4_content_hash(spark, sf_dir: str):
    """One hash for each bundle of documents, their paths being language and id."""
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("bundle", F.floor(F.col("doc_id") / BUNDLE))
    return docs.groupBy("bundle").agg(content_hash(path, F.coalesce("text", F.lit(""))).alias("content_hash"), F.count(F.lit(1)).alias("files"))


def queries() -> dict:
    return {f.__name__: f for f in (f2_path_safety, f3_extensions, f4_content_hash)}


def oracle_sql() -> dict[str, str]:
    """The same rules over lists of steps and lines."""
    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    endings = ", ".join(f"'.{e}'" for e in EXTENSIONS)
    return {
        "f2_path_safety": f"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS steps FROM p),
f AS (SELECT *, CASE WHEN path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') THEN 'absolute path' WHEN list_contains(steps, '..') THEN 'path traversal' WHEN len(steps) > {DEPTH} THEN 'nested deeper than {DEPTH}' END AS fault FROM s)
SELECT page_id, fault, CASE WHEN fault IS NULL THEN array_to_string(steps, '/') END AS path FROM f""",
        "f3_extensions": f"""WITH n AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS name FROM pages), e AS (SELECT page_id, name, CASE WHEN contains(name, '.') THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END AS ext FROM n)
SELECT page_id, ext, ext IN ('', {endings}) OR lower(name) LIKE '%makefile' OR lower(name) LIKE '%dockerfile' AS kept FROM e""",
        "f4_content_hash": f"""WITH l AS (SELECT doc_id, lang || '/' || doc_id || '.txt' AS p, list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: rtrim(x, {blanks})) AS ls FROM documents),
t AS (SELECT doc_id, p, rtrim(array_to_string(ls, chr(10)), chr(10)) AS t FROM l)
SELECT doc_id // {BUNDLE} AS bundle, sha256(string_agg(p || chr(0) || t || CASE WHEN t = '' THEN '' ELSE chr(10) END, chr(0) ORDER BY p)) AS content_hash, count(*) AS files FROM t GROUP BY doc_id // {BUNDLE}""",
    }
