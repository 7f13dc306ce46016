"""Keyed tables in versions: an upsert rewrites the buckets whose rows changed and commits by one new manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

VERSION, BUCKET = "version", "bucket_"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class KeyedTable:
    """Rows with one row for each key, in a folder that all executors share.

    Rows lie in `buckets` hash buckets of their key. A version's manifest names the folder of each bucket, so a write makes
    new folders for the buckets it changes and leaves the others; readers see the last manifest, which appears at once,
    and so a lost executor or a killed write leaves the version before it. Each row carries the version that last changed it.
    The driver holds a manifest, which is as long as there are buckets.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The last version; 0 before the first write."""
        fs, at = self._fs(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"schema": None, "buckets": {}}
        fs, at = self._fs(f"{self.path}/manifests/{version}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        """The manifest appears under its name at once, or not at all if that version is there."""
        fs, draft = self._fs(f"{self.path}/drafts/{version}-{id(manifest):x}.json")
        _, at = self._fs(f"{self.path}/manifests/{version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(draft, at):
            raise Conflict(f"version {version} of {self.path} was committed by another writer")

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame | None:
        """The rows of a version, the last one by default; None before the first write."""
        manifest = self._manifest(self.version() if version is None else version)
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [p for b, p in manifest["buckets"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int, kept: dict, touched: list[str]) -> int:
        """Buckets `touched` become those of rows; a bucket without rows goes."""
        at, schema = f"data/{version}", rows.schema
        self._bucketed(rows).repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{self.path}/{at}")
        fs, root = self._fs(f"{self.path}/{at}")
        made = {n.split("=")[1] for f in fs.listStatus(root) if (n := f.getPath().getName()).startswith(f"{BUCKET}=")}
        buckets = {b: p for b, p in kept.items() if b not in touched} | {b: f"{at}/{BUCKET}={b}" for b in made}
        self._commit(version, {"schema": json.loads(schema.json()), "buckets": buckets})
        return version

    def _single(self, changes: DataFrame) -> DataFrame:
        """One row a key: of several the one that is last in the order of its other columns."""
        others = [c for c in changes.columns if c not in self.keys]
        if not others:
            return changes.distinct()
        last = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in others])
        return changes.withColumn("nth_", F.row_number().over(last)).filter("nth_ = 1").drop("nth_")

    def upsert(self, changes: DataFrame) -> int:
        """Insert rows with new keys, replace those whose other columns differ, leave all others and their version; the version now.

        Null keys are keys like any other. Repeated keys in `changes`: see `_single`. Where nothing differs no version is made.
        """
        before = self.version()
        manifest, version = self._manifest(before), before + 1
        changes = self._single(changes)
        if manifest["schema"] is None:
            return self._write(changes.withColumn(VERSION, F.lit(version).cast("long")), version, {}, [])
        have = self.read(before)
        if {*changes.columns} != {*have.columns} - {VERSION}:
            raise ValueError(f"the table has the columns {have.columns}")
        changes = changes.select(*[F.col(c).cast(have.schema[c].dataType) for c in have.columns if c != VERSION])
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in a.columns if k in b.columns and k != VERSION]
        news = self._bucketed(changes.join(have, same(changes, have), "left_anti"))
        touched = [str(r[0]) for r in news.select(BUCKET).distinct().collect()]
        if not touched:
            return before
        news = news.drop(BUCKET).withColumn(VERSION, F.lit(version).cast("long"))
        old = self.read(before, touched)
        stay = old.join(news, [old[k].eqNullSafe(news[k]) for k in self.keys], "left_anti")
        return self._write(stay.unionByName(news), version, manifest["buckets"], touched)

    def delete(self, gone: DataFrame) -> int:
        """Rows whose columns equal those of a row of `gone` (some of the key's columns or others) go; the version now."""
        before = self.version()
        have = self.read(before)
        if have is None:
            return before
        hit = [have[c].eqNullSafe(gone[c]) for c in gone.columns]
        touched = [str(r[0]) for r in self._bucketed(have.join(gone, hit, "left_semi")).select(BUCKET).distinct().collect()]
        if not touched:
            return before
        old = self.read(before, touched)
        return self._write(old.join(gone, [old[c].eqNullSafe(gone[c]) for c in gone.columns], "left_anti"), before + 1, self._manifest(before)["buckets"], touched)

    def rebuild(self, rows: DataFrame, carried: list[str]) -> int:
        """All rows are replaced; the columns `carried` come from the row with the same key before, null where there was none."""
        before = self.version()
        rows, have = self._single(rows), self.read(before)
        if have is None:
            full = rows.withColumns({c: F.lit(None).cast("string") for c in carried})
        else:
            old = have.select(*[F.col(c).alias(f"old_{c}") for c in [*self.keys, *carried]])
            full = rows.join(old, [rows[k].eqNullSafe(old[f"old_{k}"]) for k in self.keys], "left").select(*rows.columns, *[F.col(f"old_{c}").alias(c) for c in carried])
        return self._write(full.withColumn(VERSION, F.lit(before + 1).cast("long")), before + 1, {}, [])
