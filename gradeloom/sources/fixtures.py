"""Queries over the sources: a landing folder of sample uploads, generated inputs, the synthetic cohort."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.runtime import run_folder
from gradeloom.sources.archives import uploads
from gradeloom.sources.generators import KINDS, cohort, inputs


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


#: Sample uploads: kept with a report, latin-1, path traversal, a bomb, a single text file, a broken archive.
UPLOADS = {
    "good.zip": _zip({"main.py": b"x = 1\r\n", "report.md": b"why"}),
    "latin.zip": _zip({"a.txt": b"\xe9", "b.exe": b"no"}),
    "evil.zip": _zip({"../x.py": b"1"}),
    "bomb.zip": _zip({"x.py": b"0" * (1 << 21)}),
    "single.py": b"print(1)",
    "broken.zip": b"PKbroken",
}


def landed(spark: SparkSession, files: dict[str, bytes]) -> str:
    """The files in a new landing folder on the shared file system, through its Hadoop interface."""
    folder, jvm = run_folder(spark, "landing"), spark.sparkContext._jvm
    for name, data in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
    return folder


def sampled_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, landed(spark, UPLOADS))


def sampled_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated input per kind and event type of the table."""
    kinds = spark.createDataFrame([(k, json.dumps({"kind": k, "value": 1})) for k in KINDS], "kind string, spec string")
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    tests = kinds.join(F.broadcast(types), how="cross").withColumn("parts", F.array("event_type", "kind"))
    return inputs(tests).select("event_type", "kind", "input")


def queries() -> dict:
    return {
        "src5_archives": sampled_uploads,
        "src6_uploads": sampled_uploads,
        "src8_cohort": lambda spark, d: cohort(spark),
        "src9_generated_inputs": sampled_inputs,
        "x5_generator_registry": sampled_inputs,
    }
