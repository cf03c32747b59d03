"""A vector index that readers always see whole: versions written aside, checked, and made current by a manifest.

``path`` holds a folder for each version and ``manifests`` with one numbered file for each that was ever made current; the highest number counts. A manifest is
written under another name and renamed, which is one step, so a rebuild that fails or is still running changes nothing for readers, and of two rebuilds at
once one fails. The version before the current one stays for readers that have begun with it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.store import delete, file_system

KEPT = 2


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(number, manifest), the newest first."""
    files, folder = file_system(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = sorted((int(n) for n in names if n.isdigit()), reverse=True)[: KEPT + 1]
    rows = spark.read.text([f"{path}/manifests/{n:010d}" for n in numbers], wholetext=True).select("value", F.input_file_name().alias("f")).collect() if numbers else []
    return sorted(((int(r.f.rsplit("/", 1)[1]), json.loads(r.value)) for r in rows), key=lambda x: -x[0])


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    jvm = spark.sparkContext._jvm
    files, target = file_system(spark, f"{path}/manifests/{number:010d}")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/_{uuid.uuid4().hex}")
    out = files.create(aside)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        raise RuntimeError(f"another rebuild of {path} was faster")


def rebuild(chunks: DataFrame, path: str, model: str, prefix: str, metric: str = "cosine", vector: str = "embedding") -> dict:
    """Write ``chunks`` as a new version and make it current; raises, and leaves the old one current, if a vector is missing, of another length or without a finite norm."""
    spark = chunks.sparkSession
    before = _manifests(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{path}/{version}")
    size, norm = F.size(vector), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bad = F.col(vector).isNull() | F.isnan(norm) | norm.isNull() | (norm == float("inf"))
    seen = spark.read.parquet(f"{path}/{version}").agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if seen.bad or seen.least != seen.most:
        delete(spark, f"{path}/{version}")
        raise ValueError(f"{seen.bad} vectors without a norm, lengths {seen.least} to {seen.most}: the index stays as it was")
    manifest = {"version": version, "model": model, "prefix": prefix, "metric": metric, "rows": seen.rows, "dimensions": seen.least}
    _publish(spark, path, before[0][0] + 1 if before else 1, manifest)
    for _, old in before[KEPT - 1 :]:
        delete(spark, f"{path}/{old['version']}")
    return manifest


def current(spark: SparkSession, path: str) -> tuple[dict, DataFrame] | None:
    """(manifest, vectors) of the current version; None where no version was ever made current."""
    found = _manifests(spark, path)
    return (found[0][1], spark.read.parquet(f"{path}/{found[0][1]['version']}")) if found else None
