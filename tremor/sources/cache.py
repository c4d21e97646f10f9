"""Analyses kept from run to run: one table with a section, path, content hash, version and payload a row.

A cache that can't be read counts as empty. It is replaced as a whole: written beside its place, then renamed.
"""

from __future__ import annotations

import json
import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import changes, scope

# --- fixed values: sections of a cache ---
SECTIONS = ("py", "templates", "frontend")
CACHE = "section string, path string, hash string, v int, payload string"


def load(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """Rows of a cache table, of one section if it is named."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
        found.limit(1).collect()
    except PySparkException:
        found = spark.createDataFrame([], CACHE)
    return found if section is None else found.filter(F.col("section") == section)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a cache that was kept as one JSON file: sections of paths, or, in the older form, paths alone, which are Python's."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    if not any(s in data for s in SECTIONS):
        data = {"py": data}
    rows = []
    for s in SECTIONS:
        for p, entry in (data[s] if isinstance(data.get(s), dict) else {}).items():
            e = entry if isinstance(entry, dict) else {}
            v = (e.get("analysis") or {}).get("v") if isinstance(e.get("analysis"), dict) else None
            rows.append((s, p, e.get("hash"), v, json.dumps(entry, sort_keys=True)))
    return spark.createDataFrame(rows, CACHE)


def save(rows: DataFrame, path: str) -> bool:
    """Replaces the cache at path; whether that worked. A failure leaves the old cache as it is."""
    spark = rows.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path
    names = [c.split()[0] for c in CACHE.split(", ")]
    beside = f"{path}.{os.getpid()}"
    try:
        rows.select(*names).write.mode("overwrite").parquet(beside)
        fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(to(path), True)
        return bool(fs.rename(to(beside), to(path)))
    except (PySparkException, OSError):
        return False


def refreshed(cache: DataFrame, section: str, files: DataFrame, analyse, version: int) -> DataFrame:
    """The cache after a run: rows of paths that are there (path, hash) and unchanged, and new ones from analyse(stale files) (path, payload)."""
    own = scope.pruned_cache(cache.filter(F.col("section") == section), files)
    fresh = own.filter(F.col("v") == version).join(files.select("path", "hash"), ["path", "hash"], "left_semi")
    new = analyse(changes.stale(files, own, version)).join(files.select("path", "hash"), "path").select(F.lit(section).alias("section"), "path", "hash", F.lit(version).alias("v"), "payload")
    names = [c.split()[0] for c in CACHE.split(", ")]
    return cache.filter(F.col("section") != section).select(*names).unionByName(fresh.select(*names)).unionByName(new)
