"""Session-level helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions resolve by import."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tremor-ship-")
    archive = os.path.join(folder, "tremor_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("tremor", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tremor-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    at = f"{shared_dir(spark)}/tremor-{app}"
    if at not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS.add(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the written table replaces the shuffle files that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def fixed(df: DataFrame) -> DataFrame:
    """df with rows that have the same numbers in every scan: rows of files as they are, any other result written first."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.child()
    return df if node.nodeName() in ("LogicalRelation", "LocalRelation") or node.nodeName().startswith(("Relation", "DataSourceV2")) else stored(df, "rows")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table, marked for broadcast if it has no more rows than these; a join with it does not then gather the rows of a frequent key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
