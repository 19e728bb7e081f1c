"""Session set-up, table access and shared staging used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEST_DIRS: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def build_session(app: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer; every setting can be overridden."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=base)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table, pruned to the named columns when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is missing and the session runs on one machine, as in tests, a temporary folder is
    made and set as the checkpoint folder; on a cluster a missing setting is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.applicationId not in _TEST_DIRS and (chosen := spark.sparkContext.getCheckpointDir()):
        return chosen.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _TEST_DIRS:
        path = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{path}")
        _TEST_DIRS[app] = f"file://{path}"
    return _TEST_DIRS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is None:
            return
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def release() -> None:
    """Remove all staged files; results that still read them must have been used or written before."""
    for spark, path in _STAGED:
        _remove(spark, path)
    _STAGED.clear()


def session_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for something that lasts as long as the driver, such as an index of test tables."""
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    The files are removed by :func:`release`, at the latest when the driver process ends.
    """
    spark = df.sparkSession
    if not _STAGED:
        atexit.register(release)
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted to hold at most ``rows`` rows; otherwise return it unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which operators size their own repartitioning."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), os.cpu_count() or 1 if spark.sparkContext.master.startswith("local[") else 1)
