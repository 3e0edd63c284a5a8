"""Shared storage, materialised intermediate tables and worker set-up."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only in local mode, where driver and executors are one
    process, may that be unset: then a temporary folder, which goes when the process ends, stands in for it. Elsewhere a
    ValueError is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub("^file:/+", "file:///", full).rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="lexiquarry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexiquarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, settle: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage.

    The committed files outlive lost executors; a failed task attempt leaves nothing behind.
    With ``settle``, Spark may drop the shuffle files of the job at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if settle:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiquarry_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that have ended: it does so once the driver's collector has found them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lexiquarry_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster it is shipped with --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    # threads of the Tokenizers library: the cores of a task's neighbours are taken
    env.setdefault("RAYON_NUM_THREADS", "2")
    # one arena, and large arrays go back to the system as soon as they are freed
    env |= {"OMP_NUM_THREADS": "1", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
