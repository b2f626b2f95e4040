"""Session defaults, table access and the few physical-layout helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quireflow", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUIREFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; a scan, so column pruning and pushdown apply."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """Give a Python stage at least ``per_core`` tasks for each core.

    A large table already arrives in many splits and is left alone; only an input of fewer splits than
    that is redistributed, which costs one shuffle of a table that is small by that very test.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where it is unset a local session gets a temporary
    folder, as in tests; a cluster is refused, as its executors would each write to a disk of their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quireflow-checkpoint-")
        spark.sparkContext.setCheckpointDir(shared)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared checkpoint folder and read it back: lineage ends there, the
    table survives the loss of executors, and later reads prune its columns. Removed when the application ends."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    path = f"{base}/quireflow-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if spark.sparkContext.applicationId not in _CLEANED:
        _CLEANED.add(spark.sparkContext.applicationId)
        atexit.register(_remove, spark, f"{base}/quireflow-{spark.sparkContext.applicationId}")
    return spark.read.schema(df.schema).parquet(path)


_CLEANED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: a context that is already gone leaves its folder to the cluster's own cleaning."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    home = Path(tempfile.mkdtemp(dir=sc._temp_dir))
    shutil.copytree(root, home / "stage" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(home / "quireflow_pkg"), "zip", home / "stage"))
    _SHIPPED.add(sc.applicationId)
