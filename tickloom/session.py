"""Session helpers: UTC clock, shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session fit for this library: UTC clock, and the package importable in Python workers.

    All epochs are UTC seconds, so the session clock must be UTC too.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; grouped folds import it there.

    The streaming runner on the driver starts its own worker, which reads only the Python path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    paths = [str(root.parent), sc.environment.get("PYTHONPATH", "")]
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    archive = pathlib.Path(tempfile.mkdtemp(prefix="tickloom-pkg-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; fall back to a temp folder only if unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


_handed_out: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder; ``sweep`` deletes what is written there."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete what this application has written in scratch paths (settled tables, archives, logs, stream folders), once the results built on them are written; how many there were."""
    paths = _handed_out.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Two-level scans read their input twice (totals, then rows); settling a derived input keeps that at
    two cheap, column-pruned reads instead of two evaluations. Unlike ``checkpoint`` the plan runs
    once, sizes are known to the planner afterwards, and the copy survives lost executors.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
