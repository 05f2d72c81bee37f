"""Sessions, input tables, checkpoints and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's files once, so that Python workers can import it on any machine."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application: the one that the cluster names in spark.checkpoint.dir.

    Only where neither that setting nor the application names one, and all tasks run in this machine (tests, a laptop), is a
    temporary folder used; on a cluster it is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file with all that it holds, wherever Spark can write."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file, or of the files of a folder; tells whether a table has been written again."""
    at, fs = _path(spark, path)
    found = [f for f in fs.listStatus(at) if f.isFile()]
    return sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


@contextmanager
def scratch(spark: SparkSession, kind: str) -> Iterator[str]:
    """A folder in the shared folder, which goes at the end; what is read from it must have been checkpointed by then."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid4().hex}"
    try:
        at, fs = _path(spark, folder)
        fs.mkdirs(at)
        yield folder
    finally:
        remove(spark, folder)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run meanwhile sends Python workers at most so many rows in an Arrow batch; by default all texts of a split make one,
    which the executor and the worker both hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
