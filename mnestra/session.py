"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[object, str]] = []
_STAYING: list[tuple[object, str]] = []
_KEPT: dict[tuple[str, str], tuple[SparkSession, DataFrame, str]] = {}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mnestra")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent, as in tests on one machine, a local
    folder is made and kept for the rest of the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("mnestra.local.shared.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="mnestra-")
        spark.conf.set("mnestra.local.shared.dir", configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The files survive the loss of any executor, and the plan that follows starts
    from them.  The schema is kept as it was.  ``clean``: the shuffle files of
    the writing are deleted as it ends, and not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnestra-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if clean:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept(build, name: str, source: DataFrame) -> DataFrame:
    """A table derived from files, such as an index: written once a session for the same files, and read from then on.

    It is named by the files' names, sizes and times, so that a changed table gets another; it stays until the session ends.
    """
    spark = source.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = sorted(source.inputFiles())
    stamp = hashlib.sha256()
    if files:
        system = path(files[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for file in files:
            status = system.getFileStatus(path(file))
            stamp.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    known = (name, stamp.hexdigest())
    if files and known in _KEPT:
        owner, df, written = _KEPT[known]
        if owner is spark and path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(written)):
            return df
    df = materialise(build(), name)
    _STAYING.append(_WRITTEN.pop())
    _KEPT[known] = (spark, df, _STAYING[-1][1])
    return df


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables that ``materialise`` has written."""
    while _WRITTEN:
        owner, path = _WRITTEN.pop()
        try:
            context = owner.sparkContext
            hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:
            continue


@atexit.register
def _release_at_exit() -> None:
    _WRITTEN.extend(_STAYING)
    if _WRITTEN:
        release()


def spread(df: DataFrame) -> DataFrame:
    """Give a Python-heavy step at least as many partitions as there are cores.

    A table of few files would otherwise be worked on by few tasks.  A table whose files
    make enough partitions is returned unchanged, so large inputs are not
    shuffled.  Files are counted, nothing is run.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files:
        return df.repartition(wanted)
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if len(files) >= wanted:
        return df
    largest = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits = sum(-(-system.getFileStatus(path(f)).getLen() // largest) for f in files)
    return df if splits >= wanted else df.repartition(wanted)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a session, so that it need not be installed there.

    Times are UTC throughout, so the session's zone is set to it as well.
    """
    context = spark.sparkContext
    if getattr(context, "_mnestra_shipped", False):
        return
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mnestra-code-"), "mnestra.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.join("mnestra", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._mnestra_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
