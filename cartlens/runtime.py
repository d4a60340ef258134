"""Session settings and the shared checkpoint folder.

``build_session`` is for tests, benchmarks and local runs; on a cluster the
caller's own session is used and only ``checkpoint_dir`` is consulted.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "cartlens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for the operators in this package.

    AQE is on so that shuffle partitions are coalesced and skewed join
    partitions are split at run time; broadcast joins are left to Spark's
    size check (``autoBroadcastJoinThreshold`` on runtime statistics).
    """
    master = master or os.environ.get("SPARK_MASTER") or "local[8]"
    cores = _cores(master)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        # iterative jobs checkpoint every round: let Spark delete checkpoint
        # files once nothing refers to them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cores(master: str) -> int:
    if master.startswith("local[") and master[6:-1].isdigit():
        return int(master[6:-1])
    return os.cpu_count() or 8


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint folder).  Only a local-mode session without one gets a fresh
    folder under the system temp directory; a cluster session without a
    shared folder is an error, since executors could not see a local one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="cartlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def checkpoint_in_place(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` that keeps its partitioning and order for later
    plans.  With adaptive execution the layout of a checkpoint is unknown to
    the plans that read it, so this one plan is made without it, in a clone of
    the session: the caller's settings stay as they are, also for queries that
    run at the same time."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    clone = spark._jsparkSession.cloneSession()
    clone.conf().set("spark.sql.adaptive.enabled", "false")
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    written = dataset.ofRows(clone, df._jdf.queryExecution().analyzed()).checkpoint()
    return DataFrame(dataset.ofRows(spark._jsparkSession, written.logicalPlan()), spark)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cartlens-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder of the shared checkpoint folder, and read from there."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _place(spark: SparkSession, path: str):
    """File system and path object of a folder or file in any Hadoop storage."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return bool(fs.exists(place))


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, place = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def file_status(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of change of a file."""
    fs, place = _place(spark, path)
    status = fs.getFileStatus(place)
    return status.getLen(), status.getModificationTime()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text, written over one that is there."""
    fs, place = _place(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def ship_package(spark: SparkSession) -> None:
    """Make ``cartlens`` importable by the Python workers of every executor
    (needed by the Arrow-batched k-NN kernel): the package's sources are
    zipped once per context and added with ``addPyFile``, as
    ``spark-submit --py-files`` would."""
    import zipfile

    import cartlens

    sc = spark.sparkContext
    if getattr(sc, "_cartlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(cartlens.__file__))
    fd, path = tempfile.mkstemp(prefix="cartlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._cartlens_shipped = True
