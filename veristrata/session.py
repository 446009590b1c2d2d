"""Session settings and the few cluster conventions every module shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("veristrata")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine where it is unset in local mode, as in tests.

    A running session does not take a new value for that setting, so this process remembers its own folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="veristrata-"))
    return _own_folder[0]


#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared folder: compressed, and read by column.

    The shuffle files of the write go when it ends. The session removes its tables when the interpreter ends, or release() before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that cut() returned; nothing may read them any more."""
    for out in tables:
        _remove(out.sparkSession, out.cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
