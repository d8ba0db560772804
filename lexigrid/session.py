"""Session helpers: configuration defaults, table loading and shared intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "lexigrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULT_CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; `sf_dir` may be any URI that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many tasks as there are cores: a file that is cut
    into fewer parts would leave the others idle in work that costs much a row. Large inputs
    have more parts than that and are returned as they are. `scan` holds no shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and the session is a single local JVM (tests) a
    temporary folder is used and recorded as the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/lexigrid/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all that `materialize` has written for this application. DataFrames that read
    it, which includes results that are not stored yet, cannot be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs a re-read of the files, not the work
    behind them. Files stay until `release`.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package where their Python path does not hold it already
    (a cluster install or PYTHONPATH); done once for a session's context."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or os.getcwd() == root or getattr(context, "_lexigrid_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lexigrid-"), "lexigrid.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "lexigrid")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._lexigrid_shipped = True
