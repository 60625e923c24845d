"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(name: str = "haggle", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive plans, Arrow on."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(filter(None, [root, *os.environ.get("PYTHONPATH", "").split(os.pathsep)])))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data, deleted when the application ends, in the place the cluster names
    in ``spark.checkpoint.dir`` (or in the checkpoint folder already set).

    A folder of the machine serves only where driver and executors are one process; elsewhere no name is
    an error, since executors would not see each other's files."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="haggle-")
        delete_at_end(spark, root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    return folder


#: For writers of many small files: each task puts its files in place, instead of the driver one after the other at the
#: end.  A task that is tried again writes the same names.
PLACED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def delete_at_end(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


#: Tables above this size are split by the scan itself and are never dealt out anew.
SPREAD_BYTES = 1 << 30


def spread(df):
    """A small table in few files is dealt out anew, so that one row group does not keep a whole pipeline
    on one core; a large one is left as the scan splits it.  Only for plain scans."""
    spark = df.sparkSession
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(plan.stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and 2 * max(len(df.inputFiles()), size // split) <= cores else df
