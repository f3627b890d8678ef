"""Session helpers: where durable intermediate data may live, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("colscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def workspace(spark: SparkSession) -> str:
    """Folder for checkpoints and scratch tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, since there all tasks share one machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="colscope-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _scratch_folder(spark: SparkSession) -> str:
    return f"{workspace(spark).rstrip('/')}/colscope-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the scratch tables of this application; results still to be read depend on them."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    The result survives the loss of executors, is computed once however often it is read, and lets
    Catalyst prune columns of the stored files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: str, per: int, label: str = "dealt") -> DataFrame:
    """A stored table with a file for every ``per`` rows, dealt by a hash of ``by`` and sorted by it; a table of fewer rows stays as it is.

    A small file is read by one task however many rows it has, and so is all that follows.
    """
    shares = df.count() // per
    return cut(df.repartition(shares, by).sortWithinPartitions(by), label) if shares > 1 else df
