"""Sessions and scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="motifmill-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now; the folder is scratch space
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/motifmill-{uuid.uuid4().hex}/{name}"
    atexit.register(_delete, spark, path.rsplit("/", 1)[0])
    return path


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back, which cuts lineage and survives lost executors; `by` makes a folder for each of its values."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(table: DataFrame, part: str = "") -> None:
    """Delete a table of `save`, or the folder of one value (such as "kind=words"), that nothing reads any more."""
    _delete(table.sparkSession, f"{table.saved_at}/{part}" if part else table.saved_at.rsplit("/", 1)[0])
