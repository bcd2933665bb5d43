"""Session, table access and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the given one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("periodiq")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="periodiq-")
    return where


_own: dict[str, str] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Cuts the lineage like checkpoint(), but columnar and compressed, and every
    executor can read it again after a loss.
    """
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/periodiq/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes the tables that materialize() wrote for this application; results not yet read are lost."""
    delete(spark, _own_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever file system it is (ST-15)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, by name only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found) if found else []


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Puts a finished folder in the place of another by rename, so a reader sees the old or the new one, and a failed batch leaves the old (SNK-18)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(staged)):
        raise RuntimeError(f"nothing at {staged}")
    before = f"{target}.before"
    fs.delete(path(before), True)
    if fs.exists(path(target)) and not fs.rename(path(target), path(before)):
        raise RuntimeError(f"cannot move {target}")
    if not fs.rename(path(staged), path(target)):
        fs.rename(path(before), path(target))
        raise RuntimeError(f"cannot publish {staged}")
    fs.delete(path(before), True)
