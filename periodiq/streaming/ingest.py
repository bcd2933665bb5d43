"""Incremental ingest: deduplicated appends, keyed upserts, TTL state (ST-*).

Every stream runs with availableNow and a checkpoint location, so a run takes
what is new and a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.operators.keyed import latest_per_key, upsert_last
from periodiq.session import delete, listed


def new_rows(spark: SparkSession, path: str, schema, pattern: str = "*") -> DataFrame:
    """A file stream over Parquet; each file is read once (ST-01)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _touched(batch: DataFrame) -> list[int]:
    return [r[0] for r in batch.select("bucket").distinct().collect()]  # at most as many as there are buckets


def append_once(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str, buckets: int = 16) -> None:
    """Appends one row of every key that was not appended before (ST-05, ST-08, SNK-12, SNK-16, SNK-17).

    What is written is the memory: a micro-batch looks up only its own buckets,
    and only their key columns, so no state grows in the executors. A repeated
    batch overwrites its own folder and does not see it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys)).withColumn("bucket", _bucket(keys, buckets))
        old = [p for p in listed(spark, f"{path}/batch=*") if int(p.rsplit("=", 1)[1]) < batch_id]
        if old:
            known = spark.read.schema(new.schema).option("basePath", path).parquet(*old).where(F.col("bucket").isin(_touched(new)))
            new = new.join(known.select(*keys), list(keys), "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, keys: Sequence[str], order: Column, root: str, checkpoint: str, buckets: int = 16) -> None:
    """Keeps the latest row of every key under root (ST-02, SNK-01).

    Keys live in buckets. A micro-batch rewrites only the buckets that it
    touches, as version = batch id + 1, from their version before it; a repeated
    batch writes the same versions again, and a reader takes the newest version
    of every bucket. The version before the last is deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", _bucket(keys, buckets))
        touched = set(_touched(new))
        if not touched:
            return
        versions = {b: [v for v in vs if v <= batch_id] for b, vs in _versions(spark, root).items() if b in touched}
        old = [f"{root}/bucket={b}/version={vs[-1]}" for b, vs in versions.items() if vs]
        both = new.unionByName(spark.read.schema(new.schema).option("basePath", root).parquet(*old).select(*new.columns)) if old else new
        one = latest_per_key(both, keys, order).withColumn("version", F.lit(batch_id + 1)).repartition("bucket")
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(root)
        for b, vs in versions.items():
            for v in vs[:-1]:
                delete(spark, f"{root}/bucket={b}/version={v}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, root: str) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for p in listed(spark, f"{root}/bucket=*/version=*"):
        bucket, version = (int(x.split("=")[1]) for x in p.rsplit("/", 2)[1:])
        out.setdefault(bucket, []).append(version)
    return {b: sorted(vs) for b, vs in out.items()}


def read_version(spark: SparkSession, root: str, schema) -> DataFrame:
    """The newest version of every bucket of an upserted table; versions are told by folder names."""
    newest = [f"{root}/bucket={b}/version={vs[-1]}" for b, vs in _versions(spark, root).items()]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def guard_resume(spark: SparkSession, checkpoint: str, mode: str, source: str) -> None:
    """Records the mode and source of a job beside its checkpoint, and refuses to go on with others (ST-07)."""
    path = f"{checkpoint}.job"
    told = [r.value for r in spark.read.text(path).collect()] if listed(spark, path) else []
    if not told:
        spark.createDataFrame([(f"{mode}\t{source}",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif told != [f"{mode}\t{source}"]:
        raise ValueError(f"checkpoint {checkpoint} belongs to another job: {told}")


def run_bulk(spark: SparkSession, stream: DataFrame, assess, keys: Sequence[str], path: str, checkpoint: str, mode: str, source: str) -> None:
    """Assesses what is new and appends each record once; partitions take the place of workers, the checkpoint that of a log (ST-14)."""
    guard_resume(spark, checkpoint, mode, source)
    append_once(assess(stream), keys, path, checkpoint)


def audit(spark: SparkSession, path: str, action: str, subject: str, rows: int, at: Column) -> None:
    """Appends one line to the log of actions (SNK-19)."""
    spark.range(1).select(F.lit(action).alias("action"), F.lit(subject).alias("subject"), F.lit(rows).cast("bigint").alias("rows"), at.alias("at")).write.mode("append").parquet(path)


def register_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """Sources with the new ones in the place of those of the same name; the name is the key, so nothing dangles (SNK-20)."""
    return upsert_last(known, new, ["name"])


def within_ttl(stream: DataFrame, time: str, ttl: str, keys: Sequence[str]) -> DataFrame:
    """First row of every key within a watermark; state older than the TTL is dropped (ST-03, ST-04)."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(list(keys))


def read_through(keys: DataFrame, cache: DataFrame, compute, key: str, expires: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, newly computed): cached rows that are valid, and compute() over the other keys only (ST-06, ST-13, JN-26)."""
    asked = keys.select(key).distinct()
    valid = cache.where(F.col(expires) > as_of).join(asked, key, "left_semi")
    fresh = compute(asked.join(valid.select(key), key, "left_anti"))
    return valid.unionByName(fresh), fresh


def retry_set(results: DataFrame, status: str = "status", transient: Sequence[str] = ("timeout", "rate_limited", "error")) -> DataFrame:
    """Rows whose status passes, to go into the next micro-batch (ST-09)."""
    return results.where(F.col(status).isin(*transient))


def mapped_status(seconds: Column, code: Column, limit: float) -> Column:
    """Status of an answer: timeout beyond the limit, rate_limited, error, not_found or found (ST-10, ST-11)."""
    return F.when(seconds > limit, "timeout").when(code == 429, "rate_limited").when(code == 404, "not_found").when(code >= 400, "error").when(code.isNull(), "error").otherwise("found")
