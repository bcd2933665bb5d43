"""Streams over the driver's event table, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.session import shared_dir
from periodiq.streaming.ingest import append_once, new_rows, read_version, upsert_stream


def _places(spark: SparkSession, sf: str):
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return new_rows(spark, sf, schema, "events.parquet"), schema, f"{root}/out", f"{root}/checkpoint"


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    stream, schema, out, checkpoint = _places(spark, sf)
    append_once(stream, ["user_id", "event_type"], out, checkpoint)
    return spark.read.schema(schema).parquet(out).select("user_id", "event_type")


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stream, schema, out, checkpoint = _places(spark, sf)
    upsert_stream(stream, ["user_id"], F.struct("ts", "event_id"), out, checkpoint)
    return read_version(spark, out, schema).select("user_id", "event_id", "event_type", "value")


QUERIES = {"stream_dedupe": stream_dedupe, "stream_upsert": stream_upsert}
ORACLE = {
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
