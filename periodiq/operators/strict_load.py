"""Rows that fail to parse (problem 2): strict load plus anti-join.

The strict load keeps only conforming records and types them; the raw records
minus the loaded ones, by record offset and content, are the failures, and only
those are diagnosed. All patterns are possessive, so neither a long field nor a
malformed one makes the matcher recurse or backtrack.

Each record is taken apart once: one scan yields its fields, and it is well
quoted if they, joined again, are the record. The fields come out of a generator,
so neither a filter nor a column repeats the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_QUOTED}|[^",]*+)'
DATE_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})$"

RETRACTION_FIELDS = (
    "record_id", "title", "journal", "publisher", "author", "article_type", "retraction_date",
    "retraction_doi", "original_paper_doi", "retraction_nature", "reason",
)


def record_text(c: Column) -> Column:
    """The record without the line end that a transfer may leave."""
    return F.regexp_replace(c, r"\r?\n?$", "")


def raw_fields(c: Column) -> Column:
    """What a scan for fields behind commas meets, as written; text that fits no field is passed over."""
    return F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(rf",({_FIELD})"), 1)


def unquote(c: Column) -> Column:
    return F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def strict_timestamp(c: Column) -> Column:
    """M/d/yyyy H:mm with a four-digit year and two-digit minute; null where no such time exists."""
    return F.when(c.rlike(DATE_TIME), F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm")))


def _date_ok(c: Column) -> Column:
    return c.isin("", "0") | F.coalesce(strict_timestamp(c).isNotNull(), F.lit(False))


def _parsed(records: DataFrame) -> DataFrame:
    """records with _fields and _ok, whether the record in _raw is well quoted."""
    d = records.withColumn("_text", record_text(F.col("_raw")))
    d = d.select("*", F.explode(F.array(raw_fields(F.col("_text")))).alias("_fields"))
    return d.withColumn("_ok", F.coalesce(F.array_join("_fields", ",") == F.col("_text"), F.lit(False)))


def _records(lines: DataFrame, offset: str, raw: str) -> DataFrame:
    d = lines.select(F.col(offset).alias("_offset"), F.col(raw).alias("_raw"))
    return d.withColumn("_digest", F.md5(F.coalesce(F.col("_raw"), F.lit(""))))


def strict_load(
    lines: DataFrame,
    offset: str = "line_id",
    raw: str = "raw_line",
    names: Sequence[str] = RETRACTION_FIELDS,
    letter_field: str = "journal",
    time_field: str = "retraction_date",
) -> DataFrame:
    """Typed rows of the conforming records, with their offset.

    time_field comes out as a timestamp, null where it is empty or `0`.
    Repeated records are loaded as often as they come. Columns of the input
    other than offset and raw are not looked at. An empty table loads no rows.
    """
    d = _parsed(_records(lines, offset, raw)).where(F.col("_ok") & (F.size("_fields") == len(names)))
    d = d.select("_offset", "_digest", *[unquote(F.get("_fields", F.lit(i))).alias(n) for i, n in enumerate(names)])
    d = d.where(F.col(letter_field).rlike(r"\p{L}") & _date_ok(F.col(time_field)))
    return d.withColumn(time_field, strict_timestamp(F.col(time_field)))


def rejected_records(
    lines: DataFrame,
    offset: str = "line_id",
    raw: str = "raw_line",
    names: Sequence[str] = RETRACTION_FIELDS,
    letter_field: str = "journal",
    time_field: str = "retraction_date",
) -> DataFrame:
    """(offset, reason, raw) of every record that strict_load leaves out.

    reason is the first that applies of quoting, column_count and bad_value.
    A null record has no fields: column_count. A null or repeated offset is
    told apart by the record's digest, so a good and a bad record under one
    offset do not hide each other.
    """
    loaded = strict_load(lines, offset, raw, names, letter_field, time_field).select("_offset", "_digest").distinct()
    base = _records(lines, offset, raw).select(F.col("_offset").alias("_o"), F.col("_digest").alias("_d"), "_raw")
    rest = _parsed(base.join(loaded, (F.col("_d") == F.col("_digest")) & F.col("_o").eqNullSafe(F.col("_offset")), "left_anti"))
    return rest.select(
        F.col("_o").alias(offset),
        F.when(F.col("_raw").isNull(), "column_count")
        .when(~F.col("_ok"), "quoting")
        .when(F.size("_fields") != len(names), "column_count")
        .otherwise("bad_value")
        .alias("reason"),
        F.col("_raw").alias(raw),
    )
