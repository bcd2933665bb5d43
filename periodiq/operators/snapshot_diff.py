"""What changed between full snapshots (problem 1).

Every delivered row becomes signed cells: +1 in its own snapshot and -1 in the
next one, for each (key, field, value) and for the presence of the key. Cells
that are the same in two consecutive snapshots cancel in a grouped sum; what is
left classifies the key and names the changed fields.

Two exchanges: one for the valid row of each (snapshot, key), pre-aggregated on
the map side, and one by (snapshot, key) under which both cell sums run
without a further shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

BLANKS = r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$"


@pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    # Spark has no Unicode normalisation; Arrow batches, ASCII strings pass at once.
    return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def same_text(c: Column) -> Column:
    """Unicode form and surrounding blanks do not count."""
    return nfc(F.regexp_replace(c, BLANKS, ""))


def same_url(c: Column) -> Column:
    """As same_text; scheme and host in lower case, one final slash dropped."""
    u = F.regexp_replace(same_text(c), "/$", "")
    head = F.regexp_extract(u, r"^(?i)([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substring(u, F.length(head) + 1, F.length(u)))


def same_second(c: Column) -> Column:
    return F.date_trunc("second", c).cast("string")


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: str,
    version: str,
    fields: Mapping[str, Column],
) -> DataFrame:
    """Rows (snapshot, key, change_kind, changed_fields) for all but the first snapshot.

    fields maps a name to the column expression whose value counts as content;
    other columns, clashing names included, are not looked at.
    Of several deliveries of a key in a snapshot the one with the greatest
    version is valid; equal versions are settled by the greatest content, so
    repeated rows do not matter. Null field values equal each other. Rows
    without snapshot or key carry no identity and are left out. A snapshot
    number missing between two others is an empty snapshot. An empty table
    gives no rows.
    """
    names = list(fields)
    raw = df.select(
        F.col(snapshot).alias("_s"),
        F.col(key).alias("_k"),
        F.struct(F.col(version).alias("_v"), *[fields[n].cast("string").alias(n) for n in names]).alias("_r"),
    ).where("_s is not null and _k is not null")
    valid = raw.groupBy("_s", "_k").agg(F.max("_r").alias("_r"))
    last = df.agg(F.max(snapshot)).scalar()
    signed = (
        valid.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1))))
        .where(F.col("_s") + F.col("_d") <= last)
        .select((F.col("_s") + F.col("_d")).cast(df.schema[snapshot].dataType).alias("_s"), "_k", (1 - 2 * F.col("_d")).alias("_sign"), "_r")
        .repartition("_s", "_k")
    )
    cells = signed.select(
        "_s",
        "_k",
        "_sign",
        F.explode(
            F.array(
                F.struct(F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("v")),
                *[F.struct(F.lit(n).alias("f"), F.col(f"_r.{n}").alias("v")) for n in names],
            )
        ).alias("_c"),
    ).select("_s", "_k", "_c.f", "_c.v", "_sign")
    left = cells.groupBy("_s", "_k", "f", "v").agg(F.sum("_sign").alias("n")).where("n <> 0")
    first = df.agg(F.min(snapshot)).scalar()
    presence = F.sum(F.when(F.col("f").isNull(), F.col("n")))
    return (
        left.groupBy("_s", "_k")
        .agg(presence.alias("p"), F.sort_array(F.collect_set("f")).alias("fs"))
        .where(F.col("_s") > first)
        .select(
            F.col("_s").alias(snapshot),
            F.col("_k").alias(key),
            F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed").alias("change_kind"),
            F.when(F.col("p").isNull(), F.col("fs")).alias("changed_fields"),
        )
    )


def url_snapshot_changes(urls: DataFrame) -> DataFrame:
    """snapshot_changes over address records: name, url and last sighting count."""
    return snapshot_changes(
        urls,
        "snapshot_no",
        "id",
        "delivered_at",
        {
            "normalized_name": same_text(F.col("normalized_name")),
            "url": same_url(F.col("url")),
            "last_seen_at": same_second(F.col("last_seen_at")),
        },
    )
