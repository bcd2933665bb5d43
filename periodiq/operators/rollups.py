"""Aggregations: histograms, top values, votes, pivots (AGG-*, SRT-*, SNK-13).

Child tables are aggregated before a join, never after a fan-out. Histograms go
through two levels, so a hot group is combined on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str, value: Column, name: str = "histogram") -> DataFrame:
    """(key, map value -> count); null values are not counted (AGG-02)."""
    c = df.select(F.col(key), value.alias("_v")).where(F.col("_v").isNotNull()).groupBy(key, "_v").agg(F.count("*").alias("_n"))
    return c.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_v", "_n")))).alias(name))


def histogram_text(c: str | Column) -> Column:
    """A histogram as sorted `value=count` text, to compare and to print."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")


def top_rows(df: DataFrame, key: str, order: Sequence[Column], spread: Column, n: int, salts: int = 32) -> DataFrame:
    """The first n rows of a key with their place. Parts of a key are cut to n rows first, so a hot key never sorts in one task."""
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    d = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts))).withColumn("place", F.row_number().over(part)).where(F.col("place") <= n).drop("_salt", "place")
    return d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def top_values(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """(key, value, n, place): the n commonest values of a key, ties in alphabetical order (AGG-03, SRT-01)."""
    c = df.select(F.col(key), value.alias("value")).where(F.col("value") != "").groupBy(key, "value").agg(F.count("*").alias("n"))
    return top_rows(c, key, (F.desc("n"), F.col("value")), F.col("value"), n)


def split_list(c: Column, delimiter: str = ";") -> Column:
    """Trimmed non-empty parts of a list in one text."""
    return F.filter(F.transform(F.split(c, delimiter), lambda x: F.trim(x)), lambda x: x != "")


def weighted_votes(df: DataFrame, key: str, verdict: str, confidence: Column, weight: Column) -> DataFrame:
    """Sums of confidence times weight by verdict, total weight and counts (AGG-12, AGG-13)."""
    w = confidence * weight
    return df.groupBy(key).agg(
        F.sum(F.when(F.col(verdict) == "predatory", w).otherwise(0.0)).alias("against"),
        F.sum(F.when(F.col(verdict) == "legitimate", w).otherwise(0.0)).alias("in_favour"),
        F.sum(weight).alias("total_weight"),
        F.count_if(F.col(verdict) == "predatory").alias("votes_against"),
        F.count_if(F.col(verdict) == "legitimate").alias("votes_in_favour"),
    )


def condensed_pivot(df: DataFrame, key: str, column: str, values: Sequence[str], cell: Column) -> DataFrame:
    """One column per given value, empty where the key has none (SNK-13, PRJ-16). The values are named, so no pass is spent on finding them."""
    return df.groupBy(key).agg(*[F.coalesce(F.min(F.when(F.col(column) == v, cell)), F.lit("")).alias(v) for v in values])


def best_row(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of every key that is greatest in order (SRT-02 to SRT-05)."""
    rest = [c for c in df.columns if c != key]
    named = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return df.groupBy(key).agg(F.max(F.struct(*named, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_metrics(df: DataFrame, key: Column) -> DataFrame:
    """One row: records, distinct keys, duplicates, without a key (AGG-21)."""
    d = df.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return d.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(F.col("k").isNotNull()).alias("unique"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
    )
