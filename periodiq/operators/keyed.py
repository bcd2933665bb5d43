"""Keyed rows: one per key, upserts, TTL, frontiers (WIN-*, SNK-*, ST-03, ST-04).

Parquet has no MERGE, so an upsert is a new table out of the old and the new.
Where one row per key is enough, an aggregate over a struct replaces a window:
it combines on the map side, so a hot key never gathers its rows in a task.
Null keys form a key of their own; equal order values are settled by the other
columns, so results do not depend on partitioning; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodiq.operators.rollups import top_rows

def _one(df: DataFrame, keys: Sequence[str], order: Column, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # fields by place, so no column name can clash with another
    row = F.struct(order.alias("o"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)])
    one = df.groupBy(*keys).agg(pick(row).alias("_row"))
    return one.select(*keys, *[F.col("_row")[f"f{i}"].alias(c) for i, c in enumerate(rest)]).select(*[F.col(f"`{c}`") for c in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the greatest order of every key (WIN-01, WIN-06, SNK-07 to SNK-09)."""
    return _one(df, keys, order, F.max)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the least order of every key (WIN-05, SET-02)."""
    return _one(df, keys, order, F.min)


def unexpired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows still valid at the given time (FLT-08, ST-04)."""
    return df.where(F.col(expires) > as_of)


def upsert_last(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key, also with nulls (SNK-01, SNK-03)."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New non-empty values replace old ones field by field (SNK-05). One row per key on each side."""
    fields = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    given = lambda c: F.when(F.col(f"_new_{c}").cast("string") != "", F.col(f"_new_{c}"))
    return old.join(n, list(keys), "full").select(*keys, *[F.coalesce(given(c), F.col(c)).alias(c) for c in fields])


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Old rows and the first new row of every key that is not there (SNK-02, SNK-12)."""
    return old.unionByName(first_per_key(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), keys, order))


def replace_sightings(old: DataFrame, new: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """Keyed union that keeps the earliest first and the latest last sighting (SNK-04)."""
    rest = [c for c in old.columns if c not in (*keys, first, last)]
    both = old.unionByName(new)
    newest = F.max(F.struct(F.col(last).alias("_l"), *rest)).alias("_row")
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), newest).select(*keys, first, last, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*old.columns)


def keep_referenced(df: DataFrame, key: str, children: DataFrame, reference: str) -> DataFrame:
    """Rows that some child refers to: the keep-set form of deleting orphans (JN-05, ST-12)."""
    return df.join(children.select(F.col(reference).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def completion_frontier(df: DataFrame, group: str, index: str) -> DataFrame:
    """(group, frontier, beyond): the end of the gapless run from the least index, and what is done behind it (WIN-07).

    Gaps are found between neighbours of the distinct indices; a group is one
    file or batch, so its window is bounded.
    """
    d = df.select(group, index).distinct()
    w = Window.partitionBy(group).orderBy(index)
    d = d.withColumn("_gap", F.col(index) - F.lag(index, 1).over(w) > 1)
    d = d.withColumn("_run", F.sum(F.coalesce(F.col("_gap").cast("int"), F.lit(0))).over(w))
    return d.groupBy(group).agg(F.max(F.when(F.col("_run") == 0, F.col(index))).alias("frontier"), F.count_if(F.col("_run") > 0).alias("beyond"))


def record_segments(df: DataFrame, group: str, order: str, is_start: Column) -> DataFrame:
    """Adds `segment`, the running number of record starts in a group (WIN-08, SRC-17)."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("segment", F.sum(is_start.cast("int")).over(w))


def first_distinct(df: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """(key, value, place) of the first n distinct values of every key by arrival (WIN-04)."""
    seen = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    return top_rows(seen, key, (F.col("_at"), F.col(value)), F.col(value), n).select(key, value, "place")


def spikes(counts: DataFrame, key: str, year: str, n: str, factor: float, least: int) -> DataFrame:
    """Keys whose latest year exceeds factor times the mean of the two counted years before it, and least (WIN-02)."""
    w = Window.partitionBy(key).orderBy(year)
    d = counts.withColumn("_before", F.avg(n).over(w.rowsBetween(-2, -1))).withColumn("_rank", F.row_number().over(w)).withColumn("_last", F.lead(year, 1).over(w).isNull())
    return d.where(F.col("_last") & (F.col("_rank") >= 3) & (F.col(n) > factor * F.col("_before")) & (F.col(n) > least)).select(key, year, n, F.col("_before").alias("mean_before"))
