"""Lookups: cascades, key tables, semi joins (FLT-01, FLT-04, JN-*).

An OR over columns is a union of key rows and one equi-join, never a theta
join. A cascade tries all strategies in the same join and keeps the first by
rank, one shuffle instead of a chain of left joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_rows(df: DataFrame, id_column: str, strategies: Sequence[tuple[int, str, Column]]) -> DataFrame:
    """(id, rank, kind, pos, key): one row per key that a record can be found by (JN-12).

    A strategy is (rank, kind, column); array columns give a key per element,
    in order. Null and empty keys are no keys.
    """
    parts = []
    for rank, kind, c in strategies:
        keys = df.select(F.col(id_column).alias("id"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), c.alias("k"))
        if keys.schema["k"].dataType.typeName() == "array":
            keys = keys.select("id", "rank", "kind", F.posexplode("k").alias("pos", "key"))
        else:
            keys = keys.select("id", "rank", "kind", F.lit(0).alias("pos"), F.col("k").alias("key"))
        parts.append(keys.where((F.col("key").isNotNull()) & (F.col("key") != "")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade_match(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id, rank, kind, pos): the first strategy of each query that hits, ties to the smallest target (JN-10, JN-11).

    queries and targets come from key_rows and meet on (kind, key). Target keys
    are reduced to the smallest id per key before the join, so a key that very
    many targets share costs one row.
    """
    t = targets.groupBy("kind", "key").agg(F.min("id").alias("target_id"))
    hits = queries.join(t, ["kind", "key"])
    best = hits.groupBy("id").agg(F.min(F.struct("rank", "pos", "target_id", "kind")).alias("b"))
    return best.select(F.col("id").alias("query_id"), F.col("b.target_id").alias("target_id"), F.col("b.rank").alias("rank"), F.col("b.kind").alias("kind"), F.col("b.pos").alias("pos"))


def with_misses(queries: DataFrame, id_column: str, matches: DataFrame) -> DataFrame:
    """Every query with its status, found or not_found (JN-13, SC-20)."""
    j = queries.select(F.col(id_column).alias("query_id")).distinct().join(matches, "query_id", "left")
    return j.withColumn("status", F.when(F.col("target_id").isNotNull(), "found").otherwise("not_found"))


def disjoint(a: Column, b: Column) -> Column:
    """Whether two identifier sets contradict: both there and nothing shared (SET-04)."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
