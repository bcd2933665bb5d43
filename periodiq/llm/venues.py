"""Which listings describe one venue, from their names and serial numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodiq.llm.identifiers import issn_key
from periodiq.llm.names import align, read_name
from periodiq.llm.variants import classes_of, string_classes
from periodiq.session import materialize


def _fits(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> bool:
        if not isinstance(x, str):
            return True
        n, m = read_name(x), read_name(y)
        return not n.tokens or align(n, m).kind != "none"

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def venue_classes(listings: DataFrame, key: str, name: str, issns: tuple[str, ...]) -> DataFrame:
    """(key, class) of the listings; a listing that nothing ties to another has a class of its own.

    Names are put into classes by the variant index. A listing without a
    readable name, or whose class is small and fits the name, joins the class
    that most listings under one of its valid serial numbers have. Numbers are
    compared with that class only, so a number that stands on very many
    listings costs no pairs.
    """
    d = listings.select(F.col(key).alias("_key"), F.col(name).alias("s"), F.array_distinct(F.array_compact(F.array(*[issn_key(F.col(c)) for c in issns]))).alias("issns"))
    by_name = string_classes(d)
    own = F.concat(F.lit("\u0001row "), F.col("_key").cast("string"))
    d = materialize(d.join(by_name, "s", "left").withColumn("class", F.coalesce("class", own)))
    said = d.select("_key", "class", "s", F.explode("issns").alias("issn"))
    held = said.groupBy("issn", "class").agg(F.count("*").alias("n"), F.max_by("s", F.struct(F.length("s"), F.col("s"))).alias("s"))
    most = held.where("s is not null").groupBy("issn").agg(F.max(F.struct("n", F.length("s"), "class", "s")).alias("m")).select("issn", F.col("m.class").alias("hub"), F.col("m.s").alias("hub_s"))
    fits = F.pandas_udf(_fits, "boolean")
    edges = held.join(most, "issn").where("class <> hub").where(fits("s", "hub_s")).select(F.col("class").alias("key"), "hub").distinct()
    nodes = d.select(F.col("class").alias("key")).distinct()
    joined = classes_of(nodes, materialize(edges))
    return d.join(joined.withColumnRenamed("class", "venue"), d["class"] == joined["key"]).select(F.col("_key").alias(key), F.col("venue").alias("class"))
