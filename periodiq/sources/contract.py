"""The ingest contract that every reader emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodiq.functions.identifiers import issn_checks, normal_issn
from periodiq.functions.text import clean_name
from periodiq.operators.keyed import first_per_key

COLUMNS = ("journal_name", "normalized_name", "issn", "eissn", "publisher", "urls", "metadata")


def ingest_rows(df: DataFrame, name: Column, issn: Column | None = None, eissn: Column | None = None, publisher: Column | None = None, urls: Column | None = None, metadata: Column | None = None, least: int = 2, check_issn: bool = True) -> DataFrame:
    """Rows of the contract; names under `least` characters are dropped, ISSNs that fail their check become null."""
    null = F.lit(None).cast("string")

    def number(c: Column | None) -> Column:
        n = normal_issn(c) if c is not None else null
        return F.when(issn_checks(n), n) if check_issn else n

    said = publisher if publisher is not None else null
    d = df.withColumn("_name", F.trim(name)).where(F.length("_name") >= least)
    return d.select(
        F.col("_name").alias("journal_name"),
        clean_name(F.col("_name")).alias("normalized_name"),
        number(issn).alias("issn"),
        number(eissn).alias("eissn"),
        F.when(F.trim(said) != "", F.trim(said)).alias("publisher"),
        (urls if urls is not None else F.array().cast("array<string>")).alias("urls"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def url_set(*fields: Column) -> Column:
    """Distinct trimmed addresses of scalar or array columns (PRJ-06)."""
    return F.array_distinct(F.filter(F.transform(F.array(*fields), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def unique_names(df: DataFrame, order: Column) -> DataFrame:
    """First row per folded name; rows without a name are dropped (SET-02)."""
    k = F.lower(F.trim(F.coalesce(F.when(F.col("normalized_name") != "", F.col("normalized_name")), F.col("journal_name"))))
    d = df.withColumn("_order", order).withColumn("_k", k).where("_k <> ''")
    keep = first_per_key(d.drop("metadata"), ["_k"], F.col("_order"))
    return keep.drop("_k", "_order")


def child_rows(df: DataFrame, key: str, source: str, verdict: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names, listings and addresses of ingest rows (PRJ-07)."""
    names = df.select(key, F.explode(F.array_distinct(F.array_compact(F.array("journal_name", "normalized_name")))).alias("name"))
    listings = df.select(key, F.lit(source).alias("source_name"), F.lit(verdict).alias("assessment"), F.lit(1.0).alias("confidence")).distinct()
    return names, listings, df.select(key, F.explode("urls").alias("url"))
