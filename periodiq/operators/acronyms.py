"""Mining of acronyms from bibliographies (AGG-16, AGG-17, AGG-25, JN-23, SNK-11, SNK-21).

Counts per file are a grouped sum, which Spark combines on the map side, and the
merge over files is a second sum over those counts: no file is a unit of work of
its own, and no list of names is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodiq.functions import text as tx


def mined(df: DataFrame, file: str, kind: str, name: Column) -> DataFrame:
    """(file, kind, acronym, series, n): how often a file gives an acronym beside a name, names folded to their series (AGG-16, AGG-25)."""
    d = df.select(F.col(file).alias("file"), F.col(kind).alias("kind"), F.get(tx.parenthesised_acronyms(name), F.lit(0)).alias("acronym"), tx.acronym_meaning(name).alias("meaning"))
    d = d.where("acronym is not null and meaning is not null")
    return d.groupBy("file", "kind", F.upper("acronym").alias("acronym"), tx.venue_key(F.col("meaning")).alias("series")).agg(F.count("*").alias("n"))


def merged(per_file: DataFrame) -> DataFrame:
    """(kind, acronym, series, n, files, names, conflict): the commonest series of every acronym over all files (AGG-17).

    names counts the different series; an acronym is in conflict if one of them
    is no form of the commonest. Ties go to the first in alphabetical order.
    """
    total = per_file.groupBy("kind", "acronym", "series").agg(F.sum("n").alias("n"), F.count_distinct("file").alias("files"))
    best = total.groupBy("kind", "acronym").agg(F.max(F.struct("n", "files")).alias("top"), F.count("*").alias("names"))
    first = total.join(best, ["kind", "acronym"]).where((F.col("n") == F.col("top.n")) & (F.col("files") == F.col("top.files")))
    first = first.groupBy("kind", "acronym").agg(F.min("series").alias("series"), F.first("n").alias("n"), F.first("files").alias("files"), F.first("names").alias("names"))
    other = total.select("kind", "acronym", F.col("series").alias("other")).join(first.select("kind", "acronym", "series"), ["kind", "acronym"])
    clash = other.groupBy("kind", "acronym").agg(F.max(~tx.same_series(F.col("series"), F.col("other"))).alias("conflict"))
    return first.join(clash, ["kind", "acronym"])


def compared(mined_acronyms: DataFrame, known: DataFrame) -> DataFrame:
    """Mined acronyms with `state`: new, existing or conflict with what is known (JN-23).

    known: (acronym, canonical), the first in alphabetical order where an acronym stands for several.
    """
    k = known.groupBy(F.upper("acronym").alias("acronym")).agg(F.min(F.lower("canonical")).alias("known_as"))
    same = tx.same_series(F.col("series"), F.col("known_as"))
    return mined_acronyms.join(k, "acronym", "left").withColumn("state", F.when(F.col("known_as").isNull(), "new").when(same, "existing").otherwise("conflict"))


def learned(known: DataFrame, told: DataFrame) -> DataFrame:
    """(acronym, canonical, confidence_score, overwritten): known entries with those told since, at confidence 0 (SNK-11, SNK-21).

    A told meaning takes the place of a known one, and only its difference is
    recorded; of several told for an acronym the first in alphabetical order counts.
    """
    t = told.where("acronym is not null and canonical is not null").groupBy(F.upper("acronym").alias("acronym")).agg(F.min("canonical").alias("told"))
    k = known.groupBy(F.upper("acronym").alias("acronym")).agg(F.min_by("canonical", F.struct("canonical", "id")).alias("canonical"), F.max("confidence_score").alias("confidence_score"))
    d = k.join(t, "acronym", "full")
    return d.select(
        "acronym",
        F.coalesce("told", "canonical").alias("canonical"),
        F.when(F.col("told").isNotNull(), 0.0).otherwise(F.col("confidence_score")).alias("confidence_score"),
        F.coalesce(F.lower("told") != F.lower("canonical"), F.lit(False)).alias("overwritten"),
    )
