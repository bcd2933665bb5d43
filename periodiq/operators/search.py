"""Searches over venues and acronyms (FLT-02, FLT-03, FLT-05, FLT-15 to FLT-18, FLT-25, JN-08, JN-14 to JN-20, JN-25, SET-06).

A search is a conjunction of filters that reach the scan, lookups are equi-joins
on keys; nothing here forms pairs that do not share a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodiq.functions import text as tx


def like_text(value: str) -> str:
    """The value with the signs of LIKE taken literally."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(df: DataFrame, equal: Mapping[str, str | None] | None = None, containing: Mapping[str, str | None] | None = None, either: Sequence[tuple[Sequence[str], str | None]] = ()) -> DataFrame:
    """Rows that meet every given predicate; predicates without a value are left out (FLT-02, FLT-03).

    equal compares without case, containing looks for a part of the text without
    case, either wants the value in one of several columns. Null cells meet nothing.
    """
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.lower(column) == value.lower())
    for column, value in (containing or {}).items():
        if value is not None:
            df = df.where(F.col(column).ilike(f"%{like_text(value)}%"))
    for columns, value in either:
        if value is not None:
            hit = F.lit(False)
            for c in columns:
                hit = hit | F.coalesce(F.col(c) == value, F.lit(False))
            df = df.where(hit)
    return df


def with_urls(venues: DataFrame, key: str, urls: DataFrame, reference: str, url: str) -> DataFrame:
    """Venues with the sorted array of their addresses, aggregated before the join (JN-25, PRJ-09)."""
    of = urls.where(F.col(url).isNotNull()).groupBy(F.col(reference).alias(key)).agg(F.array_sort(F.collect_set(url)).alias("urls"))
    return venues.join(of, key, "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


def acronym_guard(c: Column) -> Column:
    """Whether a text is short and all capitals, so worth a search as an acronym (FLT-25)."""
    return (F.length(c) <= 10) & (F.upper(c) == c) & (F.lower(c) != c)


def acronym_like(label: Column, name: Column) -> Column:
    """Whether a candidate is an acronym: by its label if that says so, else by its name (FLT-16)."""
    said = F.lower(F.coalesce(label, F.lit("")))
    return F.when(said.contains("acronym"), True).when(said.contains("full name"), False).otherwise(F.coalesce(tx.is_standalone_acronym(name), F.lit(False)))


def generic_title(c: Column) -> Column:
    """Whether a resolved title says nothing (FLT-17)."""
    return F.coalesce(F.lower(F.trim(c)).isin("proceedings", "journal", "conference"), F.lit(False))


def types_agree(wanted: Column, found: Column) -> Column:
    """Whether two kinds of venue agree; an empty or unknown one agrees with all (FLT-18)."""
    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (wanted, found))
    return a.isin("", "unknown") | b.isin("", "unknown") | (a == b)


def acronym_matches(asked: DataFrame, column: str, acronyms: DataFrame, least: float = 0.8) -> DataFrame:
    """Asked rows with the acronym entry of their text, without case, of at least that confidence (FLT-05)."""
    a = acronyms.where(F.col("confidence_score") >= least).select(F.lower(F.trim("acronym")).alias("_k"), "acronym", "entity_type", "canonical", "confidence_score", F.col("id").alias("acronym_id"))
    return asked.withColumn("_k", F.lower(F.trim(column))).join(a, "_k").drop("_k")


def first_per_issn(acronyms: DataFrame, listings: DataFrame, name: str, issns: Sequence[Column]) -> DataFrame:
    """(issn, acronym_id, acronym): the first acronym entry that a serial number leads to by the listed name (JN-08)."""
    said = listings.select(F.lower(name).alias("_n"), F.explode(F.array_distinct(F.array_compact(F.array(*issns)))).alias("issn")).distinct()
    a = acronyms.select(F.lower("canonical").alias("_n"), F.struct(F.col("id").alias("acronym_id"), "acronym").alias("a"))
    return said.join(a, "_n").groupBy("issn").agg(F.min("a").alias("a")).select("issn", "a.acronym_id", "a.acronym")


def candidate_forms(df: DataFrame, key: str, name: Column, most: int = 12) -> DataFrame:
    """(key, place, form): the forms under which a name is looked up, in order (JN-19)."""
    forms = F.slice(F.array_distinct(F.filter(F.transform(F.concat(F.array(name), tx.name_aliases(name), tx.parenthesised_acronyms(name)), lambda x: F.lower(F.trim(x))), lambda x: x != "")), 1, most)
    return df.select(F.col(key), F.posexplode(forms).alias("place", "form"))


def compared_results(results: DataFrame, query: str, source: str, verdict: str, pairs: DataFrame) -> DataFrame:
    """(query, a, b, agree): the found results of one query, compared for the registered pairs of sources (JN-14).

    pairs: (a, b), a small registry. Results are distinct by (query, source)
    first, so a query has at most one row per pair.
    """
    one = results.where(F.col(verdict).isNotNull()).groupBy(query, source).agg(F.min(verdict).alias("v"))
    left = one.select(query, F.col(source).alias("a"), F.col("v").alias("va")).join(pairs, "a")
    return left.join(one.select(query, F.col(source).alias("b"), F.col("v").alias("vb")), [query, "b"]).select(query, "a", "b", (F.col("va") == F.col("vb")).alias("agree"))


def conflicting_candidates(df: DataFrame, key: str, block: str, verdict: str, identifiers: str) -> DataFrame:
    """(a, b, relation) of candidates of one block with different verdicts: whether identifiers overlap or contradict (JN-15)."""
    l, r = (df.select(F.col(block).alias("_b"), F.col(key).alias(k), F.col(verdict).alias(f"v{k}"), F.col(identifiers).alias(f"i{k}")) for k in ("a", "b"))  # noqa: E741
    both = l.join(r, "_b").where((F.col("a") < F.col("b")) & (F.col("va") != F.col("vb")))
    empty = (F.size("ia") == 0) | (F.size("ib") == 0)
    return both.select("a", "b", F.when(empty, "unknown").when(F.arrays_overlap("ia", "ib"), "same").otherwise("contradiction").alias("relation"))


def containing_names(short: DataFrame, long: DataFrame, least: int = 4) -> DataFrame:
    """(a, b): names of `short` (a, name) that stand as whole words in names of `long` (b, name) (JN-16).

    A theta join made equi: a name is met through its rarest word in the long
    names, so no pair without a common word is formed.
    """
    word = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    held = long.select("b", plain(F.col("name")).alias("held"), F.explode(word(F.col("name"))).alias("w"))
    df = held.groupBy("w").agg(F.count("*").alias("df"))
    asked = short.select("a", plain(F.col("name")).alias("asked"), F.explode(word(F.col("name"))).alias("w")).join(df, "w")
    rarest = asked.groupBy("a", "asked").agg(F.min(F.struct("df", "w")).alias("r"), F.count("*").alias("n")).select("a", "asked", F.col("r.w").alias("w"))
    return rarest.join(held, "w").where(F.contains("held", "asked")).select("a", "b").distinct()


def candidate_set(*frames: DataFrame) -> DataFrame:
    """Distinct (source, name, issn, eissn) of all candidates (SET-06)."""
    keys = ["source", "name", "issn", "eissn"]
    out = frames[0].select(*keys)
    for f in frames[1:]:
        out = out.unionByName(f.select(*keys))
    return out.distinct()


def decisive(results: Column) -> Column:
    """Whether some found result is a verdict for or against (FLT-15)."""
    return F.exists(results, lambda r: r["verdict"].isin("predatory", "legitimate", "suspicious"))


def list_evidence(results: Column) -> Column:
    """Whether some found result comes from a list (FLT-15)."""
    return F.exists(results, lambda r: r["evidence"].endswith("_list"))


def heuristic_only(results: Column) -> Column:
    """Whether all evidence is heuristic (FLT-15)."""
    return (F.size(results) > 0) & ~list_evidence(results)
