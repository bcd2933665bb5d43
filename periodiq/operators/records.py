"""Records, reports and tallies (PRJ-01 to PRJ-03, PRJ-08, PRJ-10 to PRJ-12, PRJ-15, SNK-14, SNK-15, AGG-05, AGG-14, AGG-19, AGG-22, AGG-24, WIN-03, JN-20, SRC-22, SRC-25).

Projections of arrays and structs stay higher-order functions of the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unassessed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records of entries without a verdict: all fields, those of an assessment null (PRJ-01)."""
    return df.select("*", *[F.lit(None).cast("string").alias(f) for f in fields if f not in df.columns])


def votes(results: Column) -> Column:
    """Verdict -> number of results, of an array of (source, verdict, confidence) (PRJ-02)."""
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(results, lambda r: r["verdict"]), lambda v: v.isNotNull())))
    return F.transform(kinds, lambda v: F.struct(v.alias("verdict"), F.size(F.filter(results, lambda r: r["verdict"] == v)).alias("n")))


def conflicting(results: Column) -> Column:
    """Whether results speak for and against (PRJ-02, AGG-22)."""
    return F.exists(results, lambda r: r["verdict"] == "predatory") & F.exists(results, lambda r: r["verdict"] == "legitimate")


def enriched_issn(issn: Column, typed: Column, other: Column, kind: str) -> Column:
    """A record's own number, else the first of that kind among typed numbers (kind, value), else the first of another source (PRJ-03)."""
    return F.coalesce(issn, F.get(F.filter(typed, lambda t: t["kind"] == kind), F.lit(0))["value"], F.get(other, F.lit(0)))


def terms_of(subjects: Column) -> Column:
    """The terms of an array of (code, scheme, term) (PRJ-08)."""
    return F.filter(F.transform(subjects, lambda s: s["term"]), lambda t: t.isNotNull())


def timed(df: DataFrame, seconds: str, source: str, evidence: DataFrame) -> DataFrame:
    """Results with execution_time_ms and the kind of evidence of their source (PRJ-12). evidence: (source, evidence_type), a small registry."""
    return df.withColumn("execution_time_ms", F.col(seconds) * 1000.0).join(evidence.withColumnRenamed("source", source), source, "left")


def retraction_records(notices: DataFrame) -> DataFrame:
    """(doi, retraction_date, nature, reason, expires_at) of every article, the last notice of a DOI (PRJ-10, SNK-07).

    DOIs in lower case, dates as ISO text, an empty nature is a retraction, and a
    record is good for 8,760 hours from its notice.
    """
    d = notices.where(F.trim("original_paper_doi") != "").select(
        F.lower(F.trim("original_paper_doi")).alias("doi"),
        F.col("retraction_date").alias("_at"),
        F.date_format("retraction_date", "yyyy-MM-dd").alias("retraction_date"),
        F.coalesce(F.expr("nullif(trim(retraction_nature), '')"), F.lit("Retraction")).alias("nature"),
        F.expr("nullif(trim(reason), '')").alias("reason"),
        (F.col("retraction_date") + F.expr("interval 8760 hours")).alias("expires_at"),
        "_offset",
    )
    return d.groupBy("doi").agg(F.max(F.struct("_at", "_offset", "retraction_date", "nature", "reason", "expires_at")).alias("r")).select("doi", "r.retraction_date", "r.nature", "r.reason", "r.expires_at")


def retraction_status(entries: DataFrame, doi: str, records: DataFrame) -> DataFrame:
    """Entries with `is_retracted` and the record of their DOI (JN-20)."""
    e = entries.withColumn("_doi", F.lower(F.trim(doi)))
    return e.join(records.withColumnRenamed("doi", "_doi"), "_doi", "left").withColumn("is_retracted", F.col("nature").isNotNull()).drop("_doi")


def update_probe(updates: Column) -> Column:
    """The first update of an array of (type, doi) that retracts, else null (SRC-25)."""
    return F.get(F.filter(updates, lambda u: F.lower(u["type"]).contains("retract")), F.lit(0))


def bounded_set(c: Column, n: int) -> Column:
    """The first n distinct values in alphabetical order, to be used in agg (PRJ-11, SRT-06, SRT-08)."""
    return F.slice(F.array_sort(F.collect_set(c)), 1, n)


def rate_growth(df: DataFrame, recent: str, total: str, first_year: str, last_year: str, factor: float = 3.0, least: int = 100) -> DataFrame:
    """Rows whose yearly rate of the last five years exceeds factor times that of the years before, and least (WIN-03)."""
    before = F.greatest(F.lit(1), F.col(last_year) - F.col(first_year) + 1 - 5)
    rate, old = F.col(recent) / 5.0, (F.col(total) - F.col(recent)) / before
    return df.withColumn("recent_rate", rate).withColumn("earlier_rate", old).where((F.col("recent_rate") > factor * F.col("earlier_rate")) & (F.col("recent_rate") > least))


def tallies(df: DataFrame, key: str, status: str, kinds: Sequence[str]) -> DataFrame:
    """Counts of every status by key (AGG-14, AGG-19)."""
    return df.groupBy(key).agg(*[F.count_if(F.col(status) == k).alias(k) for k in kinds], F.count_if(F.col(status).isNull() | ~F.col(status).isin(*kinds)).alias("other"))


def source_status(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """Every registered source with its listings and last update; sources without any stay (AGG-24)."""
    n = listings.groupBy("source_name").agg(F.count("*").alias("listings"), F.max("updated_at").alias("last_update"))
    d = sources.select(F.col("name").alias("source_name"), "source_type").join(n, "source_name", "left")
    return d.select("source_name", "source_type", F.coalesce("listings", F.lit(0)).alias("listings"), "last_update", F.when(F.col("listings").isNull(), "empty").otherwise("loaded").alias("state"))


def report_text(name: Column, verdict: Column, confidence: Column, lines: Column) -> Column:
    """A report of one assessment as text (SNK-14)."""
    head = F.format_string("%s: %s (%.2f)", F.coalesce(name, F.lit("?")), F.coalesce(F.upper(verdict), F.lit("None")), F.coalesce(confidence, F.lit(0.0)))
    return F.array_join(F.concat(F.array(head), F.transform(lines, lambda x: F.concat(F.lit("- "), x))), "\n")


def summary(df: DataFrame, verdict: str, retracted: str) -> DataFrame:
    """One row: a bibliography's counts as text, and 1 if any entry is predatory or retracted (SNK-15)."""
    bad, gone = F.count_if(F.col(verdict) == "predatory"), F.count_if(retracted)
    text = F.concat_ws(", ", F.format_string("%d entries", F.count("*")), F.format_string("%d predatory", bad), F.format_string("%d retracted", gone))
    return df.agg(text.alias("summary"), F.when((bad > 0) | (gone > 0), 1).otherwise(0).alias("exit_code"))


def label(verdict: Column) -> Column:
    """A verdict in capitals, `None` where there is none (FS-45)."""
    return F.coalesce(F.upper(verdict), F.lit("None"))


def candidate_summary(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, candidates): the candidates of a query as one sorted array of structs (PRJ-15)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))


def enabled(sources: DataFrame, flag: Column) -> DataFrame:
    """Sources whose flag is set; a blank one is not (FLT-21, FLT-22)."""
    return sources.where(F.coalesce(F.trim(flag), F.lit("")) != "")


def needs_fallback(expanded: Column, verdict: Column, confidence: Column, found: Column) -> Column:
    """Whether an acronym is worth a second search: not yet expanded, and unknown, unsure or without any result (FLT-23)."""
    return ~expanded & (verdict.isNull() | (F.lower(verdict) == "unknown") | (F.coalesce(confidence, F.lit(0.0)) < 0.3) | (found == 0))


def memoized(entries: DataFrame, name: str, verdicts: DataFrame) -> DataFrame:
    """Entries with the verdict of their name, found once per distinct name (JN-24). verdicts: (venue, verdict), one row per venue."""
    return entries.withColumn("venue", F.lower(F.trim(name))).join(verdicts, "venue", "left")


def changed_since(files: DataFrame, last: Column) -> DataFrame:
    """Files of a binaryFile scan that were changed after the last synchronisation; all if there was none (FD-08)."""
    return files.where(F.coalesce(F.col("modificationTime") > last, F.lit(True)))


def with_entry(payload: Column, **extra: Column) -> Column:
    """A struct with further fields (FA-08)."""
    for k, v in extra.items():
        payload = payload.withField(k, v)
    return payload
