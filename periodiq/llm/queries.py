"""Queries of the problems on training data over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.llm.canonical import map_values, mapped_entries
from periodiq.llm.linking import link_entities
from periodiq.llm.mixing import mix_report, mix_sources
from periodiq.llm.packing import container_assignments, pack_bins, packing_report
from periodiq.llm.residue import residue
from periodiq.llm.survivor import field_truths, judged_true, survivors
from periodiq.llm.tokens import token_sizes
from periodiq.llm.variants import link_variants, variant_classes
from periodiq.llm.venues import venue_classes
from periodiq.session import materialize, table


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    journals = table(spark, sf, "journals")
    classes = materialize(venue_classes(journals, "id", "display_name", ("issn", "eissn")))
    d = link_entities(journals, table(spark, sf, "openalex_cache"), left_classes=classes)
    return d.select(F.col("left_id").alias("journal_id"), F.col("right_id").alias("openalex_cache_id"), "score", "confidence")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_links(spark, sf).select("journal_id", "openalex_cache_id")


def _truths(spark: SparkSession, sf: str) -> DataFrame:
    journals = table(spark, sf, "journals")
    return field_truths(journals, materialize(venue_classes(journals, "id", "display_name", ("issn", "eissn"))))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivors(_truths(spark, sf))


def p4_truths(spark: SparkSession, sf: str) -> DataFrame:
    return judged_true(_truths(spark, sf))


def _names(spark: SparkSession, sf: str) -> tuple[list[tuple[DataFrame, str]], DataFrame]:
    bib = table(spark, sf, "bibtex_entries")
    known = table(spark, sf, "venue_acronyms").select("acronym", F.col("canonical").alias("name"))
    return [(bib, "journal_name"), (bib, "booktitle"), (table(spark, sf, "journal_names"), "name")], known


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return link_variants(*_names(spark, sf))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    return variant_classes(*_names(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    d = mapped_entries(table(spark, sf, "bibtex_entries"), "entry_id", "journal_name", table(spark, sf, "venue_acronyms"), table(spark, sf, "venue_acronym_variants"))
    return d.select("entry_id", F.col("ref").alias("venue_acronym_id"))


def p7_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    bib = table(spark, sf, "bibtex_entries")
    m = map_values(bib, "journal_name", table(spark, sf, "venue_acronyms"), table(spark, sf, "venue_acronym_variants"))
    return bib.groupBy("journal_name").agg(F.count("*").alias("entries")).join(m.where("ref is null"), F.col("journal_name") == F.col("value")).select("journal_name", "entries")


def p8_assignments(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf, "documents"))
    return container_assignments(pack_bins(sizes, table(spark, sf, "container_specs")))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf, "documents"))
    return packing_report(pack_bins(sizes, table(spark, sf, "container_specs")))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf, "documents"), keep=("source",))
    return mix_sources(sizes, table(spark, sf, "mix_targets"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(p9_mix(spark, sf), table(spark, sf, "mix_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p10_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents")).groupBy("reason").agg(F.count("*").alias("texts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p4_found": p4_found,
    "p4_truths": p4_truths,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_assignments": p8_assignments,
    "p8_report": p8_report,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_reasons": p10_reasons,
}

ORACLE: dict[str, str] = {}
