"""Queries of records, retractions, tallies and scalar functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.functions import dates as dt
from periodiq.functions import identifiers as ids
from periodiq.functions import nested as ns
from periodiq.functions import numbers as nm
from periodiq.operators import matching, records
from periodiq.operators.strict_load import strict_load
from periodiq.plans.lookup_queries import _RESULTS, _results
from periodiq.plans.reference_queries import _NORMAL, _NOTICES, as_of
from periodiq.session import table
from periodiq.streaming.ingest import mapped_status, retry_set

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL under its function's name."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# ---- retractions

_ARTICLES = _NOTICES.replace("fs[10] AS nature", "fs[9] AS doi, fs[10] AS nature") + """,
a AS (SELECT lower(trim(doi)) AS doi, strftime(retraction_date, '%Y-%m-%d') AS retraction_date, coalesce(nullif(trim(nature), ''), 'Retraction') AS nature, nullif(trim(reason), '') AS reason, retraction_date + INTERVAL 8760 HOUR AS expires_at
  FROM notices n WHERE trim(doi) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(doi)) ORDER BY n.retraction_date DESC NULLS LAST, line_id DESC) = 1)"""


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return records.retraction_records(strict_load(table(spark, sf, "retraction_watch")))


@query(f"WITH {_ARTICLES} SELECT doi, retraction_date, nature, reason, expires_at FROM a")
def retraction_records(spark: SparkSession, sf: str) -> DataFrame:
    return _articles(spark, sf)


@query(f"WITH {_ARTICLES} SELECT entry_id, a.doi IS NOT NULL AS is_retracted, nature FROM bibtex_entries e LEFT JOIN a ON lower(trim(e.doi)) = a.doi")
def entry_retractions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select("entry_id", "doi")
    return records.retraction_status(d, "doi", _articles(spark, sf)).select("entry_id", "is_retracted", "nature")


@query(f"WITH {_NOTICES} SELECT venue, (SELECT string_agg(x, '|') FROM unnest(list_slice(list_sort(list_distinct(list(publisher))), 1, 10)) AS t(x)) AS publishers, count(*) AS n FROM notices WHERE publisher <> '' GROUP BY venue".replace("(SELECT string_agg(x, '|') FROM unnest(list_slice(list_sort(list_distinct(list(publisher))), 1, 10)) AS t(x))", "array_to_string(list_slice(list_sort(list_distinct(list(publisher))), 1, 10), '|')"))
def venue_metadata(spark: SparkSession, sf: str) -> DataFrame:
    d = strict_load(table(spark, sf, "retraction_watch")).where("publisher <> ''")
    d = d.groupBy(F.lower(F.trim(F.regexp_replace("journal", r"\s+", " "))).alias("venue")).agg(records.bounded_set(F.col("publisher"), 10).alias("p"), F.count("*").alias("n"))
    return d.select("venue", F.array_join("p", "|").alias("publishers"), "n")


# ---- metrics


@query("""SELECT id, round(recent_publications / 5.0::DOUBLE, 6) AS recent_rate, round((total_publications - recent_publications)::DOUBLE / greatest(1, last_publication_year - first_publication_year + 1 - 5), 6) AS earlier_rate FROM openalex_cache
WHERE recent_publications / 5.0::DOUBLE > 0.5::DOUBLE * (total_publications - recent_publications)::DOUBLE / greatest(1, last_publication_year - first_publication_year + 1 - 5) AND recent_publications / 5.0::DOUBLE > 10""")
def rate_growth(spark: SparkSession, sf: str) -> DataFrame:
    d = records.rate_growth(table(spark, sf, "openalex_cache"), "recent_publications", "total_publications", "first_publication_year", "last_publication_year", 0.5, 10)
    return d.select("id", F.round("recent_rate", 6).alias("recent_rate"), F.round("earlier_rate", 6).alias("earlier_rate"))


@query(f"""WITH j AS (SELECT lower(trim(journal_name)) AS venue, TRY_CAST(trim(pub_year) AS INT) AS y, {_NORMAL.format(c='issn')} AS issn FROM bibtex_entries WHERE journal_name IS NOT NULL)
SELECT venue, count(*) AS entries, count(DISTINCT y) AS years, min(y) AS first_year, max(y) AS last_year, min(issn) AS issn FROM j WHERE y BETWEEN 1900 AND 2100 GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT y) >= 3""")
def journal_series(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").where("journal_name is not null").select(F.lower(F.trim("journal_name")).alias("venue"), dt.plausible_year(F.col("pub_year")).alias("y"), ids.normal_issn(F.col("issn")).alias("issn")).where("y is not null")
    # FLT-13: support; AGG-05: the least serial number of the group
    return d.groupBy("venue").agg(F.count("*").alias("entries"), F.count_distinct("y").alias("years"), F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.min("issn").alias("issn")).where("entries >= 20 and years >= 3")


@query("SELECT bib_file, count(*) FILTER (WHERE state = 'assessed') AS assessed, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state IS NULL OR state NOT IN ('assessed', 'pending')) AS other FROM bibtex_entries GROUP BY 1")
def status_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return records.tallies(table(spark, sf, "bibtex_entries"), "bib_file", "state", ("assessed", "pending"))


@query("SELECT s.name AS source_name, s.source_type, count(j.id) AS listings, max(j.updated_at) AS last_update, CASE WHEN count(j.id) = 0 THEN 'empty' ELSE 'loaded' END AS state FROM data_sources s LEFT JOIN journals j ON j.source_name = s.name GROUP BY 1, 2")
def source_states(spark: SparkSession, sf: str) -> DataFrame:
    return records.source_status(table(spark, sf, "data_sources"), table(spark, sf, "journals"))


@query("SELECT DISTINCT source_name FROM journals WHERE source_name IS NOT NULL")
def source_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").select("source_name").where("source_name is not null").distinct()  # SET-08


@query("SELECT user_id, year(ts) AS year, count(*) AS n FROM events GROUP BY 1, 2")
def works_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.year("ts").alias("year")).agg(F.count("*").alias("n"))  # SRC-22


@query(f"""WITH t AS (SELECT 1 AS rank, {_NORMAL.format(c='issn')} AS key, id, total_publications FROM openalex_cache UNION ALL SELECT 2, {_NORMAL.format(c='issn_l')}, id, total_publications FROM openalex_cache UNION ALL SELECT 3, lower(trim(display_name)), id, total_publications FROM openalex_cache),
m AS (SELECT rank, key, min(id) AS id FROM t WHERE key IS NOT NULL AND key <> '' GROUP BY 1, 2),
q AS (SELECT id AS jid, 1 AS rank, {_NORMAL.format(c='issn')} AS key FROM journals UNION ALL SELECT id, 2, {_NORMAL.format(c='eissn')} FROM journals UNION ALL SELECT id, 3, lower(trim(display_name)) FROM journals),
h AS (SELECT jid, m.id, m.rank FROM q JOIN m ON q.rank = m.rank AND q.key = m.key QUALIFY row_number() OVER (PARTITION BY jid ORDER BY m.rank, m.id) = 1)
SELECT h.jid AS journal_id, h.id AS openalex_id, h.rank, o.total_publications FROM h JOIN openalex_cache o ON o.id = h.id""")
def enriched_listings(spark: SparkSession, sf: str) -> DataFrame:
    # SRC-21, SRC-23, SRC-24, SRC-26, SRC-27: a snapshot table in place of the service, found by number, electronic number, then name
    j, o = table(spark, sf, "journals"), table(spark, sf, "openalex_cache")
    name = F.lower(F.trim("display_name"))
    q = matching.key_rows(j, "id", [(1, "issn", ids.normal_issn(F.col("issn"))), (2, "eissn", ids.normal_issn(F.col("eissn"))), (3, "name", name)])
    t = matching.key_rows(o, "id", [(1, "issn", ids.normal_issn(F.col("issn"))), (2, "eissn", ids.normal_issn(F.col("issn_l"))), (3, "name", name)])
    m = matching.cascade_match(q, t).select(F.col("query_id").alias("journal_id"), F.col("target_id").alias("openalex_id"), "rank")
    return m.join(o.select(F.col("id").alias("openalex_id"), "total_publications"), "openalex_id")


# ---- records and reports


@query("SELECT entry_id, bib_file, journal_name, NULL::VARCHAR AS assessment, NULL::VARCHAR AS confidence FROM bibtex_entries WHERE state IS DISTINCT FROM 'assessed'")
def unassessed_records(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").where("not state <=> 'assessed'").select("entry_id", "bib_file", "journal_name")
    return records.unassessed(d, ("assessment", "confidence"))


@query(f"""WITH {_RESULTS}, v AS (SELECT venue, verdict, count(*) AS n FROM res WHERE verdict IS NOT NULL GROUP BY 1, 2)
SELECT venue, string_agg(verdict || '=' || n, ';' ORDER BY verdict) AS votes, count(*) = 2 AS conflict FROM v GROUP BY 1""")
def assessed_records(spark: SparkSession, sf: str) -> DataFrame:
    # verdicts are counted before they are gathered, so an array holds one cell per verdict of a venue
    c = _results(spark, sf).where("verdict is not null").groupBy("venue", "verdict").agg(F.count("*").alias("n"))
    d = c.groupBy("venue").agg(F.array_sort(F.collect_list(F.struct("verdict", "n"))).alias("r"))
    return d.select("venue", F.array_join(F.transform("r", lambda x: F.concat_ws("=", x["verdict"], x["n"])), ";").alias("votes"), records.conflicting(F.col("r")).alias("conflict"))


@query(f"""WITH {_RESULTS} SELECT id, upper(coalesce(venue, '?')) || '/' || coalesce(upper(verdict), 'None') AS label, round(confidence * 1000.0, 4) AS execution_time_ms, evidence AS evidence_type FROM res""")
def timed_results(spark: SparkSession, sf: str) -> DataFrame:
    evidence = table(spark, sf, "data_sources").select(F.col("name").alias("source"), F.col("source_type").alias("evidence_type"))
    d = records.timed(_results(spark, sf).drop("evidence"), "confidence", "source_name", evidence)
    return d.select("id", F.concat_ws("/", F.upper("venue"), records.label(F.col("verdict"))).alias("label"), F.round("execution_time_ms", 4).alias("execution_time_ms"), "evidence_type")


@query(f"""WITH {_RESULTS} SELECT id, coalesce(venue, '?') || ': ' || coalesce(upper(verdict), 'None') || ' (' || printf('%.2f', confidence) || ')' || chr(10) || '- ' || source_name || chr(10) || '- ' || evidence AS report FROM res""")
def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = _results(spark, sf)
    return d.select("id", records.report_text(F.col("venue"), F.col("verdict"), F.col("confidence"), F.array("source_name", "evidence")).alias("report"))


@query("SELECT count(*) || ' entries, ' || count(*) FILTER (WHERE state = 'assessed') || ' predatory, ' || count(*) FILTER (WHERE doi IS NULL) || ' retracted' AS summary, CASE WHEN count(*) FILTER (WHERE state = 'assessed') > 0 OR count(*) FILTER (WHERE doi IS NULL) > 0 THEN 1 ELSE 0 END AS exit_code FROM bibtex_entries")
def bibliography_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select(F.when(F.col("state") == "assessed", "predatory").alias("verdict"), F.col("doi").isNull().alias("gone"))
    return records.summary(d, "verdict", "gone")


@query(f"""SELECT id, coalesce({_NORMAL.format(c='issn')}, {_NORMAL.format(c='eissn')}, 'none') AS issn, coalesce(issn, eissn, publisher) AS first_given FROM journals""")
def enriched_numbers(spark: SparkSession, sf: str) -> DataFrame:
    typed = F.filter(F.array(F.struct(F.lit("electronic").alias("kind"), F.col("eissn").alias("value")), F.struct(F.lit("print").alias("kind"), F.col("issn").alias("value"))), lambda t: t["value"].isNotNull())
    d = table(spark, sf, "journals")
    own = F.coalesce(ids.normal_issn(F.col("issn")), ids.normal_issn(F.col("eissn")), F.lit("none"))
    return d.select("id", own.alias("issn"), records.enriched_issn(F.lit(None).cast("string"), typed, F.array_compact(F.array("eissn", "publisher")), "print").alias("first_given"))


@query("SELECT venue_acronym_id, string_agg(id || ':' || variant, '|' ORDER BY id, variant) AS candidates FROM venue_acronym_variants GROUP BY 1")
def candidate_summaries(spark: SparkSession, sf: str) -> DataFrame:
    d = records.candidate_summary(table(spark, sf, "venue_acronym_variants"), "venue_acronym_id", "id", "variant")
    return d.select("venue_acronym_id", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["id"], x["variant"])), "|").alias("candidates"))


@query("SELECT event_id, to_json({'k': CAST(json_extract(props, '$.k') AS INT), 'kind': event_type}) AS payload FROM events")
def merged_payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select("event_id", records.with_entry(ns.decode(F.col("props"), "k int"), kind=F.col("event_type")).alias("p"))
    return d.select("event_id", F.to_json("p").alias("payload"))


# ---- scalar functions over whole tables


@query("""SELECT id, 2025 - year(fetched_at) <= 1 AS recent, fetched_at + INTERVAL 720 HOUR AS expires, floor((epoch(TIMESTAMP '2025-01-01') - epoch(fetched_at)) / 86400) > 30 IS TRUE OR fetched_at IS NULL AS stale, coalesce(greatest(1, last_publication_year - first_publication_year + 1), 1)::INT AS years,
  strftime(fetched_at, '%Y-%m-%d') AS iso FROM openalex_cache""")
def scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("fetched_at")
    parts = F.array(F.year(at), F.month(at), F.dayofmonth(at))
    return table(spark, sf, "openalex_cache").select("id", dt.recent_by_year(at, as_of(), 1).alias("recent"), dt.expiry(at, 720).alias("expires"), dt.is_stale(at, as_of(), 30).alias("stale"), dt.years_active(F.col("first_publication_year"), F.col("last_publication_year")).alias("years"), dt.date_parts_iso(parts).alias("iso"))


_INT = "CASE WHEN regexp_full_match(trim(pub_year), '[+-]?[0-9]+') THEN TRY_CAST(trim(pub_year) AS BIGINT) END"


@query(f"SELECT entry_id, CASE WHEN {_INT} BETWEEN 1900 AND 2100 THEN CAST({_INT} AS INT) END AS year, {_INT} AS number FROM bibtex_entries")
def scalar_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibtex_entries").select("entry_id", dt.plausible_year(F.col("pub_year")).alias("year"), nm.lenient_int(F.col("pub_year")).alias("number"))


@query("""SELECT id, least(greatest(recent_publications / 100.0::DOUBLE, 0), 1) AS clamped, round(CASE WHEN total_publications = 0 OR total_publications IS NULL OR recent_publications IS NULL THEN 0 ELSE recent_publications::DOUBLE / total_publications END, 6) AS ratio,
  round(CASE WHEN greatest(recent_publications, cited_by_count) <> 0 THEN least(recent_publications, cited_by_count)::DOUBLE / greatest(recent_publications, cited_by_count) END, 6) AS symmetric, CASE source_type WHEN 'journal' THEN 1.0 WHEN 'conference' THEN 0.9 ELSE 0.5 END::DOUBLE AS base,
  CASE WHEN total_publications < 50 THEN 'very small' WHEN total_publications < 10000 THEN 'small to medium' WHEN total_publications IS NOT NULL THEN 'large' END AS size, round(CASE WHEN total_publications >= 1000 THEN least(0.8 * 1.1, 1) WHEN total_publications < 50 THEN greatest(0.8 * 0.8, 0.1) ELSE 0.8 END::DOUBLE, 6) AS adjusted,
  printf('%.4f', total_publications / 8.0::DOUBLE) AS text, coalesce(CASE WHEN recent_publications > 10 THEN 0.25::DOUBLE END, CASE WHEN total_publications > 10 THEN 0.5::DOUBLE END, 0) * 100 AS coverage FROM openalex_cache WHERE total_publications IS NOT NULL AND recent_publications IS NOT NULL AND cited_by_count IS NOT NULL""")
def scalar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    d = table(spark, sf, "openalex_cache").where("total_publications is not null and recent_publications is not null and cited_by_count is not null")
    return d.select(
        "id", nm.clamp(c("recent_publications") / 100.0, 0.0, 1.0).alias("clamped"), F.round(nm.guarded_ratio(c("recent_publications"), c("total_publications")), 6).alias("ratio"),
        F.round(nm.symmetric_ratio(c("recent_publications"), c("cited_by_count")), 6).alias("symmetric"), nm.by_label(c("source_type"), {"journal": 1.0, "conference": 0.9}, 0.5).alias("base"),
        nm.size_class(c("total_publications")).alias("size"), F.round(nm.by_volume(F.lit(0.8), c("total_publications")), 6).alias("adjusted"), nm.four_decimals(c("total_publications") / 8.0).alias("text"),
        nm.percent_coverage(F.when(c("recent_publications") > 10, 0.25), F.when(c("total_publications") > 10, 0.5)).alias("coverage"),
    )


@query("""SELECT event_id, CASE WHEN event_type <> '' THEN '["' || event_type || '"]' END AS encoded, CAST(json_extract(props, '$.k') AS BIGINT) AS counted, 'event: ' || event_type AS tagged, event_type || '|' || CAST(user_id AS VARCHAR) AS reasons, least(power(2, user_id % 8), 60)::DOUBLE AS wait FROM events""")
def scalar_nested(spark: SparkSession, sf: str) -> DataFrame:
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        "event_id", ns.encode(F.filter(F.array(t), lambda x: x != "")).alias("encoded"), ns.polymorphic_count(F.col("props"), ("k",)).alias("counted"), F.get(ns.tagged(F.array(t), "event"), F.lit(0)).alias("tagged"),
        F.array_join(ns.joined_reasons(F.array(t), F.array(u)), "|").alias("reasons"), nm.backoff_seconds(F.col("user_id") % 8).alias("wait"),
    )


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(y || '=' || n, ';' ORDER BY y) AS by_year FROM y GROUP BY 1""")
def scalar_maps(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    # through pairs and through JSON text and back
    d = y.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.array(F.col("y").cast("bigint"), "n"))).alias("pairs"))
    m = ns.int_keys(F.to_json(ns.pairs_to_map(F.col("pairs"))))
    return d.select("o_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("by_year"))


_FOUND = r"regexp_extract({c}, '(?:^|[^0-9])(\d{{4}}[\s\-‐-―]?\d{{3}}[\dXx])(?:[^0-9A-Za-z]|$)', 1)"
_DIGITS = "upper(regexp_replace({c}, '[^0-9Xx]', '', 'g'))"
_FILLED = f"CASE WHEN regexp_full_match({_DIGITS}, '\\d{{{{6}}}}[\\dX]') THEN '0' || {_DIGITS} ELSE {_DIGITS} END"
_SUM = "list_sum(list_transform(range(1, 9), lambda i: (CASE WHEN d[i:i] = 'X' THEN 10 ELSE CAST(d[i:i] AS INT) END) * (9 - i))) % 11 = 0"


@query(f"""WITH d AS (SELECT entry_id, issn, doi, journal_name, entry_type, url, {_FILLED.format(c='issn')} AS d FROM bibtex_entries)
SELECT entry_id, upper(nullif({_FOUND.format(c='issn')}, ''))[1:4] || '-' || right(upper(nullif({_FOUND.format(c='issn')}, '')), 4) AS found, CASE WHEN regexp_full_match(d, '\\d{{7}}[\\dX]') AND {_SUM} THEN d[1:4] || '-' || d[5:8] END AS checked,
  left(sha256(coalesce(entry_type, '') || '::' || lower(coalesce(journal_name, ''))), 32) AS dedupe_key, nullif(regexp_extract(doi, '\\b10\\.\\d{{4,}}\\S*\\b'), '') AS first_doi, CASE WHEN starts_with(url, 'https://') THEN string_split(url[9:], '/')[1] END AS slug FROM d""")
def scalar_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "bibtex_entries").select(
        "entry_id", ids.issn_in(c("issn")).alias("found"), ids.checked_issn(c("issn")).alias("checked"), ids.dedupe_key(c("entry_type"), c("journal_name")).alias("dedupe_key"), ids.first_doi(c("doi")).alias("first_doi"),
        ids.series_slug(c("url"), "https://").alias("slug"),
    )


@query("SELECT c_custkey, regexp_full_match(m, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS mail FROM (SELECT c_custkey, replace(lower(c_name), '#', '@') || '.org' AS m FROM customer)")
def scalar_mails(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", ids.is_email(F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("@")), F.lit(".org"))).alias("mail"))


@query("SELECT entry_id, state FROM bibtex_entries WHERE state IN ('parse_error', 'no_venue')")
def retried_entries(spark: SparkSession, sf: str) -> DataFrame:
    return retry_set(table(spark, sf, "bibtex_entries").select("entry_id", "state"), "state", ("parse_error", "no_venue"))


@query("SELECT event_id, CASE WHEN value > 90 THEN 'timeout' WHEN user_id % 600 = 429 THEN 'rate_limited' WHEN user_id % 600 = 404 THEN 'not_found' WHEN user_id % 600 >= 400 THEN 'error' ELSE 'found' END AS status FROM events")
def mapped_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", mapped_status(F.col("value"), F.col("user_id") % 600, 90.0).alias("status"))


@query("SELECT name, coalesce(trim(base_url), '') <> '' AS linked FROM data_sources WHERE coalesce(trim(base_url), '') <> ''")
def enabled_sources(spark: SparkSession, sf: str) -> DataFrame:
    return records.enabled(table(spark, sf, "data_sources"), F.col("base_url")).select("name", F.lit(True).alias("linked"))


@query(f"WITH {_RESULTS}, v AS (SELECT venue, min(verdict) AS verdict FROM res GROUP BY 1) SELECT e.entry_id, v.verdict FROM bibtex_entries e LEFT JOIN v ON lower(trim(e.journal_name)) = v.venue")
def memoized_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = _results(spark, sf).groupBy("venue").agg(F.min("verdict").alias("verdict"))
    return records.memoized(table(spark, sf, "bibtex_entries").select("entry_id", "journal_name"), "journal_name", v).select("entry_id", "verdict")


@query(f"WITH {_RESULTS} SELECT id, source_name <> 'doaj' AND (verdict IS NULL OR confidence < 0.3) AS again FROM res")
def fallback_results(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("id", records.needs_fallback(F.col("source_name") == "doaj", F.col("verdict"), F.col("confidence"), F.lit(1)).alias("again"))
