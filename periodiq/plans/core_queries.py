"""Queries of the general problems over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.operators.multivalue import split_values
from periodiq.operators.snapshot_diff import url_snapshot_changes
from periodiq.operators.strict_load import rejected_records, strict_load
from periodiq.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    d = url_snapshot_changes(table(spark, sf, "journal_urls"))
    return d.select("snapshot_no", F.col("id").alias("url_id"), "change_kind")


def p1_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = url_snapshot_changes(table(spark, sf, "journal_urls")).where("change_kind = 'changed'")
    return d.select("snapshot_no", F.explode("changed_fields").alias("field_name")).groupBy("snapshot_no", "field_name").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejected_records(table(spark, sf, "retraction_watch")).select("line_id", "reason")


def p2_loaded(spark: SparkSession, sf: str) -> DataFrame:
    d = strict_load(table(spark, sf, "retraction_watch"))
    return d.select(F.col("_offset").alias("line_id"), "record_id", "journal", "publisher", "retraction_date", "retraction_nature")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_values(table(spark, sf, "bibtex_entries")).select("entry_id", "field_name", "pos", "item")


def p5_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return split_values(table(spark, sf, "bibtex_entries")).groupBy("field_name", "error").agg(F.count_distinct("entry_id").alias("fields"), F.count("*").alias("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_changed_fields": p1_changed_fields,
    "p2_found": p2_found,
    "p2_loaded": p2_loaded,
    "p5_found": p5_found,
    "p5_flagged": p5_flagged,
}

_P1_ROWS = r"""
WITH valid AS (
  SELECT snapshot_no, id,
    nfc_normalize(regexp_replace(normalized_name, '^[\s\pZ\p{Cc}]+|[\s\pZ\p{Cc}]+$', '', 'g')) AS name,
    regexp_replace(nfc_normalize(regexp_replace(url, '^[\s\pZ\p{Cc}]+|[\s\pZ\p{Cc}]+$', '', 'g')), '/$', '') AS u,
    date_trunc('second', last_seen_at) AS seen
  FROM journal_urls
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, id ORDER BY delivered_at DESC NULLS LAST) = 1
), norm AS (
  SELECT snapshot_no, id, name, seen,
    lower(regexp_extract(u, '^(?i)[a-z][a-z0-9+.-]*://[^/?#]*')) || u[length(regexp_extract(u, '^(?i)[a-z][a-z0-9+.-]*://[^/?#]*')) + 1:] AS u
  FROM valid
), span AS (SELECT min(snapshot_no) AS lo, max(snapshot_no) AS hi FROM journal_urls),
pairs AS (
  SELECT coalesce(a.snapshot_no, b.snapshot_no + 1) AS snapshot_no, coalesce(a.id, b.id) AS url_id,
    CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    a.name IS DISTINCT FROM b.name AS d_name, a.u IS DISTINCT FROM b.u AS d_u, a.seen IS DISTINCT FROM b.seen AS d_seen
  FROM norm a FULL JOIN norm b ON a.id = b.id AND a.snapshot_no = b.snapshot_no + 1
), diffs AS (
  SELECT pairs.* FROM pairs, span
  WHERE snapshot_no > lo AND snapshot_no <= hi AND (change_kind <> 'changed' OR d_name OR d_u OR d_seen)
)
"""

_P2_PARSED = r"""
WITH lines AS (SELECT line_id, regexp_replace(raw_line, '\r?\n?$', '') AS t FROM retraction_watch),
q AS (SELECT line_id, t, coalesce(regexp_full_match(t, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'), false) AS ok FROM lines),
f AS (SELECT line_id, t, ok, CASE WHEN ok THEN regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) END AS fs FROM q),
v AS (
  SELECT line_id, t, ok, list_transform(fs, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS fs FROM f
), w AS (
  SELECT *, fs[7] AS d,
    regexp_full_match(fs[7], '\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}') AND try_strptime(fs[7], '%m/%d/%Y %H:%M') IS NOT NULL AS dated,
    regexp_matches(fs[3], '\pL') AS lettered
  FROM v
)
"""

ORACLE: dict[str, str] = {
    "p1_found": _P1_ROWS + "SELECT CAST(snapshot_no AS INT) AS snapshot_no, url_id, change_kind FROM diffs",
    "p1_changed_fields": _P1_ROWS
    + """, cells AS (
  SELECT snapshot_no, unnest([CASE WHEN d_name THEN 'normalized_name' END, CASE WHEN d_u THEN 'url' END, CASE WHEN d_seen THEN 'last_seen_at' END]) AS field_name
  FROM diffs WHERE change_kind = 'changed')
SELECT CAST(snapshot_no AS INT) AS snapshot_no, field_name, count(*) AS n FROM cells WHERE field_name IS NOT NULL GROUP BY ALL""",
    "p2_found": _P2_PARSED
    + """SELECT line_id, CASE WHEN t IS NULL THEN 'column_count' WHEN NOT ok THEN 'quoting' WHEN len(fs) <> 11 THEN 'column_count' ELSE 'bad_value' END AS reason
FROM w WHERE NOT coalesce(ok AND len(fs) = 11 AND lettered AND (d IN ('', '0') OR dated), false)""",
    "p2_loaded": _P2_PARSED
    + """SELECT line_id, fs[1] AS record_id, fs[3] AS journal, fs[4] AS publisher,
  CASE WHEN dated THEN try_strptime(d, '%m/%d/%Y %H:%M') END AS retraction_date, fs[10] AS retraction_nature
FROM w WHERE coalesce(ok AND len(fs) = 11 AND lettered AND (d IN ('', '0') OR dated), false)""",
}
