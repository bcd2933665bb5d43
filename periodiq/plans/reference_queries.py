"""Queries of the engine's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.functions import identifiers as ids
from periodiq.functions import text as tx
from periodiq.operators import keyed, matching, rollups
from periodiq.operators.strict_load import strict_load
from periodiq.session import table

AS_OF = "2025-01-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


_BASIC = "replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def _basic(c: str) -> str:
    return _BASIC.format(c=c)


# ---- text


@query(
    f"""SELECT id, trim(regexp_replace({_basic("regexp_replace(display_name, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS plain FROM journals"""
)
def html_plain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").select("id", tx.strip_html(F.col("display_name")).alias("plain"))


def _clean_sql(c: str) -> str:
    s = f"regexp_replace({_basic(c)}, '\\b(\\d{{4}})-?(\\d{{3}}[\\dX])\\b', '', 'g')"
    s = f"regexp_replace({s}, '\\b10\\.\\d{{4,}}[^\\s]*', '', 'g')"
    for _ in range(4):
        s = f"regexp_replace({s}, '\\{{([^{{}}]*)\\}}', '\\1', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\[[^\\]]*\\]', '', 'g'), '\\([^)]*\\)', '', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\-&().,:]', ' ', 'g')"
    for p, to in (("\\s+", " "), ("\\s*:\\s*", ": "), ("\\s*-\\s*", " - "), ("\\s*&\\s*", " & ")):
        s = f"regexp_replace({s}, '{p}', '{to}', 'g')"
    return f"trim({s})"


@query(f"SELECT DISTINCT name, {_clean_sql('name')} AS cleaned FROM journal_names")
def cleaned_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journal_names").select("name").distinct().select("name", tx.clean_name(F.col("name")).alias("cleaned"))


_ACR = ", ".join(f"'{a}'" for a in tx.KNOWN_ACRONYMS)
_SMALL = ", ".join(f"'{a}'" for a in tx.SMALL_WORDS)


@query(
    f"""SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(display_name, '\\s+'), lambda w: w <> ''),
  lambda w, i: CASE WHEN upper(w) IN ({_ACR}) THEN upper(w) WHEN i > 1 AND lower(w) IN ({_SMALL}) THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') AS cased FROM journals"""
)
def cased_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").select("id", tx.normal_case(F.col("display_name")).alias("cased"))


_ORGS = rf"^(?:{'|'.join(sorted(tx.ORGANISERS, key=len, reverse=True))})\s+"
_STOP = ", ".join(f"'{a}'" for a in tx.STOP_WORDS)


@query(
    f"""SELECT id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({_basic("display_name")}), '{_ORGS}', ''), '-', ' '), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '),
  lambda w: w <> '' AND w NOT IN ({_STOP})), ' ') AS form FROM journals"""
)
def comparison_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").select("id", tx.comparison_form(F.col("display_name")).alias("form"))


def _series_sql(c: str) -> str:
    words = f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
    edge = tx.EDGE.replace("'", "''")
    bare = f"regexp_replace(lower(w), '{edge}', '', 'g')"
    counts = f"regexp_matches({bare}, '{tx.EDITION}')"
    kept = f"CASE WHEN len(list_filter({words}, lambda w: {counts})) > 0 THEN list_filter({words}, lambda w: NOT {counts} AND {bare} NOT IN ('edition', 'ed')) ELSE {words} END"
    return f"trim(regexp_replace(regexp_replace(array_to_string({kept}, ' '), '{tx.FRAME}', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT DISTINCT booktitle FROM bibtex_entries WHERE booktitle IS NOT NULL), s AS (SELECT booktitle, {_series_sql('booktitle')} AS s FROM d)
SELECT booktitle, CASE WHEN s <> booktitle AND s <> '' THEN s END AS series FROM s"""
)
def conference_series(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select("booktitle").where("booktitle is not null").distinct()
    return d.select("booktitle", tx.conference_series(F.col("booktitle")).alias("series"))


@query(
    f"""WITH s AS (SELECT id, canonical AS c, {_series_sql('canonical')} AS s, array_to_string(list_transform(string_split(canonical, ' '), lambda w: CASE WHEN w = 'Journal' THEN 'Jrnl' WHEN w = 'International' THEN 'Intl' WHEN w = 'international' THEN 'intl.' ELSE w END), ' ') AS a FROM venue_acronyms)
SELECT id, array_to_string(list_filter([CASE WHEN starts_with(lower(c), 'journal of ') THEN trim(c[12:]) END, CASE WHEN starts_with(lower(c), 'the ') THEN trim(c[5:]) END,
  CASE WHEN starts_with(lower(c), 'proceedings of ') THEN trim(c[16:]) END, CASE WHEN s <> c AND s <> '' THEN s END, CASE WHEN a <> c THEN a END], lambda x: x IS NOT NULL AND x <> ''), '|') AS aliases FROM s"""
)
def aliases_of_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "venue_acronyms").select("id", F.array_join(tx.name_aliases(F.col("canonical")), "|").alias("aliases"))


_UPPER = "length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
_ACRONYMS = (
    "list_filter(list_transform(regexp_extract_all({c}, '\\(([^)]+)\\)', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '" + tx.NOT_ACRONYM + "') AND regexp_matches(x, '^[A-Z][A-Za-z0-9''\\-]{{1,19}}$') "
    "AND length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) * 2 >= length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')))"
)


@query(
    f"""WITH d AS (SELECT DISTINCT variant FROM venue_acronym_variants), a AS (SELECT variant, {_ACRONYMS.format(c='variant')} AS acr FROM d),
m AS (SELECT variant, acr, trim(regexp_replace(CASE WHEN position('(' || acr[1] IN variant) > 0 THEN variant[1:position('(' || acr[1] IN variant) - 1] ELSE variant END, '^[''"\\s]+|[''"\\s]+$', '', 'g')) AS b FROM a)
SELECT variant, acr[1] AS acronym, CASE WHEN length(b) > 2 * length(acr[1]) THEN b END AS meaning FROM m WHERE len(acr) > 0"""
)
def acronym_meanings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "venue_acronym_variants").select("variant").distinct().where(F.size(tx.parenthesised_acronyms(F.col("variant"))) > 0)
    return d.select("variant", F.get(tx.parenthesised_acronyms(F.col("variant")), F.lit(0)).alias("acronym"), tx.acronym_meaning(F.col("variant")).alias("meaning"))


@query(
    """WITH d AS (SELECT DISTINCT journal_name AS n FROM bibtex_entries WHERE journal_name IS NOT NULL), u AS (SELECT n, replace(replace(replace(n, '&', ''), '''', ''), '-', '') AS t FROM d)
SELECT n AS journal_name FROM u WHERE length(n) BETWEEN 2 AND 10 AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) > 0
  AND length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) * 2 >= length(regexp_replace(t, '[^\\p{L}]', '', 'g'))"""
)
def standalone_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibtex_entries").select("journal_name").where("journal_name is not null").distinct().where(tx.is_standalone_acronym(F.col("journal_name")))


@query(
    """WITH w AS (SELECT id, display_name AS a, publisher AS b, list_distinct(list_filter(regexp_split_to_array(lower(display_name), '\\s+'), lambda w: w <> '')) AS x,
  list_distinct(list_filter(regexp_split_to_array(lower(publisher), '\\s+'), lambda w: w <> '')) AS y, list_distinct(regexp_extract_all(lower(display_name), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(publisher), '[a-z0-9]+')) AS q
  FROM openalex_cache WHERE display_name IS NOT NULL AND publisher IS NOT NULL)
SELECT id, round(CASE WHEN a = b THEN 1.0 WHEN len(x) + len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard,
  round(CASE WHEN least(len(p), len(q)) = 0 THEN 0.0 ELSE len(list_intersect(p, q))::DOUBLE / least(len(p), len(q)) END, 6) AS overlap FROM w"""
)
def name_similarities(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "openalex_cache").where("display_name is not null and publisher is not null")
    a, b = F.col("display_name"), F.col("publisher")
    return d.select("id", F.round(tx.jaccard(a, b), 6).alias("jaccard"), F.round(tx.token_overlap(a, b), 6).alias("overlap"))


@query(
    r"""WITH d AS (SELECT lower(entry_type) AS t, lower(coalesce(journal_name, booktitle, '')) AS n FROM bibtex_entries)
SELECT CASE WHEN regexp_matches(n, '\bsymposi(um|a)\b') THEN 'symposium' WHEN regexp_matches(n, '\bworkshops?\b') THEN 'workshop'
  WHEN t IN ('inproceedings', 'conference', 'proceedings') THEN CASE WHEN NOT regexp_matches(n, '\bconference\b|\bcongress\b|\bmeeting\b') AND contains(n, 'proceedings') THEN 'proceedings' ELSE 'conference' END
  WHEN t IN ('article', 'periodical', 'suppperiodical') THEN 'journal' WHEN t IN ('book', 'inbook', 'incollection', 'booklet') THEN 'book'
  WHEN regexp_matches(n, '\bjournal\b|\btransactions\b|\bletters\b|\breview\b|\bannals\b|\bbulletin\b') THEN 'journal' ELSE 'unknown' END AS kind, count(*) AS n FROM d GROUP BY 1"""
)
def venue_kinds(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select(tx.venue_kind(F.col("entry_type"), F.coalesce("journal_name", "booktitle")).alias("kind"))
    return d.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""SELECT entry_id FROM bibtex_entries WHERE regexp_matches(concat_ws(' ', journal_name, booktitle, series, publisher, organization, url, doi), '{tx.PREPRINT}')
  OR coalesce(regexp_matches(journal_name, '(?i)preprint'), false)"""
)
def preprint_entries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries")
    fields = [F.col(c) for c in ("journal_name", "booktitle", "series", "publisher", "organization", "url", "doi")]
    return d.where(tx.is_preprint(*fields) | F.coalesce(F.col("journal_name").rlike("(?i)preprint"), F.lit(False))).select("entry_id")


# ---- identifiers

_NORMAL = "CASE WHEN regexp_full_match(upper(regexp_replace({c}, '[^0-9A-Za-z]', '', 'g')), '\\d{{7}}[0-9X]') THEN upper(regexp_replace({c}, '[^0-9A-Za-z]', '', 'g'))[1:4] || '-' || upper(regexp_replace({c}, '[^0-9A-Za-z]', '', 'g'))[5:8] END"
_CHECK = "list_sum(list_transform(range(1, 9), lambda i: (CASE WHEN replace({n}, '-', '')[i:i] = 'X' THEN 10 ELSE CAST(replace({n}, '-', '')[i:i] AS INT) END) * (9 - i))) % 11 = 0"


@query(f"""WITH n AS (SELECT id, {_NORMAL.format(c='issn')} AS n FROM journals) SELECT id, n AS issn, coalesce(CASE WHEN n IS NOT NULL THEN {_CHECK.format(n='n')} END, false) AS valid FROM n""")
def issn_checks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journals").select("id", ids.normal_issn(F.col("issn")).alias("issn"))
    return d.select("id", "issn", F.coalesce(ids.issn_checks(F.col("issn")), F.lit(False)).alias("valid"))


@query(r"""SELECT entry_id, regexp_extract(journal_name, '\b(\d{4})-?(\d{3}[\dX])\b', 1) || '-' || regexp_extract(journal_name, '\b(\d{4})-?(\d{3}[\dX])\b', 2) AS issn FROM bibtex_entries WHERE regexp_matches(journal_name, '\b(\d{4})-?(\d{3}[\dX])\b')""")
def issn_in_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibtex_entries").select("entry_id", ids.first_issn(F.col("journal_name")).alias("issn")).where("issn is not null")


@query(r"""SELECT count(*) FILTER (WHERE doi IS NOT NULL) AS given, count(*) FILTER (WHERE coalesce(regexp_full_match(trim(doi), '10\.\d{4,}/\S+'), false)) AS well_formed FROM bibtex_entries""")
def doi_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibtex_entries").agg(F.count("doi").alias("given"), F.count_if(ids.is_doi(F.col("doi"))).alias("well_formed"))


@query(r"""SELECT lower(regexp_extract(trim(url), '^(?i)[a-z][a-z0-9+.-]*://([^/?#:]+)', 1)) AS host, count(*) AS n FROM journal_urls WHERE is_active AND regexp_matches(trim(url), '^(?i)[a-z][a-z0-9+.-]*://([^/?#:]+)') GROUP BY 1""")
def active_hosts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journal_urls").where("is_active").select(ids.url_host(F.col("url")).alias("host")).where("host is not null")
    return d.groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT entry_id, md5(concat_ws('|', coalesce(bib_file, ''), coalesce(journal_name, ''), coalesce(issn, ''), coalesce(doi, ''))) AS cache_key, concat_ws('::', coalesce(bib_file, ''), coalesce(entry_key, ''), coalesce(journal_name, '')) AS record_id FROM bibtex_entries")
def entry_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "bibtex_entries").select("entry_id", ids.query_key(c("bib_file"), c("journal_name"), c("issn"), c("doi")).alias("cache_key"), ids.record_id(c("bib_file"), c("entry_key"), c("journal_name")).alias("record_id"))


# ---- joins and lookups


@query(
    """WITH n AS (SELECT journal_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names, count(DISTINCT name) AS n_names FROM journal_names WHERE journal_id IS NOT NULL GROUP BY 1)
SELECT j.id, j.display_name, s.display_name AS listed_by, s.authority_level, n.names, coalesce(n_names, 0) AS n_names FROM journals j JOIN data_sources s ON j.source_name = s.name LEFT JOIN n ON n.journal_id = j.id WHERE s.source_type = 'legitimate_list'"""
)
def listings_with_names(spark: SparkSession, sf: str) -> DataFrame:
    # children are aggregated before the join; the fixed source table is small enough for any plan
    names = table(spark, sf, "journal_names").where("journal_id is not null").groupBy("journal_id").agg(F.array_sort(F.collect_set("name")).alias("ns"))
    names = names.select("journal_id", F.array_join("ns", "|").alias("names"), F.size("ns").cast("bigint").alias("n_names"))
    s = table(spark, sf, "data_sources").where("source_type = 'legitimate_list'").select(F.col("name").alias("source_name"), F.col("display_name").alias("listed_by"), "authority_level")
    d = table(spark, sf, "journals").select("id", "display_name", "source_name").join(s, "source_name").join(names, F.col("id") == F.col("journal_id"), "left")
    return d.select("id", "display_name", "listed_by", "authority_level", "names", F.coalesce("n_names", F.lit(0)).alias("n_names"))


@query("SELECT id, display_name FROM journals WHERE id IN (SELECT journal_id FROM journal_names WHERE name ILIKE '%letters%')")
def venues_by_alias(spark: SparkSession, sf: str) -> DataFrame:
    hit = table(spark, sf, "journal_names").where(F.col("name").ilike("%letters%")).select(F.col("journal_id").alias("id"))
    return table(spark, sf, "journals").select("id", "display_name").join(hit, "id", "left_semi")


@query("SELECT id FROM journals WHERE id IN (SELECT DISTINCT journal_id FROM journal_urls WHERE journal_id IS NOT NULL)")
def venues_with_urls(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.keep_referenced(table(spark, sf, "journals").select("id"), "id", table(spark, sf, "journal_urls"), "journal_id")


@query("SELECT id FROM journals j WHERE NOT EXISTS (SELECT 1 FROM journal_names n WHERE n.journal_id = j.id)")
def venues_without_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "journal_names").select(F.col("journal_id").alias("id"))
    return table(spark, sf, "journals").select("id").join(n, "id", "left_anti")


@query(
    f"""WITH k AS (SELECT id, unnest([{_NORMAL.format(c='issn')}, {_NORMAL.format(c='eissn')}]) AS k FROM journals), b AS (SELECT entry_id, {_NORMAL.format(c='issn')} AS k FROM bibtex_entries)
SELECT b.entry_id, min(k.id) AS journal_id FROM b JOIN k USING (k) GROUP BY 1"""
)
def entries_by_issn(spark: SparkSession, sf: str) -> DataFrame:
    q = matching.key_rows(table(spark, sf, "bibtex_entries"), "entry_id", [(1, "issn", ids.normal_issn(F.col("issn")))])
    t = matching.key_rows(table(spark, sf, "journals"), "id", [(1, "issn", F.array(ids.normal_issn(F.col("issn")), ids.normal_issn(F.col("eissn"))))])
    return matching.cascade_match(q, t).select(F.col("query_id").alias("entry_id"), F.col("target_id").alias("journal_id"))


@query(
    f"""WITH t AS (SELECT 'issn' AS kind, unnest([{_NORMAL.format(c='issn')}, {_NORMAL.format(c='eissn')}]) AS key, id FROM journals UNION ALL SELECT 'name', unnest([lower(normalized_name), lower(display_name)]), id FROM journals
  UNION ALL SELECT 'alias', lower(name), journal_id FROM journal_names WHERE journal_id IS NOT NULL),
m AS (SELECT kind, key, min(id) AS target_id FROM t WHERE key IS NOT NULL AND key <> '' GROUP BY 1, 2),
q AS (SELECT entry_id, 1 AS rank, 'issn' AS kind, {_NORMAL.format(c='issn')} AS key FROM bibtex_entries UNION ALL SELECT entry_id, 2, 'name', lower(trim(journal_name)) FROM bibtex_entries UNION ALL SELECT entry_id, 3, 'alias', lower(trim(journal_name)) FROM bibtex_entries),
h AS (SELECT entry_id, rank, target_id, kind, row_number() OVER (PARTITION BY entry_id ORDER BY rank, target_id) AS rn FROM q JOIN m USING (kind, key))
SELECT e.entry_id, CASE WHEN target_id IS NULL THEN 'not_found' ELSE 'found' END AS status, target_id, kind FROM bibtex_entries e LEFT JOIN (SELECT * FROM h WHERE rn = 1) h USING (entry_id)"""
)
def cascade_lookup(spark: SparkSession, sf: str) -> DataFrame:
    bib, j = table(spark, sf, "bibtex_entries"), table(spark, sf, "journals")
    name = F.lower(F.trim(F.col("journal_name")))
    q = matching.key_rows(bib, "entry_id", [(1, "issn", ids.normal_issn(F.col("issn"))), (2, "name", name), (3, "alias", name)])
    t = matching.key_rows(j, "id", [(1, "issn", F.array(ids.normal_issn(F.col("issn")), ids.normal_issn(F.col("eissn")))), (2, "name", F.array(F.lower("normalized_name"), F.lower("display_name")))])
    t = t.unionByName(matching.key_rows(table(spark, sf, "journal_names").where("journal_id is not null"), "journal_id", [(3, "alias", F.lower("name"))]))
    d = matching.with_misses(bib, "entry_id", matching.cascade_match(q, t))
    return d.select(F.col("query_id").alias("entry_id"), "status", "target_id", "kind")


@query(
    """SELECT v.variant, a.acronym, a.canonical, a.confidence_score FROM venue_acronym_variants v JOIN venue_acronyms a ON v.venue_acronym_id = a.id WHERE a.entity_type = 'journal' AND a.confidence_score >= 0.5
QUALIFY row_number() OVER (PARTITION BY lower(v.variant) ORDER BY a.confidence_score DESC, a.id, v.id) = 1"""
)
def variants_to_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "venue_acronyms").where("entity_type = 'journal' and confidence_score >= 0.5").select(F.col("id").alias("aid"), "acronym", "canonical", "confidence_score")
    d = table(spark, sf, "venue_acronym_variants").join(a, F.col("venue_acronym_id") == F.col("aid")).withColumn("k", F.lower("variant"))
    order = F.struct((-F.col("confidence_score")).alias("a"), "aid", "id")
    return keyed.first_per_key(d, ["k"], order).select("variant", "acronym", "canonical", "confidence_score")


@query("SELECT a.acronym, a.entity_type, string_agg(v.variant, '|' ORDER BY v.variant) AS variants, count(v.id) AS n FROM venue_acronyms a LEFT JOIN venue_acronym_variants v ON v.venue_acronym_id = a.id GROUP BY a.id, a.acronym, a.entity_type")
def acronym_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "venue_acronym_variants").groupBy("venue_acronym_id").agg(F.array_join(F.array_sort(F.collect_list("variant")), "|").alias("variants"), F.count("*").alias("n"))
    d = table(spark, sf, "venue_acronyms").join(v, F.col("id") == F.col("venue_acronym_id"), "left")
    return d.select("acronym", "entity_type", "variants", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH p AS (SELECT j.id AS journal_id, o.id AS cache_id, j.display_name AS a, o.display_name AS b, list_filter([{_NORMAL.format(c='j.issn')}, {_NORMAL.format(c='j.eissn')}], lambda x: x IS NOT NULL) AS x, list_filter([{_NORMAL.format(c='o.issn')}, {_NORMAL.format(c='o.issn_l')}], lambda x: x IS NOT NULL) AS y
  FROM journals j JOIN openalex_cache o ON lower(j.display_name) = lower(o.display_name))
SELECT journal_id, cache_id FROM p WHERE len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) = 0"""
)
def contradicting_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    have = lambda *c: F.array_compact(F.array(*[ids.normal_issn(F.col(x)) for x in c]))
    j = table(spark, sf, "journals").select(F.col("id").alias("journal_id"), F.lower("display_name").alias("k"), have("issn", "eissn").alias("x"))
    o = table(spark, sf, "openalex_cache").select(F.col("id").alias("cache_id"), F.lower("display_name").alias("k"), have("issn", "issn_l").alias("y"))
    return j.join(o, "k").where(matching.disjoint(F.col("x"), F.col("y"))).select("journal_id", "cache_id")


# ---- aggregations


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    d = strict_load(table(spark, sf, "retraction_watch"))
    return d.withColumn("venue", F.lower(tx.squeeze(F.col("journal"))))


_NOTICES = r"""lines AS (SELECT line_id, regexp_replace(raw_line, '\r?\n?$', '') AS t FROM retraction_watch),
q AS (SELECT line_id, t, coalesce(regexp_full_match(t, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'), false) AS ok FROM lines),
f AS (SELECT line_id, list_transform(regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS fs FROM q WHERE ok),
g AS (SELECT line_id, fs, CASE WHEN regexp_full_match(fs[7], '\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}') THEN try_strptime(fs[7], '%m/%d/%Y %H:%M') END AS ts FROM f WHERE len(fs) = 11),
notices AS (SELECT line_id, fs[1] AS record_id, fs[3] AS journal, fs[4] AS publisher, ts AS retraction_date, fs[10] AS nature, fs[11] AS reason, lower(trim(regexp_replace(fs[3], '\s+', ' ', 'g'))) AS venue FROM g WHERE regexp_matches(fs[3], '\pL') AND (fs[7] IN ('', '0') OR ts IS NOT NULL))"""
_IS_RETRACTION = "(CASE WHEN lower(trim(coalesce(nature, ''))) = '' THEN true WHEN regexp_matches(lower(nature), 'correction|corrigendum|erratum|expression of concern|reinstatement') THEN false ELSE regexp_matches(lower(nature), 'retract|withdraw') END)"


@query(
    f"""WITH {_NOTICES} SELECT venue, count(*) AS total, count(*) FILTER (WHERE 2025 - year(retraction_date) <= 2) AS recent, count(*) FILTER (WHERE 2025 - year(retraction_date) <= 1) AS very_recent,
  min(retraction_date) AS first_date, max(retraction_date) AS last_date, CAST(greatest(1, max(year(retraction_date)) - min(year(retraction_date)) + 1) AS INT) AS years_active, count(DISTINCT publisher) AS publishers FROM notices WHERE {_IS_RETRACTION} GROUP BY 1"""
)
def retraction_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = _notices(spark, sf).where(tx.is_retraction(F.col("retraction_nature")))
    age = F.year(as_of()) - F.year("retraction_date")
    return d.groupBy("venue").agg(
        F.count("*").alias("total"),
        F.count_if(age <= 2).alias("recent"),
        F.count_if(age <= 1).alias("very_recent"),
        F.min("retraction_date").alias("first_date"),
        F.max("retraction_date").alias("last_date"),
        F.greatest(F.lit(1), F.max(F.year("retraction_date")) - F.min(F.year("retraction_date")) + 1).alias("years_active"),
        F.count_distinct("publisher").alias("publishers"),
    )


@query(f"""WITH {_NOTICES}, c AS (SELECT venue, coalesce(nullif(nature, ''), 'Retraction') AS v, count(*) AS n FROM notices GROUP BY 1, 2) SELECT venue, string_agg(v || '=' || n, ';' ORDER BY v || '=' || n) AS natures FROM c GROUP BY 1""")
def nature_histograms(spark: SparkSession, sf: str) -> DataFrame:
    d = rollups.histogram(_notices(spark, sf), "venue", F.coalesce(F.expr("nullif(retraction_nature, '')"), F.lit("Retraction")), "natures")
    return d.select("venue", rollups.histogram_text("natures").alias("natures"))


@query(
    f"""WITH {_NOTICES}, r AS (SELECT venue, trim(unnest(string_split(reason, ';'))) AS value FROM notices), c AS (SELECT venue, value, count(*) AS n FROM r WHERE value <> '' GROUP BY 1, 2)
SELECT venue, value, n, CAST(row_number() OVER (PARTITION BY venue ORDER BY n DESC, value) AS INT) AS place FROM c QUALIFY place <= 5"""
)
def top_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = _notices(spark, sf).select("venue", F.explode(rollups.split_list(F.col("reason"))).alias("r"))
    return rollups.top_values(d, "venue", F.col("r"), 5)


@query(
    f"""WITH {_NOTICES}, y AS (SELECT venue, year(retraction_date) AS year, count(*) AS n FROM notices WHERE retraction_date IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, avg(n) OVER (PARTITION BY venue ORDER BY year ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY venue ORDER BY year) AS rn, lead(year) OVER (PARTITION BY venue ORDER BY year) AS nx FROM y)
SELECT venue, CAST(year AS INT) AS year, n, round(m, 6) AS mean_before FROM w WHERE nx IS NULL AND rn >= 3 AND n > 1.5 * m AND n > 1"""
)
def notice_spikes(spark: SparkSession, sf: str) -> DataFrame:
    y = _notices(spark, sf).where("retraction_date is not null").groupBy("venue", F.year("retraction_date").alias("year")).agg(F.count("*").alias("n"))
    d = keyed.spikes(y, "venue", "year", "n", 1.5, 1)
    return d.withColumn("mean_before", F.round("mean_before", 6))


@query("""SELECT s.name AS source, coalesce(j.name_type, '-') AS name_type, count(j.id) AS n FROM data_sources s LEFT JOIN journal_names j ON j.source_name = s.name GROUP BY ROLLUP (s.name, coalesce(j.name_type, '-'))""")
def source_statistics(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "journal_names").groupBy("source_name", F.coalesce("name_type", F.lit("-")).alias("name_type")).agg(F.count("*").alias("n"))
    d = table(spark, sf, "data_sources").select(F.col("name").alias("source")).join(n, F.col("source") == F.col("source_name"), "left")
    return d.select("source", F.coalesce("name_type", F.lit("-")).alias("name_type"), F.coalesce("n", F.lit(0)).alias("n")).rollup("source", "name_type").agg(F.sum("n").alias("n"))


@query("SELECT journal_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names, string_agg(DISTINCT name_type || ':' || source_name, ',' ORDER BY name_type || ':' || source_name) AS said FROM journal_names WHERE journal_id IS NOT NULL GROUP BY 1")
def concatenated_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journal_names").where("journal_id is not null").groupBy("journal_id")
    said = F.array_sort(F.collect_set(F.concat(F.col("name_type"), F.lit(":"), F.col("source_name"))))
    return d.agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.when(F.size(said) > 0, F.array_join(said, ",")).alias("said"))


@query("SELECT entity_type, count(DISTINCT a.id) AS acronyms, count(DISTINCT v.id) AS variants, count(DISTINCT a.source_file) AS files FROM venue_acronyms a LEFT JOIN venue_acronym_variants v ON v.venue_acronym_id = a.id GROUP BY 1")
def acronym_statistics(spark: SparkSession, sf: str) -> DataFrame:
    # each child is counted before the join, so no distinct has to undo a fan-out
    v = table(spark, sf, "venue_acronym_variants").groupBy("venue_acronym_id").agg(F.count("*").alias("variants"))
    d = table(spark, sf, "venue_acronyms").join(v, F.col("id") == F.col("venue_acronym_id"), "left")
    return d.groupBy("entity_type").agg(F.count("*").alias("acronyms"), F.coalesce(F.sum("variants"), F.lit(0)).alias("variants"), F.count_distinct("source_file").alias("files"))


@query("SELECT source_name, max(updated_at) AS last_update, count(*) AS listings FROM journals GROUP BY 1")
def last_updates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").groupBy("source_name").agg(F.max("updated_at").alias("last_update"), F.count("*").alias("listings"))


@query(
    """SELECT bib_file, count(*) AS entries, count(*) FILTER (WHERE state = 'assessed') AS assessed, count(*) FILTER (WHERE state <> 'assessed' OR state IS NULL) AS other,
  count(*) FILTER (WHERE venue_type = 'conference') AS conferences, count(*) FILTER (WHERE venue_type = 'journal') AS journals, count(DISTINCT journal_name) AS names FROM bibtex_entries GROUP BY 1"""
)
def bibliography_counters(spark: SparkSession, sf: str) -> DataFrame:
    state = F.col("state") == "assessed"
    return table(spark, sf, "bibtex_entries").groupBy("bib_file").agg(
        F.count("*").alias("entries"), F.count_if(state).alias("assessed"), F.count_if(~F.coalesce(state, F.lit(False))).alias("other"),
        F.count_if(F.col("venue_type") == "conference").alias("conferences"), F.count_if(F.col("venue_type") == "journal").alias("journals"), F.count_distinct("journal_name").alias("names"),
    )


@query(
    f"""WITH d AS (SELECT coalesce(nullif({_series_sql('booktitle')}, ''), trim(regexp_replace(booktitle, '\\s+', ' ', 'g'))) AS series, TRY_CAST(pub_year AS INT) AS y FROM bibtex_entries WHERE booktitle IS NOT NULL)
SELECT series, count(*) AS entries, count(DISTINCT y) AS years, min(y) AS first_year, max(y) AS last_year FROM d WHERE y BETWEEN 1900 AND 2100 AND series <> '' GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT y) >= 3"""
)
def conference_rollup(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("booktitle")
    d = table(spark, sf, "bibtex_entries").where("booktitle is not null").select(F.coalesce(tx.conference_series(b), tx.squeeze(b)).alias("series"), F.col("pub_year").try_cast("int").alias("y"))
    d = d.where(F.col("y").between(1900, 2100) & (F.col("series") != ""))
    d = d.groupBy("series").agg(F.count("*").alias("entries"), F.count_distinct("y").alias("years"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))
    return d.where("entries >= 5 and years >= 3")


_VERDICT = "CASE s.source_type WHEN 'predatory_list' THEN 'predatory' WHEN 'legitimate_list' THEN 'legitimate' ELSE 'other' END"


@query(
    f"""WITH v AS (SELECT lower(j.display_name) AS venue, {_VERDICT} AS verdict, s.authority_level / 10.0::DOUBLE AS confidence FROM journals j JOIN data_sources s ON j.source_name = s.name WHERE j.display_name IS NOT NULL)
SELECT venue, round(coalesce(sum(confidence * 0.8::DOUBLE) FILTER (WHERE verdict = 'predatory'), 0), 6) AS against, round(coalesce(sum(confidence * 0.8::DOUBLE) FILTER (WHERE verdict = 'legitimate'), 0), 6) AS in_favour,
  round(count(*) * 0.8::DOUBLE, 6) AS total_weight, count(*) FILTER (WHERE verdict = 'predatory') AS votes_against, count(*) FILTER (WHERE verdict = 'legitimate') AS votes_in_favour FROM v GROUP BY 1"""
)
def weighted_votes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("source_type")
    s = table(spark, sf, "data_sources").select(F.col("name").alias("source_name"), F.when(kind == "predatory_list", "predatory").when(kind == "legitimate_list", "legitimate").otherwise("other").alias("verdict"), (F.col("authority_level") / 10.0).alias("confidence"))
    d = table(spark, sf, "journals").where("display_name is not null").select(F.lower("display_name").alias("venue"), "source_name").join(s, "source_name")
    v = rollups.weighted_votes(d, "venue", "verdict", F.col("confidence"), F.lit(0.8))
    return v.select("venue", *[F.round(c, 6).alias(c) for c in ("against", "in_favour", "total_weight")], "votes_against", "votes_in_favour")


_SOURCES = ("bealls", "doaj", "scopus", "pubmed")


@query(
    "SELECT lower(display_name) AS venue, " + ", ".join(f"coalesce(min(coalesce(publisher, '?')) FILTER (WHERE source_name = '{s}'), '') AS {s}" for s in _SOURCES) + " FROM journals WHERE display_name IS NOT NULL GROUP BY 1"
)
def condensed_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journals").where("display_name is not null").withColumn("venue", F.lower("display_name"))
    return rollups.condensed_pivot(d, "venue", "source_name", _SOURCES, F.coalesce("publisher", F.lit("?")))


@query("""WITH k AS (SELECT nullif(lower(trim(coalesce(normalized_name, display_name))), '') AS k FROM journals) SELECT count(*) AS total, count(DISTINCT k) AS "unique", count(k) - count(DISTINCT k) AS duplicates, count(*) - count(k) AS keyless FROM k""")
def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.write_metrics(table(spark, sf, "journals"), F.expr("nullif(lower(trim(coalesce(normalized_name, display_name))), '')"))


@query(
    """SELECT id, CAST(greatest(1, last_publication_year - first_publication_year + 1) AS INT) AS years_active, round(total_publications::DOUBLE / greatest(1, last_publication_year - first_publication_year + 1), 6) AS per_year,
  round(CASE WHEN total_publications > 0 THEN cited_by_count::DOUBLE / total_publications ELSE 0 END, 6) AS citations_per_work, round(recent_publications / 5.0::DOUBLE, 6) AS recent_rate,
  CASE WHEN total_publications > 0 THEN round(100.0::DOUBLE * recent_publications / total_publications, 4) END AS recent_percent FROM openalex_cache WHERE first_publication_year IS NOT NULL AND last_publication_year IS NOT NULL AND total_publications IS NOT NULL"""
)
def publication_metrics(spark: SparkSession, sf: str) -> DataFrame:
    years = F.greatest(F.lit(1), F.col("last_publication_year") - F.col("first_publication_year") + 1)
    d = table(spark, sf, "openalex_cache").where("first_publication_year is not null and last_publication_year is not null and total_publications is not null")
    works = F.col("total_publications")
    return d.select(
        "id", years.alias("years_active"), F.round(works / years, 6).alias("per_year"), F.round(F.coalesce(F.try_divide(F.col("cited_by_count").cast("double"), works), F.lit(0.0)), 6).alias("citations_per_work"),
        F.round(F.col("recent_publications") / 5.0, 6).alias("recent_rate"), F.round(F.try_divide(F.col("recent_publications") * 100.0, works), 4).alias("recent_percent"),
    )


@query(
    """SELECT source_type, round(avg((CAST(issn IS NOT NULL AS INT) + CAST(issn_l IS NOT NULL AS INT) + CAST(publisher IS NOT NULL AS INT) + CAST(normalized_journal_name IS NOT NULL AS INT) + CAST(first_publication_year IS NOT NULL AS INT)) / 5.0::DOUBLE), 6) AS coverage,
  count(*) FILTER (WHERE total_publications BETWEEN 50 AND 9999) AS middling, count(*) FILTER (WHERE total_publications < 50) AS small FROM openalex_cache GROUP BY 1"""
)
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    have = F.array(*[F.col(c).isNotNull().cast("int") for c in ("issn", "issn_l", "publisher", "normalized_journal_name", "first_publication_year")])
    d = table(spark, sf, "openalex_cache")
    return d.groupBy("source_type").agg(
        F.round(F.avg(F.aggregate(have, F.lit(0), lambda a, x: a + x) / 5.0), 6).alias("coverage"), F.count_if(F.col("total_publications").between(50, 9999)).alias("middling"), F.count_if(F.col("total_publications") < 50).alias("small")
    )


# ---- keyed rows


@query(f"""SELECT normalized_journal_name, id, total_publications, fetched_at FROM openalex_cache WHERE expires_at > TIMESTAMP '2024-06-01 00:00:00' AND normalized_journal_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY normalized_journal_name ORDER BY fetched_at DESC, id DESC) = 1""")
def latest_unexpired(spark: SparkSession, sf: str) -> DataFrame:
    d = keyed.unexpired(table(spark, sf, "openalex_cache"), "expires_at", F.lit("2024-06-01 00:00:00").cast("timestamp")).where("normalized_journal_name is not null")
    d = d.select("normalized_journal_name", "id", "total_publications", "fetched_at")
    return keyed.latest_per_key(d, ["normalized_journal_name"], F.struct("fetched_at", "id"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE expires_at > TIMESTAMP '2024-06-01 00:00:00') AS kept, count(*) FILTER (WHERE floor((epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch(fetched_at)) / 86400) > 30) AS stale, count(*) FILTER (WHERE fetched_at + INTERVAL 720 HOUR = expires_at) AS monthly FROM openalex_cache""")
def expiry_sweep(spark: SparkSession, sf: str) -> DataFrame:
    days = F.floor((F.unix_timestamp(as_of()) - F.unix_timestamp("fetched_at")) / 86400)
    return table(spark, sf, "openalex_cache").agg(
        F.count("*").alias("n"), F.count_if(F.col("expires_at") > F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("kept"), F.count_if(days > 30).alias("stale"),
        F.count_if(F.col("fetched_at") + F.expr("interval 720 hours") == F.col("expires_at")).alias("monthly"),
    )


@query("""SELECT name_key, id, name FROM (SELECT lower(trim(name)) AS name_key, id, name FROM journal_names) WHERE name_key <> '' QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY id) = 1""")
def first_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journal_names").select(F.lower(F.trim("name")).alias("name_key"), "id", "name").where("name_key <> ''")
    return keyed.first_per_key(d, ["name_key"], F.col("id"))


@query("""SELECT normalized_name, id, display_name, issn FROM journals WHERE normalized_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY updated_at DESC, id DESC) = 1""")
def last_listings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journals").where("normalized_name is not null").select("normalized_name", "id", "display_name", "issn", "updated_at")
    return keyed.latest_per_key(d, ["normalized_name"], F.struct("updated_at", "id")).drop("updated_at")


@query(
    """WITH d AS (SELECT source_name, name, min(id) AS seen FROM journal_names WHERE name IS NOT NULL AND source_name IS NOT NULL GROUP BY 1, 2)
SELECT source_name, name, CAST(row_number() OVER (PARTITION BY source_name ORDER BY seen, name) AS INT) AS place FROM d QUALIFY place <= 2"""
)
def first_two_names(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.first_distinct(table(spark, sf, "journal_names").where("source_name is not null"), "source_name", "name", "id", 2)


@query(
    """WITH d AS (SELECT DISTINCT bib_file, entry_id FROM bibtex_entries WHERE state = 'assessed'), w AS (SELECT *, coalesce(CAST(entry_id - lag(entry_id) OVER (PARTITION BY bib_file ORDER BY entry_id) > 1 AS INT), 0) AS g FROM d),
r AS (SELECT *, sum(g) OVER (PARTITION BY bib_file ORDER BY entry_id) AS run FROM w) SELECT bib_file, max(entry_id) FILTER (WHERE run = 0) AS frontier, count(*) FILTER (WHERE run > 0) AS beyond FROM r GROUP BY 1"""
)
def completion_frontiers(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.completion_frontier(table(spark, sf, "bibtex_entries").where("state = 'assessed'"), "bib_file", "entry_id")


@query("""SELECT bib_file, segment, count(*) AS n FROM (SELECT bib_file, sum(CAST(entry_type = 'article' AS INT)) OVER (PARTITION BY bib_file ORDER BY entry_id) AS segment FROM bibtex_entries) GROUP BY 1, 2""")
def entry_segments(spark: SparkSession, sf: str) -> DataFrame:
    d = keyed.record_segments(table(spark, sf, "bibtex_entries"), "bib_file", "entry_id", F.col("entry_type") == "article")
    return d.groupBy("bib_file", "segment").agg(F.count("*").alias("n"))


_SNAP = "(SELECT id, normalized_name, url, first_seen_at, last_seen_at FROM journal_urls WHERE snapshot_no = {n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivered_at DESC, last_seen_at DESC, url DESC, normalized_name DESC, first_seen_at DESC) = 1)"


def _snapshot(spark: SparkSession, sf: str, n: int) -> DataFrame:
    d = table(spark, sf, "journal_urls").where(F.col("snapshot_no") == n).select("id", "normalized_name", "url", "first_seen_at", "last_seen_at", "delivered_at")
    return keyed.latest_per_key(d, ["id"], F.struct("delivered_at", "last_seen_at", "url", "normalized_name", "first_seen_at")).drop("delivered_at")


@query(
    f"""WITH o AS {_SNAP.format(n=1)}, n AS {_SNAP.format(n=2)} SELECT coalesce(n.id, o.id) AS id, coalesce(nullif(n.normalized_name, ''), o.normalized_name) AS normalized_name, coalesce(nullif(n.url, ''), o.url) AS url,
  coalesce(n.first_seen_at, o.first_seen_at) AS first_seen_at, coalesce(n.last_seen_at, o.last_seen_at) AS last_seen_at FROM o FULL JOIN n ON o.id = n.id"""
)
def upserted_urls(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.upsert_coalesce(_snapshot(spark, sf, 1), _snapshot(spark, sf, 2), ["id"])


@query(f"""WITH o AS {_SNAP.format(n=1)}, n AS {_SNAP.format(n=2)} SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def replaced_urls(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.upsert_last(_snapshot(spark, sf, 1), _snapshot(spark, sf, 2), ["id"])


@query(f"""WITH o AS {_SNAP.format(n=1)}, n AS {_SNAP.format(n=2)} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)""")
def inserted_urls(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.insert_ignore(_snapshot(spark, sf, 1), _snapshot(spark, sf, 2), ["id"], F.col("last_seen_at"))


@query(f"""WITH u AS (SELECT * FROM {_SNAP.format(n=1)} UNION ALL SELECT * FROM {_SNAP.format(n=2)}) SELECT url, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) AS deliveries FROM u GROUP BY 1""")
def url_sightings(spark: SparkSession, sf: str) -> DataFrame:
    o, n = (_snapshot(spark, sf, k).select("url", "first_seen_at", "last_seen_at").withColumn("one", F.lit(1)) for k in (1, 2))
    seen = keyed.replace_sightings(o, n, ["url"], "first_seen_at", "last_seen_at").drop("one")
    return seen.join(o.unionByName(n).groupBy("url").agg(F.count("*").alias("deliveries")), "url")


@query("SELECT normalized_name, arg_max(id, (coalesce(length(display_name), 0), coalesce(length(publisher), 0), id)) AS id FROM journals WHERE normalized_name IS NOT NULL GROUP BY 1")
def fullest_listings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "journals").where("normalized_name is not null").select("normalized_name", "id", "display_name", "publisher")
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return rollups.best_row(d, "normalized_name", n("display_name"), n("publisher"), F.col("id")).select("normalized_name", "id")


# ---- sets, arrays, JSON


@query("SELECT DISTINCT lower(display_name) AS name FROM journals WHERE display_name IS NOT NULL UNION SELECT lower(name) FROM journal_names WHERE name IS NOT NULL")
def united_names(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "journals").select(F.lower("display_name").alias("name"))
    return a.unionByName(table(spark, sf, "journal_names").select(F.lower("name").alias("name"))).where("name is not null").distinct()


@query("SELECT DISTINCT bib_file FROM bibtex_entries EXCEPT SELECT DISTINCT bib_file FROM bibtex_entries WHERE entry_type = 'techreport' AND pub_year IS NULL")
def finished_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries")
    return d.select("bib_file").distinct().join(d.where("entry_type = 'techreport' and pub_year is null").select("bib_file"), "bib_file", "left_anti")


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select(F.from_json("props", "k int").getField("k").alias("k"), "event_type", "value")
    return d.groupBy("k", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(y || '=' || n, ';' ORDER BY y) AS by_year, CAST(sum(n) FILTER (WHERE y >= 1999) AS BIGINT) AS recent FROM y GROUP BY 1"""
)
def counts_by_year(spark: SparkSession, sf: str) -> DataFrame:
    d = rollups.histogram(table(spark, sf, "orders"), "o_custkey", F.year("o_orderdate"), "m")
    recent = F.aggregate(F.map_values(F.map_filter("m", lambda y, n: y >= 1999)), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return d.select("o_custkey", rollups.histogram_text("m").alias("by_year"), F.when(recent > 0, recent).alias("recent"))


@query(
    f"""WITH d AS (SELECT id, {_NORMAL.format(c='issn_l')} AS l, {_NORMAL.format(c='issn')} AS i FROM openalex_cache) SELECT id, array_to_string(list_filter([l, CASE WHEN i IS DISTINCT FROM l THEN i END], lambda x: x IS NOT NULL), ',') AS issns FROM d"""
)
def issn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.array_distinct(F.array_compact(F.array(ids.normal_issn(F.col("issn_l")), ids.normal_issn(F.col("issn")))))
    return table(spark, sf, "openalex_cache").select("id", F.array_join(pair, ",").alias("issns"))


@query(
    """SELECT s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, n_name AS nation
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY s_suppkey, n_name"""
)
def supplier_revenue(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_shipdate >= timestamp '1996-01-01'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation")), "s_nationkey")
    return li.join(s.select("s_suppkey", "nation"), "s_suppkey")
