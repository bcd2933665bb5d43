"""Queries of searches, acronyms, name forms, records and scalar functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.functions import identifiers as ids
from periodiq.functions import text as tx
from periodiq.operators import acronyms as ac
from periodiq.operators import search as se
from periodiq.plans.reference_queries import _ACR, _ACRONYMS, _NORMAL, _ORGS, _SMALL, _STOP, _basic, _clean_sql, _series_sql
from periodiq.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL under its function's name."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _form(c: str) -> str:
    return f"""array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({_basic(c)}), '{_ORGS}', ''), '-', ' '), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')"""


def _cased(c: str) -> str:
    return f"""array_to_string(list_transform(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''), lambda w, i: CASE WHEN upper(w) IN ({_ACR}) THEN upper(w) WHEN i > 1 AND lower(w) IN ({_SMALL}) THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ')"""


def _series(c: str) -> str:
    return f"nullif(nullif({_series_sql(c)}, ''), {c})"


# ---- names


@query(
    f"""WITH d AS (SELECT DISTINCT journal_name AS c FROM bibtex_entries WHERE journal_name IS NOT NULL),
e AS (SELECT c, CASE WHEN trim(c) = '' THEN 'empty' WHEN length(c) > {tx.MAX_INPUT} THEN 'too long' END AS error, trim(regexp_replace({_clean_sql('c')}, '{tx.FRAME}', '', 'g')) AS t, {_ACRONYMS.format(c='c')} AS acr FROM d),
n AS (SELECT *, {_cased('t')} AS name FROM e),
s AS (SELECT *, {_series('name')} AS series, array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN w = 'Journal' THEN 'Jrnl' WHEN w = 'International' THEN 'Intl' WHEN w = 'international' THEN 'intl.' ELSE w END), ' ') AS short FROM n),
f AS (SELECT *, list_concat(list_filter([CASE WHEN starts_with(lower(name), 'journal of ') THEN trim(name[12:]) END, CASE WHEN starts_with(lower(name), 'the ') THEN trim(name[5:]) END, CASE WHEN starts_with(lower(name), 'proceedings of ') THEN trim(name[16:]) END,
  series, CASE WHEN short <> name THEN short END], lambda x: x IS NOT NULL AND x <> ''), acr) AS al FROM s)
SELECT c AS journal_name, error, CASE WHEN error IS NULL THEN name END AS name, CASE WHEN error IS NULL THEN lower(name) END AS lookup_name,
  CASE WHEN error IS NULL AND regexp_matches(c, '{tx.ISSN}') THEN regexp_extract(c, '{tx.ISSN}', 1) || '-' || regexp_extract(c, '{tx.ISSN}', 2) END AS issn,
  CASE WHEN error IS NULL THEN array_to_string(list_filter(al, lambda x, i: list_position(al, x) = i), '|') END AS aliases FROM f"""
)
def normalized_inputs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select("journal_name").where("journal_name is not null").distinct()
    d = d.select("journal_name", tx.normalized_input(F.col("journal_name")).alias("n"))
    return d.select("journal_name", "n.error", "n.name", "n.lookup_name", "n.issn", F.array_join("n.aliases", "|").alias("aliases"))


@query(f"SELECT DISTINCT name, coalesce({_series('lower(trim(name))')}, trim(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'))) AS venue_key FROM journal_names WHERE name IS NOT NULL")
def venue_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journal_names").select("name").where("name is not null").distinct().select("name", tx.venue_key(F.col("name")).alias("venue_key"))


_SAME = """(x = y OR lower(trim(a)) = lower(trim(b)) OR coalesce(u = v, false) OR coalesce(u = y, false) OR coalesce(v = x, false)
  OR (greatest(length(x), length(y)) >= 10 AND (contains(x, y) OR contains(y, x))))"""


def _same_ctes(source: str, extra: str) -> str:
    return f"p AS ({source}), s AS (SELECT *, {_series('lower(trim(a))')} AS sa, {_series('lower(trim(b))')} AS sb FROM p), f AS (SELECT {extra}, a, b, {_form('a')} AS x, {_form('b')} AS y, {_form('sa')} AS u, {_form('sb')} AS v FROM s)"


@query(f"WITH {_same_ctes('SELECT v.id, v.variant AS a, c.canonical AS b FROM venue_acronym_variants v JOIN venue_acronyms c ON v.venue_acronym_id = c.id', 'id')} SELECT id, {_SAME} AS same FROM f")
def name_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "venue_acronym_variants").join(table(spark, sf, "venue_acronyms").select(F.col("id").alias("venue_acronym_id"), "canonical"), "venue_acronym_id")
    return v.select("id", tx.same_series(F.col("variant"), F.col("canonical")).alias("same"))


_SHORT = {"int.": "international", "j.": "journal", "conf.": "conference"}
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**tx.SHORT_FORMS, **_SHORT}.items()) + "}"


def _expanded(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')"
    return f"CASE WHEN len(list_filter({words}, lambda w: map_contains({_MAP}, w))) > 0 THEN array_to_string(list_transform({words}, lambda w: coalesce({_MAP}[w], w)), ' ') END"


@query(
    f"""WITH r AS (SELECT v.id, v.variant AS a0, c.canonical AS b0, {_expanded('v.variant')} AS ea, {_expanded('c.canonical')} AS eb FROM venue_acronym_variants v JOIN venue_acronyms c ON v.venue_acronym_id = c.id),
{_same_ctes("SELECT id, 1 AS k, a0 AS a, b0 AS b FROM r UNION ALL SELECT id, 2, ea, b0 FROM r WHERE ea IS NOT NULL UNION ALL SELECT id, 2, a0, eb FROM r WHERE ea IS NULL AND eb IS NOT NULL", 'id')} SELECT id, bool_or({_SAME}) AS same FROM f GROUP BY id"""
)
def variant_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "venue_acronym_variants").join(table(spark, sf, "venue_acronyms").select(F.col("id").alias("venue_acronym_id"), "canonical"), "venue_acronym_id")
    learned = F.create_map(*[F.lit(x) for kv in _SHORT.items() for x in kv])
    return v.select("id", tx.same_venue(F.col("variant"), F.col("canonical"), learned).alias("same"))


@query("SELECT entry_id, CASE WHEN length(h) >= 3 THEN h END AS hint FROM (SELECT entry_id, trim(string_split(string_split(title, ':')[1], ',')[1]) AS h FROM bibtex_entries WHERE title IS NOT NULL)")
def title_hints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibtex_entries").where("title is not null").select("entry_id", tx.title_series(F.col("title")).alias("hint"))


@query(r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(display_name), '\s+'), lambda w: regexp_replace(w, '[,;:!?]+$', '')), lambda w: w <> ''), '|') AS tokens FROM journals WHERE display_name IS NOT NULL")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").where("display_name is not null").select("id", F.array_join(tx.tokens(F.col("display_name")), "|").alias("tokens"))


# ---- searches


@query(r"""SELECT j.id, j.display_name, u.urls FROM journals j LEFT JOIN (SELECT journal_id, string_agg(DISTINCT url, '|' ORDER BY url) AS urls FROM journal_urls WHERE url IS NOT NULL GROUP BY 1) u ON u.journal_id = j.id WHERE j.display_name ILIKE '%journal of%' AND lower(j.source_name) = 'doaj'""")
def venue_search(spark: SparkSession, sf: str) -> DataFrame:
    d = se.search(table(spark, sf, "journals").select("id", "display_name", "source_name", "issn", "eissn"), {"source_name": "DOAJ"}, {"display_name": "Journal of"}, [(("issn", "eissn"), None)])
    d = se.with_urls(d, "id", table(spark, sf, "journal_urls"), "journal_id", "url")
    return d.select("id", "display_name", F.when(F.size("urls") > 0, F.array_join("urls", "|")).alias("urls"))


@query("SELECT e.entry_id, a.id AS acronym_id, a.canonical FROM bibtex_entries e JOIN venue_acronyms a ON lower(trim(e.journal_name)) = lower(trim(a.acronym)) WHERE a.confidence_score >= 0.8 AND length(e.journal_name) <= 10 AND upper(e.journal_name) = e.journal_name AND lower(e.journal_name) <> e.journal_name")
def acronym_entries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select("entry_id", "journal_name").where(se.acronym_guard(F.col("journal_name")))
    return se.acronym_matches(d, "journal_name", table(spark, sf, "venue_acronyms")).select("entry_id", "acronym_id", "canonical")


@query(f"""WITH n AS (SELECT DISTINCT lower(journal_name) AS n, {_NORMAL.format(c='issn')} AS issn FROM bibtex_entries) SELECT issn, min(a.id) AS acronym_id, arg_min(a.acronym, a.id) AS acronym FROM n JOIN venue_acronyms a ON lower(a.canonical) = n.n WHERE issn IS NOT NULL GROUP BY 1""")
def acronyms_by_issn(spark: SparkSession, sf: str) -> DataFrame:
    return se.first_per_issn(table(spark, sf, "venue_acronyms"), table(spark, sf, "bibtex_entries"), "journal_name", [ids.normal_issn(F.col("issn"))])


@query(
    f"""WITH d AS (SELECT DISTINCT journal_name AS c FROM bibtex_entries WHERE journal_name IS NOT NULL), s AS (SELECT c, {_series('c')} AS series, {_ACRONYMS.format(c='c')} AS acr,
  array_to_string(list_transform(string_split(c, ' '), lambda w: CASE WHEN w = 'Journal' THEN 'Jrnl' WHEN w = 'International' THEN 'Intl' WHEN w = 'international' THEN 'intl.' ELSE w END), ' ') AS short FROM d),
f AS (SELECT c, list_filter(list_transform(list_concat([c, CASE WHEN starts_with(lower(c), 'journal of ') THEN trim(c[12:]) END, CASE WHEN starts_with(lower(c), 'the ') THEN trim(c[5:]) END, CASE WHEN starts_with(lower(c), 'proceedings of ') THEN trim(c[16:]) END, series, CASE WHEN short <> c THEN short END], acr), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '') AS al FROM s),
k AS (SELECT c, unnest(list_slice(list_filter(al, lambda x, i: list_position(al, x) = i), 1, 12)) AS form FROM f),
t AS (SELECT lower(acronym) AS form, id, 'acronym' AS kind FROM venue_acronyms UNION ALL SELECT lower(canonical), id, 'canonical' FROM venue_acronyms UNION ALL SELECT lower(variant), venue_acronym_id, 'variant' FROM venue_acronym_variants)
SELECT DISTINCT c AS journal_name, id AS acronym_id, kind FROM k JOIN t USING (form)"""
)
def acronym_candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").select("journal_name").where("journal_name is not null").distinct()
    forms = se.candidate_forms(d, "journal_name", F.col("journal_name"))
    a, v = table(spark, sf, "venue_acronyms"), table(spark, sf, "venue_acronym_variants")
    t = a.select(F.lower("acronym").alias("form"), F.col("id").alias("acronym_id"), F.lit("acronym").alias("kind"))
    t = t.unionByName(a.select(F.lower("canonical").alias("form"), F.col("id").alias("acronym_id"), F.lit("canonical").alias("kind")))
    t = t.unionByName(v.select(F.lower("variant").alias("form"), F.col("venue_acronym_id").alias("acronym_id"), F.lit("variant").alias("kind")))
    return forms.join(t, "form").select("journal_name", "acronym_id", "kind").distinct()


@query(r"""WITH w AS (SELECT id AS a, ' ' || trim(regexp_replace(lower(acronym), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS n FROM venue_acronyms WHERE length(acronym) >= 4), l AS (SELECT id AS b, ' ' || trim(regexp_replace(lower(variant), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS m FROM venue_acronym_variants),
k AS (SELECT * FROM w WHERE len(list_filter(string_split(n, ' '), lambda x: length(x) >= 4)) > 0) SELECT a, b FROM k JOIN l ON contains(m, n)""")
def contained_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "venue_acronyms").where(F.length("acronym") >= 4).select(F.col("id").alias("a"), F.col("acronym").alias("name"))
    return se.containing_names(a, table(spark, sf, "venue_acronym_variants").select(F.col("id").alias("b"), F.col("variant").alias("name")))


_VERDICTS = "CASE s.source_type WHEN 'predatory_list' THEN 'predatory' WHEN 'legitimate_list' THEN 'legitimate' END"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("source_type")
    s = table(spark, sf, "data_sources").select(F.col("name").alias("source_name"), F.when(kind == "predatory_list", "predatory").when(kind == "legitimate_list", "legitimate").alias("verdict"), F.col("source_type").alias("evidence"), (F.col("authority_level") / 10.0).alias("confidence"))
    d = table(spark, sf, "journals").where("display_name is not null").select("id", F.lower("display_name").alias("venue"), "source_name", "issn", "eissn")
    return d.join(s, "source_name")


_RESULTS = f"res AS (SELECT j.id, lower(j.display_name) AS venue, j.source_name, {_VERDICTS} AS verdict, s.source_type AS evidence, s.authority_level / 10.0::DOUBLE AS confidence, j.issn, j.eissn FROM journals j JOIN data_sources s ON j.source_name = s.name WHERE j.display_name IS NOT NULL)"
_PAIRS = (("bealls", "doaj"), ("doaj", "scopus"), ("doaj", "pubmed"))


@query(f"""WITH {_RESULTS}, one AS (SELECT venue, source_name, min(verdict) AS v FROM res WHERE verdict IS NOT NULL GROUP BY 1, 2), p(a, b) AS (VALUES {', '.join(map(str, _PAIRS))})
SELECT x.venue, p.a, p.b, x.v = y.v AS agree FROM one x JOIN p ON x.source_name = p.a JOIN one y ON y.source_name = p.b AND y.venue = x.venue""")
def source_agreements(spark: SparkSession, sf: str) -> DataFrame:
    return se.compared_results(_results(spark, sf), "venue", "source_name", "verdict", spark.createDataFrame(_PAIRS, "a string, b string"))


@query(f"""WITH {_RESULTS}, c AS (SELECT id, venue, verdict, list_filter([{_NORMAL.format(c='issn')}, {_NORMAL.format(c='eissn')}], lambda x: x IS NOT NULL) AS i FROM res WHERE verdict IS NOT NULL)
SELECT x.id AS a, y.id AS b, CASE WHEN len(x.i) = 0 OR len(y.i) = 0 THEN 'unknown' WHEN list_has_any(x.i, y.i) THEN 'same' ELSE 'contradiction' END AS relation FROM c x JOIN c y ON x.venue = y.venue AND x.id < y.id AND x.verdict <> y.verdict""")
def conflicting_candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = _results(spark, sf).where("verdict is not null")
    d = d.withColumn("numbers", F.array_compact(F.array(ids.normal_issn(F.col("issn")), ids.normal_issn(F.col("eissn")))))
    return se.conflicting_candidates(d, "id", "venue", "verdict", "numbers")


@query("SELECT source_name AS source, display_name AS name, issn, eissn FROM journals UNION SELECT 'openalex', display_name, issn, issn_l FROM openalex_cache")
def candidate_sets(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "journals").select(F.col("source_name").alias("source"), F.col("display_name").alias("name"), "issn", "eissn")
    o = table(spark, sf, "openalex_cache").select(F.lit("openalex").alias("source"), F.col("display_name").alias("name"), "issn", F.col("issn_l").alias("eissn"))
    return se.candidate_set(j, o)


@query(f"""WITH {_RESULTS} SELECT venue, count(*) AS n, coalesce(bool_or(verdict IN ('predatory', 'legitimate', 'suspicious')), false) AS decisive, bool_or(evidence LIKE '%\\_list' ESCAPE '\\') AS listed, NOT bool_or(evidence LIKE '%\\_list' ESCAPE '\\') AS heuristic_only FROM res GROUP BY 1""")
def evidence_kinds(spark: SparkSession, sf: str) -> DataFrame:
    d = _results(spark, sf).groupBy("venue").agg(F.collect_list(F.struct("verdict", "evidence")).alias("r"))
    return d.select("venue", F.size("r").cast("bigint").alias("n"), F.coalesce(se.decisive(F.col("r")), F.lit(False)).alias("decisive"), se.list_evidence(F.col("r")).alias("listed"), se.heuristic_only(F.col("r")).alias("heuristic_only"))


@query("SELECT entry_id, lower(trim(coalesce(journal_name, booktitle))) IN ('proceedings', 'journal', 'conference') IS TRUE AS generic, (coalesce(lower(trim(venue_type)), '') IN ('', 'unknown') OR lower(trim(entry_type)) IN ('', 'unknown') OR lower(trim(venue_type)) = lower(trim(entry_type))) IS TRUE AS agree FROM bibtex_entries WHERE entry_type IS NOT NULL")
def type_agreements(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "bibtex_entries").where("entry_type is not null")
    return d.select("entry_id", se.generic_title(F.coalesce("journal_name", "booktitle")).alias("generic"), se.types_agree(F.col("venue_type"), F.col("entry_type")).alias("agree"))


# ---- acronyms of bibliographies

_MINED = f"""m AS (SELECT bib_file AS file, venue_type AS kind, journal_name AS c, ({_ACRONYMS.format(c='journal_name')})[1] AS acr FROM bibtex_entries WHERE journal_name IS NOT NULL),
b AS (SELECT file, kind, upper(acr) AS acronym, acr, trim(regexp_replace(c[1:position('(' || acr IN c) - 1], '^[''"\\s]+|[''"\\s]+$', '', 'g')) AS meaning FROM m WHERE acr IS NOT NULL AND position('(' || acr IN c) > 0),
g AS (SELECT file, kind, acronym, coalesce({_series('lower(trim(meaning))')}, trim(regexp_replace(lower(trim(meaning)), '\\s+', ' ', 'g'))) AS series, count(*) AS n FROM b WHERE length(meaning) > 2 * length(acr) GROUP BY ALL)"""
_MERGED = """t AS (SELECT kind, acronym, series, sum(n) AS n, count(DISTINCT file) AS files FROM g GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY kind, acronym ORDER BY n DESC, files DESC, series) AS rn, count(*) OVER (PARTITION BY kind, acronym) AS names FROM t)"""


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    return ac.mined(table(spark, sf, "bibtex_entries").where("journal_name is not null"), "bib_file", "venue_type", F.col("journal_name"))


@query(f"WITH {_MINED} SELECT file, kind, acronym, series, n FROM g")
def mined_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf)


@query(f"""WITH {_MINED}, {_MERGED}, {_same_ctes("SELECT x.kind, x.acronym, x.series AS a, y.series AS b FROM o x JOIN t y ON x.kind = y.kind AND x.acronym = y.acronym WHERE x.rn = 1", 'kind, acronym').replace('s AS (', 's_ AS (').replace('FROM s)', 'FROM s_)')},
c AS (SELECT kind, acronym, bool_or(NOT {_SAME}) AS conflict FROM f GROUP BY ALL)
SELECT o.kind, o.acronym, o.series, CAST(o.n AS BIGINT) AS n, o.files, o.names, c.conflict FROM o JOIN c ON o.kind = c.kind AND o.acronym = c.acronym WHERE rn = 1""")
def merged_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    return ac.merged(_mined(spark, sf)).select("kind", "acronym", "series", "n", "files", "names", "conflict")


@query(f"""WITH {_MINED}, {_MERGED}, k AS (SELECT upper(acronym) AS acronym, min(lower(canonical)) AS known_as FROM venue_acronyms GROUP BY 1),
{_same_ctes("SELECT o.kind, o.acronym, o.series, o.series AS a, k.known_as AS b FROM o LEFT JOIN k USING (acronym) WHERE o.rn = 1", 'kind, acronym, series').replace('s AS (', 's_ AS (').replace('FROM s)', 'FROM s_)')}
SELECT kind, acronym, series, b AS known_as, CASE WHEN b IS NULL THEN 'new' WHEN {_SAME} THEN 'existing' ELSE 'conflict' END AS state FROM f""")
def compared_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    return ac.compared(ac.merged(_mined(spark, sf)), table(spark, sf, "venue_acronyms")).select("kind", "acronym", "series", "known_as", "state")


@query("""WITH t AS (SELECT upper(a.acronym) AS acronym, min(v.variant) AS told FROM venue_acronym_variants v JOIN venue_acronyms a ON v.venue_acronym_id = a.id GROUP BY 1),
k AS (SELECT upper(acronym) AS acronym, arg_min(canonical, (canonical, id)) AS canonical, max(confidence_score) AS confidence_score FROM venue_acronyms GROUP BY 1)
SELECT coalesce(k.acronym, t.acronym) AS acronym, coalesce(told, canonical) AS canonical, CASE WHEN told IS NOT NULL THEN 0.0::DOUBLE ELSE confidence_score END AS confidence_score, coalesce(lower(told) <> lower(canonical), false) AS overwritten FROM k FULL JOIN t ON k.acronym = t.acronym""")
def learned_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "venue_acronyms")
    told = table(spark, sf, "venue_acronym_variants").join(a.select(F.col("id").alias("venue_acronym_id"), "acronym"), "venue_acronym_id").select("acronym", F.col("variant").alias("canonical"))
    return ac.learned(a, told)
