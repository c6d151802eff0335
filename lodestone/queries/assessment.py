"""Queries that judge one document of each software against its sources, and the SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.operators import assess, quality
from lodestone.queries.catalog import _ALIKE, _LICENSE_NORM, _W, ORACLE_SQL, QUERIES, _query

_QW = dims.lookup_sql("provider", "QUALITY_WEIGHT")
_FW = dims.lookup_sql("field", "FIELD_WEIGHT")


def _names(values) -> str:
    return ", ".join(repr(x) for x in values)


def _url(c: str) -> str:
    return rf"regexp_matches({c}, '{text.URL}')"


_INFERRED = "CASE WHEN provider IN ('apt', 'dnf', 'yum', 'zypper', 'pacman') THEN ['linux'] WHEN provider = 'brew' THEN ['macos', 'linux'] WHEN provider IN ('winget', 'scoop', 'choco') THEN ['windows'] WHEN provider IN ('npm', 'pypi', 'cargo') THEN ['linux', 'windows', 'macos'] END"
_FORMAT = f"CASE WHEN license IN ({_names(dims.SPDX_QUALITY)}) THEN 1.0e0 WHEN regexp_matches(license, '{text.LICENSE_LIKE}') THEN 0.8e0 ELSE 0.3e0 END"
_MARKS = "(length(description) - length(translate(description, '!@#$%^&*()', '')))"
_CLARITY = f"least(0.5e0 + CASE WHEN length(description) BETWEEN 20 AND 200 THEN 0.2e0 ELSE 0 END + CASE WHEN contains(description, '.') THEN 0.1e0 ELSE 0 END + CASE WHEN {_MARKS} / length(description) < 0.1 THEN 0.2e0 ELSE 0 END, 1)"
_DOCS = f"""it AS (SELECT software, item, min(seq * 10 + pos) AS place FROM (SELECT software, seq, unnest(platforms) item, generate_subscripts(platforms, 1) pos FROM catalog) GROUP BY 1, 2),
  pl AS (SELECT software, list(item ORDER BY place) AS platforms FROM it GROUP BY 1),
  doc AS (SELECT software, arg_max(description, length(description) * 100000000 - seq) FILTER (WHERE description <> '') AS description, arg_min(license, seq) FILTER (WHERE license <> '') AS license,
    arg_min(homepage, seq) FILTER (WHERE homepage <> '') AS website, arg_min(source_url, seq) FILTER (WHERE source_url <> '') AS source, arg_min(category, seq) FILTER (WHERE category <> '') AS category,
    count(DISTINCT provider) n_packages FROM catalog GROUP BY 1),
  src AS (SELECT software, provider, {_QW} w, c.description, c.license, c.homepage, {_LICENSE_NORM.replace('license', 'c.license')} norm, d.description dd, d.license dl FROM catalog c JOIN doc d USING (software)),
  sim AS (SELECT software, {_ALIKE} s FROM (SELECT software, {_W.format('dd')} wa, {_W.format('description')} wb FROM src WHERE description <> '' AND dd <> '')),
  al AS (SELECT software, avg(s) alike FROM sim GROUP BY 1),
  de AS (SELECT software, avg(w * w) + CASE WHEN count(*) > 1 THEN 0.2e0 * avg((description = dd)::INT) ELSE 0 END sure FROM src WHERE description <> '' AND dd <> '' GROUP BY 1),
  li AS (SELECT software, avg(w * w) + CASE WHEN count(*) > 1 THEN 0.2e0 * avg((license = dl)::INT) ELSE 0 END sure, avg((norm = {_LICENSE_NORM.replace('license', 'dl')})::INT) consistent FROM src WHERE license <> '' AND dl <> '' GROUP BY 1),
  ur AS (SELECT software, avg(w * w) sure FROM src WHERE homepage <> '' GROUP BY 1),
  pa AS (SELECT software, avg(w * w) sure FROM src GROUP BY 1),
  pr AS (SELECT software, avg(w * w) + CASE WHEN count(*) > 1 THEN 0.2e0 * avg((inferred = coalesce(platforms, []))::INT) ELSE 0 END sure FROM (SELECT DISTINCT software, {_QW} w, provider, {_INFERRED} inferred FROM catalog) LEFT JOIN pl USING (software) WHERE inferred IS NOT NULL GROUP BY 1),
  u AS (SELECT software, website, source, list_filter([website, source], lambda x: x <> '') l FROM doc),
  f AS (SELECT software, 'description' AS field, (least(length(description) / 100.0e0, 1) + coalesce(1 - alike, 0.5e0) + {_CLARITY}) / 3 AS quality, least(1, coalesce(sure, 0)) AS confidence FROM doc LEFT JOIN al USING (software) LEFT JOIN de USING (software) WHERE description <> ''
    UNION ALL SELECT software, 'license', ({_FORMAT} + coalesce(consistent, 0.5e0)) / 2, least(1, coalesce(sure + {_FORMAT}, 0)) FROM doc LEFT JOIN li USING (software) WHERE license <> ''
    UNION ALL SELECT software, 'platforms', (len(list_intersect(list_transform(platforms, lambda p: lower(p)), ['linux', 'windows', 'macos'])) / 3.0e0 + len(list_filter(platforms, lambda p: lower(p) IN ({_names(dims.PLATFORMS)}))) / len(platforms)) / 2, least(1, coalesce(sure, 0)) FROM pl LEFT JOIN pr USING (software)
    UNION ALL SELECT software, 'urls', (len(list_filter(l, lambda x: {_url('x')})) / len(l) + len(l) / 3.0e0) / 2, least(1, coalesce(sure, 0)) FROM u LEFT JOIN ur USING (software) WHERE len(l) > 0
    UNION ALL SELECT software, 'category', (1 + CASE WHEN lower(category) IN ({_names(dims.CATEGORIES)}) THEN 1.0e0 ELSE 0.5e0 END) / 2, 0.6e0 FROM doc WHERE category <> ''
    UNION ALL SELECT software, 'packages', 1.0e0, sure FROM doc JOIN pa USING (software))"""


@_query("catalog", "SELECT software, field, round(quality, 5) AS quality, round(confidence, 5) AS confidence FROM f", _DOCS)
def assess_fields(c):
    """Quality and confidence of each field of each software's document."""
    return assess.assess(assess.documents(c), c).select("software", "field", F.round("quality", 5).alias("quality"), F.round("confidence", 5).alias("confidence"))


@_query("catalog", f"SELECT software, round(sum({_FW} * quality) / sum({_FW}), 5) AS quality, round(sum({_FW} * confidence) / sum({_FW}), 5) AS confidence FROM f GROUP BY 1", _DOCS)
def assess_overall(c):
    return assess.overall(assess.assess(assess.documents(c), c))


@_query(
    "catalog",
    f"""SELECT software, 'description' AS field, unnest(list_filter([CASE WHEN length(description) < 20 THEN 'Description is very short' END, CASE WHEN description[1] = lower(description[1]) THEN 'Description should start with a capital letter' END], lambda x: x IS NOT NULL)) issue FROM doc WHERE description <> ''
    UNION ALL SELECT software, 'license', 'License format may not be standard SPDX identifier' FROM doc WHERE license <> '' AND {_FORMAT} < 0.8
    UNION ALL SELECT software, 'platforms', 'Platform ''' || unnest(list_filter(platforms, lambda p: lower(p) NOT IN ({_names(assess.USUAL_PLATFORMS)}))) || ''' may not be standard' FROM pl
    UNION ALL SELECT software, 'urls', unnest(list_filter([CASE WHEN coalesce(website, '') = '' THEN 'Website URL is missing' END, CASE WHEN website <> '' AND NOT {_url('website')} THEN 'Invalid URL format for website' END, CASE WHEN source <> '' AND NOT {_url('source')} THEN 'Invalid URL format for source' END], lambda x: x IS NOT NULL)) FROM u WHERE len(l) > 0""",
    _DOCS,
)
def assess_issues(c):
    """What is wrong with each field, in words."""
    return assess.assess(assess.documents(c), c).select("software", "field", F.explode("issues").alias("issue"))


_FIRST = "fv AS (SELECT software, provider, arg_min({0}, seq) FILTER (WHERE {0} <> '') AS value, min(seq) seq FROM catalog GROUP BY 1, 2 HAVING value IS NOT NULL)"
_PAIRED = f"""{_FIRST.format('description')}, pw AS (SELECT a.software, a.seq, a.value, a.value <> b.value differ, {_W.format('a.value')} wa, {_W.format('b.value')} wb, a.seq < b.seq earlier FROM fv a JOIN fv b ON a.software = b.software AND a.provider <> b.provider),
  ps AS (SELECT software, seq, value, differ, earlier, {_ALIKE} s FROM pw),
  me AS (SELECT software, seq, value, sum(CASE WHEN differ THEN s ELSE 0 END) total, count(*) FILTER (WHERE earlier AND round(s, 9) < 0.5) n FROM ps GROUP BY ALL),
  alone AS (SELECT software, seq, value, 0.0e0 total, 0 n FROM fv QUALIFY count(*) OVER (PARTITION BY software) = 1),
  cs AS (SELECT software, sum(n)::BIGINT n_conflicts, count(*) n, arg_min(value, (-round(total, 9), seq)) consensus FROM (SELECT * FROM me UNION ALL SELECT * FROM alone) GROUP BY 1)"""
_CROSSED = "SELECT software, consensus, n_conflicts, round(1 - n_conflicts / greatest(n * (n - 1) / 2, 1), 6) agreement FROM {0}"
_VERSIONED = f"""{_FIRST.format('version')}, vk AS (SELECT *, list_transform(regexp_extract_all(value, '\\d+'), lambda x: x::HUGEINT) k FROM fv),
  vc AS (SELECT a.software, count(*) FILTER (WHERE a.seq < b.seq AND a.k[1] <> b.k[1]) n_conflicts, count(DISTINCT a.provider) n FROM vk a JOIN vk b USING (software) GROUP BY 1),
  cv AS (SELECT vc.*, value consensus FROM vc JOIN (SELECT software, value FROM vk QUALIFY row_number() OVER (PARTITION BY software ORDER BY k DESC, seq) = 1) USING (software))"""

# the queries are registered with the others that compare sources
for _name, _with, _of in (("crossref_descriptions_similar", _PAIRED, "cs"), ("crossref_versions_compatible", _VERSIONED, "cv")):
    ORACLE_SQL[_name] = ORACLE_SQL["crossref_names"].split(", l AS (")[0] + f", {_with} {_CROSSED.format(_of)}"


def _crossed(c):
    return {"descriptions": quality.cross_reference_texts(c, F.col("description")), "versions": quality.cross_reference_versions(c, F.col("version"))}


@_query(
    "catalog",
    """SELECT software, field, issue FROM (SELECT software, 'descriptions' AS field, unnest([CASE WHEN n_conflicts > 0 THEN 'Conflicting descriptions found across sources: ' || n_conflicts || ' conflicts detected' END,
        CASE WHEN a < 0.7 THEN 'Low agreement score (' || printf('%.2f', a) || ') for descriptions' END]) issue FROM (SELECT *, round(1 - n_conflicts / greatest(n * (n - 1) / 2, 1), 6) a FROM cs)
       UNION ALL SELECT software, 'versions', unnest([CASE WHEN n_conflicts > 0 THEN 'Conflicting versions found across sources: ' || n_conflicts || ' conflicts detected' END,
        CASE WHEN a < 0.7 THEN 'Low agreement score (' || printf('%.2f', a) || ') for versions' END]) FROM (SELECT *, round(1 - n_conflicts / greatest(n * (n - 1) / 2, 1), 6) a FROM cv)) WHERE issue IS NOT NULL""",
    f"{_PAIRED}, {_VERSIONED.replace('fv', 'fw')}",
)
def consistency_issues(c):
    """Fields in which the sources of a software conflict, or agree too little."""
    return assess.consistency_issues(_crossed(c))


@_query("catalog")
def recommendations(c):
    """What would improve each software's document. Its numbers come from the queries above."""
    return assess.recommendations(assess.assess(assess.documents(c), c), assess.consistency_issues(_crossed(c)))
