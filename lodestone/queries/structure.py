"""Queries on nested documents, configurations, records, support, agreement, instruction pairs, streams and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.operators import configurations, dataset, documents, records, resolve, support
from lodestone.plans.views import view, view_sql
from lodestone.queries.catalog import _DEFAULTS, _POINTS, _WELL, ORACLE_SQL, QUERIES, _defaults, _picked, _query
from lodestone.sources import readers, sinks
from lodestone.streaming import health


def _list(of: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in of)


# --- documents in layers

_RELATED = "(starts_with(o.path, q.path || '.') OR starts_with(q.path, o.path || '.'))"
_LIVE = f"""one AS (SELECT doc, path, max(seq) AS last FROM layers GROUP BY 1, 2),
  live AS (SELECT * FROM one o WHERE NOT EXISTS (SELECT 1 FROM one q WHERE q.doc = o.doc AND q.last > o.last AND {_RELATED})),
  topv AS (SELECT o.doc, o.path, o.last, l.value, l.items FROM live o JOIN layers l ON l.doc = o.doc AND l.path = o.path AND l.seq = o.last)"""
_FLOOR = f"""flr AS (SELECT o.doc, o.path, coalesce(max(q.seq), -1) f FROM topv o LEFT JOIN layers q ON q.doc = o.doc AND q.seq < o.last AND ((q.path = o.path AND q.items IS NULL) OR {_RELATED}) GROUP BY 1, 2),
  itm AS (SELECT doc, path, item, min((seq, pos)) AS place FROM (SELECT l.doc, l.path, seq, unnest(items) item, generate_subscripts(items, 1) pos FROM layers l JOIN flr ON flr.doc = l.doc AND flr.path = l.path AND l.seq > f) GROUP BY 1, 2, 3),
  joined AS (SELECT doc, path, string_agg(item, ',' ORDER BY place) AS items FROM itm GROUP BY 1, 2)"""


@_query("layers", "SELECT topv.doc, topv.path, value, CASE WHEN topv.items IS NOT NULL THEN joined.items END AS items FROM topv LEFT JOIN joined ON joined.doc = topv.doc AND joined.path = topv.path", f"{_LIVE}, {_FLOOR}")
def document_merge(rows):
    """Layers laid on each other: lists joined, objects and plain values replacing each other."""
    return documents.merge_trees(rows).select("doc", "path", "value", F.array_join("items", ",").alias("items"))


@_query("layers", "SELECT doc, path, value, array_to_string(items, ',') AS items FROM topv WHERE value IS NOT NULL OR items IS NOT NULL", _LIVE)
def document_merge_deleting(rows):
    """The same with nulls that delete, and lists that replace each other."""
    return documents.merge_trees(rows, deletes=True).select("doc", "path", "value", F.array_join("items", ",").alias("items"))


_RENAMED = """ren AS (SELECT software, provider, seq, value, CASE WHEN path LIKE 'services.default%' THEN 'services.' || provider || substr(path, 17) WHEN path LIKE 'services.%' THEN 'services.' || provider || '_' || substr(path, 10)
    WHEN path LIKE 'ports.%' THEN 'ports.' || provider || '_' || substr(path, 7) WHEN path LIKE 'packages.default%' THEN 'packages.' || provider || substr(path, 17) ELSE path END AS path
    FROM sections WHERE value <> '' AND path NOT LIKE 'packages.other%')"""


@_query("sections", "SELECT software, path, arg_min(value, (CASE WHEN path = 'description' THEN -length(value) ELSE 0 END, seq)) AS value FROM ren GROUP BY 1, 2", _RENAMED)
def provider_configurations(rows):
    """Configurations of providers as one document of each software."""
    return documents.merged_configurations(rows)


_LEAVES = "lv AS (SELECT provider, path, arg_max(value, seq) AS value FROM sections WHERE value IS NOT NULL GROUP BY 1, 2), df AS (SELECT path, arg_max(value, seq) AS v FROM sections WHERE value IS NOT NULL AND provider = 'apt' GROUP BY 1)"
_HINTED = {p: " OR ".join(f"contains(lower(t), '{h.lower()}')" for h in hs) for p, hs in configurations.HINTS.items()}
_JUDGED = f"""{_LEAVES}, ky AS (SELECT provider, split_part(lv.path, '.', 1) AS key, bool_and(df.path IS NOT NULL AND value IS NOT DISTINCT FROM v) same FROM lv LEFT JOIN df ON df.path = lv.path GROUP BY 1, 2),
  kc AS (SELECT provider, count(*) FILTER (WHERE NOT same OR key = 'version') nec, count(*) FILTER (WHERE same AND key <> 'version') red, count(*) FILTER (WHERE key NOT IN ('version', 'supported')) extra, count(*) FILTER (WHERE provider = 'apt' AND key = 'supported') bad FROM ky GROUP BY 1),
  sd AS (SELECT provider, bool_or(path = 'supported' AND lower(value) = 'false') off, bool_or(path = 'packages.default.name') named, {", ".join(f"bool_or({h}) on_{p}" for p, h in _HINTED.items())} FROM (SELECT *, concat_ws(' ', provider, path, value) t FROM lv) GROUP BY 1),
  ju AS (SELECT provider, off, nec, red, extra, bad, CASE WHEN named THEN 0 ELSE CASE provider WHEN 'apt' THEN on_linux::INT WHEN 'brew' THEN on_linux::INT + on_macos::INT WHEN 'winget' THEN on_windows::INT ELSE 0 END END mis FROM kc JOIN sd USING (provider)),
  va AS (SELECT provider, NOT off AS supported, CASE WHEN off THEN 0 ELSE nec END::BIGINT n_necessary, CASE WHEN off THEN extra ELSE red END::BIGINT n_redundant, CASE WHEN off THEN (extra > 0)::INT ELSE bad END::BIGINT n_issues, CASE WHEN off THEN 0 ELSE mis END::BIGINT n_missing,
    round(CASE WHEN off THEN CASE WHEN extra > 0 THEN 0.5e0 ELSE 0.8e0 END ELSE greatest(0, least(1, nec / (nec + red) - least(0.3e0, 0.1e0 * mis) - least(0.2e0, 0.05e0 * bad))) END, 6) AS quality, round(CASE WHEN off THEN 0 ELSE red / (nec + red) END, 6) potential FROM ju)"""


def _validated(rows: DataFrame) -> DataFrame:
    leaves = rows.where("value is not null").groupBy("provider", "path").agg(F.max_by("value", "seq").alias("value"))
    return configurations.validated(leaves, leaves.where("provider = 'apt'").select("path", "value"))


@_query("sections", "SELECT * FROM va", _JUDGED)
def override_validation(rows):
    """Each provider's configuration against that of one of them, which stands for the defaults."""
    return _validated(rows)


@_query("sections", "SELECT count(*) n, round(avg(quality), 5) AS quality, sum(n_redundant)::BIGINT n_redundant, count(*) FILTER (WHERE potential > 0.5) high, count(*) FILTER (WHERE potential > 0.2 AND potential <= 0.5) AS medium, count(*) FILTER (WHERE potential <= 0.2) low FROM va", _JUDGED)
def configuration_consistency(rows):
    return configurations.consistency(_validated(rows))


# --- records

#: Types that the documents of the view ``jsons`` are to have.
SCHEMA = {
    "type": "object",
    "properties": {
        "version": {"type": ["string", "null"]}, "description": {"type": ["string", "null"]}, "platforms": {"type": "array", "items": {"type": "string"}},
        "urls": {"type": ["object", "null"], "additionalProperties": {"type": ["string", "null"]}}, "category": {"type": "object"},
        "packages": {"type": "object", "additionalProperties": {"type": "object", "properties": {"name": {"type": "string"}}}},
        "ports": {"type": "object", "additionalProperties": {"type": "object", "properties": {"port": {"type": ["integer", "null"]}}}},
    },
}
_OK = "(json IS NOT NULL AND seq % 31 <> 0)"


@_query(
    "jsons",
    f"""SELECT seq, unnest(list_filter([CASE WHEN json IS NOT NULL AND seq % 31 = 0 THEN '$: JSON' END, CASE WHEN {_OK} AND seq % 5 IN (1, 4) THEN '$.version: string|null' END, CASE WHEN {_OK} AND seq % 4 = 3 THEN '$.description: string|null' END,
        CASE WHEN {_OK} AND seq % 6 = 4 THEN '$.urls.website: string|null' END, CASE WHEN {_OK} AND seq % 3 = 2 THEN '$.category: object' END, CASE WHEN {_OK} AND seq % 7 = 1 THEN '$.platforms[1]: string' END, CASE WHEN {_OK} AND seq % 7 = 2 THEN '$.platforms: array' END,
        CASE WHEN {_OK} AND seq % 4 = 3 THEN '$.packages.b.name: string' END, CASE WHEN {_OK} AND seq % 5 = 2 THEN '$.ports.http.port: integer|null' END], lambda x: x IS NOT NULL)) issue FROM jsons""",
)
def schema_issues(rows):
    """Documents against a nested schema of types."""
    return rows.select("seq", F.explode(records.schema_issues(F.col("json"), SCHEMA)).alias("i")).select("seq", F.concat("i.path", F.lit(": "), "i.expected").alias("issue"))


_J = "json_extract(json, '$.{0}')"
_FULL = "(json_type(json, '$.{0}') IS NOT NULL AND json_type(json, '$.{0}') <> 'NULL' AND coalesce(trim(json_extract_string(json, '$.{0}')), '') <> '' AND json_extract(json, '$.{0}')::VARCHAR NOT IN ('[]', '{{}}'))"
_VALID = "valid AS (SELECT seq, json FROM jsons WHERE json IS NOT NULL AND json_valid(json))"


@_query("jsons", "SELECT seq, concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_FULL.format(p)} THEN '{p}' END" for p in records.FIELDS) + ") AS missing FROM valid", _VALID)
def missing_paths(rows):
    """Fields that documents don't fill, of all that can be filled in."""
    return rows.where(F.try_parse_json("json").isNotNull()).select("seq", F.array_join(records.missing_fields(F.col("json")), ",").alias("missing"))


@_query(
    "jsons",
    f"""SELECT seq, unnest(list_filter([CASE WHEN NOT {_FULL.format('version')} THEN 'error version' END, CASE WHEN NOT {_FULL.format('packages')} THEN 'warning packages' END, CASE WHEN NOT {_FULL.format('description')} THEN 'warning description' END,
        CASE WHEN NOT {_FULL.format('category.default')} THEN 'warning category.default' END, 'warning license', CASE WHEN NOT {_FULL.format('platforms')} THEN 'warning platforms' END, CASE WHEN seq % 4 = 1 THEN 'error packages.default.name' END, CASE WHEN seq % 4 = 3 THEN 'error packages.a.name' END,
        CASE WHEN seq % 5 IN (1, 3, 4) THEN 'error ports.http.number' END], lambda x: x IS NOT NULL)) issue FROM valid""",
    _VALID,
)
def record_issues(rows):
    """Documents against the rules for records."""
    found = rows.where(F.try_parse_json("json").isNotNull()).select("seq", F.explode(records.record_issues(F.col("json"))).alias("i"))
    return found.select("seq", F.concat("i.level", F.lit(" "), "i.path").alias("issue"))


@_query(
    "jsons",
    f"""SELECT seq, round((0.1e0 * {_FULL.format('version')}::INT + 0.2e0 * {_FULL.format('description')}::INT + 0.1e0 * {_FULL.format('platforms')}::INT + 0.1e0 * CASE seq % 6 WHEN 1 THEN 2 / 3.0e0 WHEN 2 THEN 1 / 3.0e0 WHEN 4 THEN 1 / 3.0e0 WHEN 5 THEN 1 ELSE 0 END
        + 0.15e0 * CASE seq % 3 WHEN 1 THEN 0.5e0 ELSE 1 END + 0.2e0 * CASE seq % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.5e0 WHEN 2 THEN 0 ELSE 1 END), 6) completeness, length(json) // 4 + 900 AS tokens FROM valid""",
    _VALID,
)
def record_completeness(rows):
    """Documents by the weights of their fields, with partial credit, and the tokens of a request for two additions."""
    return rows.where(F.try_parse_json("json").isNotNull()).select("seq", F.round(records.completeness(F.col("json")), 6).alias("completeness"), records.estimated_tokens(F.col("json"), 2).alias("tokens"))


_TYPED = "version string, description string, category struct<default:string,sub:string>, platforms array<string>"


@_query(
    "jsons",
    """SELECT seq, CASE seq % 5 WHEN 0 THEN '0.1' WHEN 1 THEN '0.1' WHEN 3 THEN '' WHEN 4 THEN '[1]' END AS version, CASE WHEN seq % 3 = 0 THEN 'web' END default_category, CASE WHEN seq % 3 = 1 THEN 'x' END sub_category,
       CASE seq % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 1 END n_platforms FROM valid WHERE seq % 3 <> 2 AND seq % 7 <> 2""",
    _VALID,
)
def typed_load(rows):
    """Documents as structs: unknown members are dropped."""
    t = rows.where(F.try_parse_json("json").isNotNull() & (F.col("seq") % 3 != 2) & (F.col("seq") % 7 != 2)).select("seq", records.typed(F.col("json"), _TYPED).alias("t"))
    return t.select("seq", "t.version", F.col("t.category.default").alias("default_category"), F.col("t.category.sub").alias("sub_category"), F.coalesce(F.size("t.platforms"), F.lit(-1)).alias("n_platforms"))


@_query(
    "jsons",
    f"""SELECT seq, CASE WHEN seq % 3 = 2 THEN 'Category data must be a dictionary' WHEN seq % 3 = 1 THEN 'Category data must have ''default'' field' END category_reason,
       CASE WHEN seq % 6 = 3 THEN 'Field data must be a dictionary' WHEN seq % 6 = 2 THEN 'URL field ''website'' must be a valid HTTP/HTTPS URL' WHEN seq % 6 = 4 THEN 'URL field ''website'' must be a string' END fields_reason FROM valid WHERE {_J.format('urls')} IS NOT NULL""",
    _VALID,
)
def response_reasons(rows):
    """Why answers on categories and fields are not taken: here these parts of each document."""
    of = lambda p: F.to_json(records.at(F.try_parse_json("json"), p))
    return rows.where(F.try_parse_json("json").isNotNull()).select("seq", records.category_reason(of("category")).alias("category_reason"), records.fields_reason(of("urls")).alias("fields_reason"))


_TREE = """tr AS (SELECT valid.seq, t.fullkey, t.type, t.value, t.atom, t.path AS up FROM valid, json_tree(valid.json) t),
  lf AS (SELECT seq, substr(fullkey, 3) AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'boolean' END AS kind,
    CASE WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') ELSE replace(value::VARCHAR, ' ', '') END AS value FROM tr WHERE fullkey <> '$' AND NOT contains(fullkey, '[') AND (type <> 'OBJECT' OR value::VARCHAR = '{}'))"""


@_query("jsons", "SELECT * FROM lf", f"{_VALID}, {_TREE}")
def flatten_documents(rows):
    """Nested documents as paths, types and values."""
    return records.flattened(rows, "seq", "json").select("seq", "path", "kind", F.when(F.col("kind") == "string", F.col("value")).otherwise(F.replace("value", F.lit(" "), F.lit(""))).alias("value"))


@_query("jsons", "SELECT signature, count(*) n FROM (SELECT seq, string_agg(path || ':' || kind, ',' ORDER BY path || ':' || kind) AS signature FROM lf GROUP BY 1) GROUP BY 1", f"{_VALID}, {_TREE}")
def structure_distribution(rows):
    """How many documents have which structure."""
    return records.signatures(records.flattened(rows, "seq", "json"), "seq")


@_query(
    "catalog",
    """SELECT 'name' AS what, CASE WHEN contains(name, '{{') AND contains(name, '}}') THEN 'templated' WHEN contains(name, '-') THEN 'hyphenated' WHEN contains(name, '_') THEN 'underscored' WHEN lower(name) <> upper(name) AND name = lower(name) THEN 'lowercase'
       WHEN lower(name) <> upper(name) AND name = upper(name) THEN 'uppercase' ELSE 'mixed_case' END pattern, count(*) n FROM catalog WHERE name IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'category', CASE WHEN contains(category, '_') THEN 'snake_case' WHEN lower(category) <> upper(category) AND category = lower(category) THEN 'lowercase' WHEN category <> lower(category) THEN 'camelCase' ELSE 'other' END, count(*) FROM catalog WHERE category IS NOT NULL GROUP BY ALL""",
)
def naming_patterns(c):
    of = lambda what, col, pattern: c.where(F.col(col).isNotNull()).groupBy(F.lit(what).alias("what"), pattern(F.col(col)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return of("name", "name", records.name_pattern).union(of("category", "category", records.key_pattern))


@_query("sections", "SELECT DISTINCT provider, split_part(path, '.', 1) AS key FROM sections WHERE split_part(path, '.', 1) NOT IN ('version', 'supported')")
def extra_keys(rows):
    return configurations.extra_keys(rows)


@_query("sections", f"SELECT provider, bool_or(split_part(lv.path, '.', 1) NOT IN ('version', 'supported') AND value <> '' AND NOT coalesce(value = v, false)) AS meaningful FROM lv LEFT JOIN df ON df.path = lv.path GROUP BY 1", _LEAVES)
def meaningful_overrides(rows):
    """Whether providers' files say anything that the defaults don't."""
    leaves = rows.where("value is not null").groupBy("provider", "path").agg(F.max_by("value", "seq").alias("value"))
    return configurations.meaningful(leaves, leaves.where("provider = 'apt'").select("path", "value"))


_BOTH = """a AS (SELECT software, provider, max(score) s FROM catalog WHERE license IS NOT NULL GROUP BY 1, 2), b AS (SELECT software, provider, max(score) t FROM catalog WHERE category IS NOT NULL GROUP BY 1, 2),
  me AS (SELECT coalesce(a.software, b.software) AS key, coalesce(a.provider, b.provider) AS field, coalesce(least(1, s * 1.2e0), t * 0.8e0) score FROM a FULL JOIN b ON a.software = b.software AND a.provider = b.provider)"""


@_query("catalog", "SELECT key, field, round(score, 5) AS score FROM me UNION ALL SELECT key, 'overall', round(avg(score), 5) FROM me GROUP BY 1", _BOTH)
def merge_confidence_overall(c):
    best = lambda f: c.where(F.col(f).isNotNull()).groupBy(F.col("software").alias("key"), F.col("provider").alias("field")).agg(F.max("score").alias("score"))
    return resolve.with_overall(resolve.merged_confidence(best("license"), best("category"))).withColumn("score", F.round("score", 5))


# --- support, agreement, whole documents

_TEMPLATES = [("apt", None), ("brew", None), ("npm", True), ("helm", True), ("yum", None), ("spack", None), ("apk", False), ("cargo", True), ("gem", None)]
_TEMPLATE_SQL = ", ".join(f"('{p}', {'NULL' if s is None else s})" for p, s in _TEMPLATES)
_ASKED = "apt helm yum spack apk cargo gem conda".split()
_LIKELY = "CASE provider " + " ".join(f"WHEN '{p}' THEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in ws) for p, ws in support.KEYWORDS.items()) + " ELSE true END"


@_query(
    "catalog",
    f"""SELECT name, r.provider, CASE WHEN k.provider IS NOT NULL THEN h.name IS NOT NULL WHEN t.provider IS NULL OR t.s = false THEN false ELSE {_LIKELY.replace('CASE provider', 'CASE r.provider').replace('name)', 'r.name)')} END AS supported,
        CASE WHEN k.provider IS NOT NULL THEN 'repository' WHEN t.provider IS NULL THEN 'no template' WHEN t.s = false THEN 'template' ELSE 'rule' END reason
        FROM req r LEFT JOIN had h USING (name, provider) LEFT JOIN (SELECT DISTINCT provider FROM had) k ON k.provider = r.provider LEFT JOIN tem t ON t.provider = r.provider""",
    f"had AS (SELECT DISTINCT name, provider FROM catalog), tem(provider, s) AS (VALUES {_TEMPLATE_SQL}), req AS (SELECT DISTINCT name, unnest([{_list(_ASKED)}]) provider FROM catalog UNION SELECT DISTINCT 'gnu-' || category || '-server', unnest([{_list(_ASKED)}]) FROM catalog WHERE category <> '')",
)
def provider_supported(c):
    """Whether providers have a software: by what they list, else by templates and rules."""
    templates = c.sparkSession.createDataFrame(_TEMPLATES, "provider string, supported boolean")
    each = F.explode(F.array(*map(F.lit, _ASKED))).alias("provider")
    more = c.where(text.truthy(F.col("category"))).select(F.concat(F.lit("gnu-"), "category", F.lit("-server")).alias("name")).distinct()
    return support.supported(c.select("name").distinct().union(more).distinct().select("name", each), c, templates)


_MORE = f"""raw2 AS (SELECT software, provider, seq, ts, unnest(['version', 'name', 'category.default']) AS field, unnest([version, name, category]) AS v FROM catalog),
  more AS (SELECT software, field, v AS value, provider, seq, ts, {dims.lookup_sql('provider', 'PRIORITY')} priority, round(least({dims.lookup_sql('provider', 'RELIABILITY')}, 1), 9) confidence FROM raw2 WHERE v <> '')"""


def _from(order: str, where: str, table: str = "points") -> str:
    return _picked(order).replace("FROM points", f"FROM {table} WHERE {where}")


@_query(
    "catalog",
    f"""SELECT software, field, value, round(n / a * (c / n), 6) confidence FROM tot WHERE r = 1 AND field = 'license' UNION ALL ({_from('length(value) DESC', "field = 'description'")}) UNION ALL ({_from('confidence DESC', "starts_with(field, 'urls.')")})
       UNION ALL ({_from('ts IS NULL, coalesce(ts, 0) DESC, CASE WHEN ts IS NULL THEN confidence END DESC', "field = 'version'", 'more')}) UNION ALL ({_from('priority DESC', "field = 'name'", 'more')}) UNION ALL ({_from('confidence DESC', "field = 'category.default'", 'more')})""",
    f"""{_POINTS}, {_MORE}, each AS (SELECT software, field, value, count(*) n, min(seq) f, sum(confidence) c FROM points GROUP BY ALL),
        tot AS (SELECT *, sum(n) OVER (PARTITION BY software, field) a, row_number() OVER (PARTITION BY software, field ORDER BY n DESC, f) r FROM each)""",
)
def resolve_fields(c):
    """All fields of each software, each by its own strategy."""
    return resolve.resolved(resolve.data_points(c, resolve.MORE_FIELDS))


@_query("catalog", "SELECT software, field, md5(value) AS value_md5, provider, round(confidence, 6) confidence, priority, seq FROM points JOIN (SELECT software, field FROM points GROUP BY 1, 2 HAVING count(DISTINCT value) > 1) USING (software, field)", _POINTS)
def conflicting_values(c):
    """Every value of the fields in which sources differ."""
    return resolve.conflicting_values(resolve.data_points(c)).select("software", "field", F.md5("value").alias("value_md5"), "provider", F.round("confidence", 6).alias("confidence"), "priority", "seq")


_ONE = """dc AS (SELECT software, arg_min(description, seq) FILTER (WHERE description <> '') AS description, arg_min(license, seq) FILTER (WHERE license <> '') AS license, arg_min(homepage, seq) FILTER (WHERE homepage <> '') AS homepage, arg_min(source_url, seq) FILTER (WHERE source_url <> '') AS source_url,
    arg_min(platforms, seq) FILTER (WHERE len(platforms) > 0) AS platforms FROM catalog GROUP BY 1),
  sh AS (SELECT software, 'description' AS field, avg(coalesce(c.description = d.description, false)::INT) s FROM catalog c JOIN dc d USING (software) WHERE d.description <> '' GROUP BY 1 UNION ALL SELECT software, 'license', avg(coalesce(c.license = d.license, false)::INT) FROM catalog c JOIN dc d USING (software) WHERE d.license <> '' GROUP BY 1
    UNION ALL SELECT software, 'urls.website', avg(coalesce(c.homepage = d.homepage, false)::INT) FROM catalog c JOIN dc d USING (software) WHERE d.homepage <> '' GROUP BY 1 UNION ALL SELECT software, 'urls.source', avg(coalesce(c.source_url = d.source_url, false)::INT) FROM catalog c JOIN dc d USING (software) WHERE d.source_url <> '' GROUP BY 1
    UNION ALL SELECT software, 'platforms.' || p, avg(coalesce(list_contains(c.platforms, p), false)::INT) FROM catalog c JOIN (SELECT software, unnest(platforms) p FROM dc) USING (software) GROUP BY software, p)"""


@_query("catalog", "SELECT software, field, round(s, 5) AS share FROM sh UNION ALL SELECT software, 'overall', round(avg(s), 5) FROM sh GROUP BY 1", _ONE)
def agreement_shares(c):
    """Of each field of a software's first values, the share of its sources that agree."""
    first = lambda k, ok: F.min_by(k, F.when(ok, F.col("seq"))).alias(k)
    docs = c.groupBy("software").agg(*(first(k, text.truthy(F.col(k))) for k in resolve.FIELDS), first("platforms", F.size("platforms") > 0))
    return resolve.agreement(docs, c)


@_query(
    "catalog",
    """SELECT doc, path, md5(value) AS value_md5, items FROM (SELECT seq AS doc, unnest(['packages.default.name', 'packages.default.version', 'description', 'urls.website', 'urls.source', 'license']) AS path, unnest([name, version, description, homepage, source_url, license]) AS value, NULL AS items FROM catalog) WHERE value <> ''
       UNION ALL SELECT seq, 'platforms', NULL, array_to_string(platforms, ',') FROM catalog WHERE len(platforms) > 0""",
)
def package_configuration(c):
    """Packages as leaves of configurations."""
    return resolve.as_configuration(c).select("doc", "path", F.md5("value").alias("value_md5"), F.array_join("items", ",").alias("items"))


# --- instruction pairs

_LABEL = "CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.8 THEN 'high_quality' WHEN confidence >= 0.6 THEN 'medium_quality' WHEN confidence >= 0.4 THEN 'low_quality' ELSE 'poor_quality' END"


@_query(
    "pairs",
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value, count(*) n, round(avg(confidence), 5) mean_confidence FROM pairs WHERE {v} IS NOT NULL GROUP BY ALL" for d, v in (("all", "'all'"), ("category", "coalesce(category, template, 'unknown')"), ("template", "template"), ("quality", _LABEL))),
)
def dataset_totals(p):
    """Numbers and mean confidence in all, and by category, template and label."""
    return dataset.statistics(p)


@_query("pairs", "SELECT CASE WHEN confidence IS NULL THEN 'no_confidence' WHEN confidence >= 0.8 THEN 'high_confidence' WHEN confidence >= 0.5 THEN 'medium_confidence' ELSE 'low_confidence' END stratum, count(*) n FROM pairs GROUP BY 1")
def strata_by_confidence(p):
    return dataset.strata_sizes(p, "confidence")


@_query("pairs", "SELECT id, '<source>' || instruction || chr(10) || chr(10) || 'Input: ' || input || '</source><target>' || output || '</target>' AS seq2seq, 'Instruction: ' || instruction || chr(10) || 'Input: ' || input || chr(10) || 'Output: ' || output AS labelled FROM pairs")
def format_training(p):
    return p.select("id", dataset.seq2seq_text().alias("seq2seq"), dataset.labelled_text().alias("labelled"))


@_query("pairs", "SELECT greatest(a[1 + len(a) // 2] * len(a), 10 * len(a)) AS size FROM (SELECT list_sort(list(n)) a FROM (SELECT count(*) n FROM pairs GROUP BY coalesce(category, template, 'unknown')))")
def balanced_size(p):
    """Rows of a dataset with as many of each stratum as the one in the middle has."""
    return p.sparkSession.createDataFrame([(dataset.balanced_size(dataset.strata_sizes(p)),)], "size long")


#: Wordings of the instructions of the view ``pairs``.
_OTHER = {"Generate": ["Produce", "Create", "Build"], "Categorize": ["Classify"], "Enhance the text": ["Improve the text", "Refine the text"]}


def _drawn(salt: str) -> str:
    return f"(CAST('0x' || md5(id || '#42' || {salt})[1:8] AS BIGINT) / 4294967296.0e0)"


def _choice(others: list[str], salt: str) -> str:
    return f"list_extract([{_list(others)}], 1 + floor({_drawn(salt)} * {len(others)})::BIGINT)"


_VARIED = "CASE " + " ".join(f"WHEN contains(lower(instruction), '{k.lower()}') THEN replace(instruction, '{k}', {_choice(v, "sa || 'v'")})" for k, v in _OTHER.items()) + " ELSE instruction END"
_PHRASED = "input"
for _i, (_k, _v) in enumerate(dataset.PHRASES.items()):
    _PHRASED = f"CASE WHEN {_drawn(f"sa || 'p{_i}'")} < 0.3 THEN regexp_replace({_PHRASED}, '(?i)\\b{_k}\\b', '{_v}', 'g') ELSE {_PHRASED} END" if _i == 0 else _PHRASED


@_query(
    "pairs",
    f"SELECT id, copy, i2 AS instruction, round(greatest(confidence * 0.95e0, 0.1e0), 6) confidence FROM (SELECT *, CASE WHEN {_drawn("sa || 'I'")} < 0.4 THEN {_VARIED} ELSE instruction END i2 FROM sal) WHERE i2 <> instruction",
    "sal AS (SELECT pairs.*, copy, '#' || copy sa FROM pairs, (SELECT unnest([1, 2]) copy))",
)
def augment_instructions(p):
    """Two attempts at another wording of each instruction."""
    return dataset.variants(p, 2, _OTHER, phrases=0, synonyms=0, spacing=0).select("id", "copy", "instruction", F.round("confidence", 6).alias("confidence"))


@_query("pairs")
def augment_inputs(p):
    """Phrases, synonyms and spacing of inputs; tested against plain Python."""
    return dataset.variants(p, 1, {}, phrases=0.5, synonyms=0.5, spacing=0.5).select("id", "copy", "input")


# --- streams and files

_EVENTS = "ev AS (SELECT 'user=' || (user_id % 7) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS id, event_type = 'error' AS failure, event_type = 'error' AND value > 480 AS permanent FROM events WHERE event_type IN ('error', 'purchase'))"


def health_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failures and purchases as recoveries of seven providers, as a stream that is drained: the state after
    each event."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    failure = F.col("event_type") == "error"
    keyed = events.where("event_type in ('error', 'purchase')").select(
        F.concat(F.lit("user="), (F.col("user_id") % 7).cast("string")).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), failure.alias("failure"), (failure & (F.col("value") > 480)).alias("permanent")
    )
    return health.drained(spark, health.provider_states(keyed, "0 seconds"))


QUERIES["health_stream"] = health_stream
ORACLE_SQL["health_stream"] = f"""WITH {_EVENTS},
    rc AS (SELECT a.key, a.id, count(b.id) recent FROM ev a LEFT JOIN ev b ON b.key = a.key AND b.failure AND b.ts > a.ts - 3600 AND (b.ts, b.id) <= (a.ts, a.id) GROUP BY 1, 2),
    nu AS (SELECT ev.*, recent, row_number() OVER w p FROM ev JOIN rc USING (key, id) WINDOW w AS (PARTITION BY key ORDER BY ts, id)),
    tr AS (SELECT *, max(CASE WHEN failure AND (permanent OR recent >= 3) THEN p END) OVER w hit, max(CASE WHEN NOT failure THEN p END) OVER w lift FROM nu WINDOW w AS (PARTITION BY key ORDER BY p)),
    st AS (SELECT *, coalesce(hit > coalesce(lift, 0), false) down FROM tr),
    be AS (SELECT *, coalesce(lag(down) OVER (PARTITION BY key ORDER BY p), false) before FROM st),
    lo AS (SELECT *, coalesce(bool_or(permanent AND NOT before) OVER (PARTITION BY key ORDER BY p), false) lost FROM be)
    SELECT key, id, ts, recent, NOT (down OR lost) AS available, lost AS permanent, CASE WHEN failure AND down AND NOT before THEN 'marked_unavailable' WHEN NOT failure AND before THEN 'recovered' END AS event FROM lo"""


def sources_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written as JSON lines and read back by the reader of that format."""
    c = view(spark, sf_dir, "catalog").select("name", "version", F.regexp_replace("description", r"[\x00-\x1f]", " ").alias("comment"), F.col("homepage").alias("www"))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    path = f"{base or tempfile.mkdtemp(prefix='lodestone-')}/files/{uuid.uuid4().hex}"
    sinks.export_report(c, path, "jsonl")
    back = readers.json_lines(spark, path)
    return back.groupBy("name", F.coalesce("version", F.lit("")).alias("version")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("description")).alias("chars"), F.count("homepage").alias("n_homepages"))


QUERIES["sources_roundtrip"] = sources_roundtrip
ORACLE_SQL["sources_roundtrip"] = f"WITH {view_sql('catalog')} SELECT name, coalesce(version, '') AS version, count(*) n, sum(length(description))::BIGINT chars, count(homepage) n_homepages FROM catalog GROUP BY ALL"
