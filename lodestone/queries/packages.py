"""Further queries of the catalog engine: lookups, merged records, fixes, scores, retries, buffers and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.operators import documents, metrics, packages, quality
from lodestone.queries.catalog import _COMPLETE, _DEFAULTS, _ISSUES, _SCORES, ORACLE_SQL, QUERIES, _defaults, _query

_QW = dims.lookup_sql("provider", "QUALITY_WEIGHT")
_REL = dims.lookup_sql("provider", "RELIABILITY")


@_query("catalog", "SELECT name, arg_min(provider, seq) AS provider, min(seq) seq, arg_min(coalesce(version, ''), seq) AS version FROM catalog GROUP BY 1")
def lookup_first(c):
    return packages.first_sources(c).select("name", "provider", "seq", F.coalesce("version", F.lit("")).alias("version"))


@_query("catalog", "SELECT seq, name, provider FROM catalog WHERE provider NOT IN ('snap', 'docker') AND coalesce(version, '') <> '' AND (coalesce(description, '') = '' OR length(description) >= 200)")
def package_filter(c):
    return packages.filtered(c, exclude=["snap", "docker"], with_version=True, least_description=200).select("seq", "name", "provider")


@_query(
    "catalog",
    """SELECT software, count(DISTINCT name) n_names, count(DISTINCT nullif(version, '')) n_versions, count(DISTINCT provider) n_providers, CASE WHEN count(DISTINCT name) = 1 THEN min(name) END same_name,
       CASE WHEN count(DISTINCT nullif(version, '')) = 1 THEN min(nullif(version, '')) END same_version FROM catalog GROUP BY 1 HAVING count(*) > 1""",
)
def package_features(c):
    return packages.features(c)


@_query(
    "catalog",
    """SELECT software, md5(arg_max(description, length(description) * 100000000 - seq)) description_md5, arg_min(homepage, seq) FILTER (WHERE homepage <> '') AS homepage, arg_min(source_url, seq) FILTER (WHERE source_url <> '') AS source_url,
       arg_min(license, seq) FILTER (WHERE license <> '') AS license, any_value(p) AS platforms FROM catalog LEFT JOIN pl USING (software) GROUP BY 1""",
    """it AS (SELECT software, item, min(seq * 10 + pos) AS place FROM (SELECT software, seq, unnest(platforms) item, generate_subscripts(platforms, 1) pos FROM catalog) GROUP BY 1, 2),
       pl AS (SELECT software, string_agg(item, ',' ORDER BY place) p FROM it GROUP BY 1)""",
)
def merged_record(c):
    m = packages.merged_record(c)
    return m.select("software", F.md5("description").alias("description_md5"), "homepage", "source_url", "license", F.array_join("platforms", ",").alias("platforms"))


_SCHEME = "regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"


@_query(
    "catalog",
    f"""SELECT seq, coalesce(nullif(version, ''), '0.1') AS version, coalesce(nullif(license, ''), 'MIT') AS license, coalesce(nullif(category, ''), 'utilities') AS category,
        CASE WHEN homepage <> '' AND NOT {_SCHEME.format("homepage")} THEN 'https://' || homepage ELSE homepage END AS homepage,
        CASE WHEN source_url <> '' AND NOT {_SCHEME.format("source_url")} THEN 'https://' || source_url ELSE source_url END AS source_url,
        CASE WHEN len(platforms) > 0 THEN array_to_string(platforms, ',') ELSE 'linux' END AS platforms FROM catalog""",
)
def auto_fix(c):
    return packages.fixed(c).select("seq", "version", "license", "category", "homepage", "source_url", F.array_join("platforms", ",").alias("platforms"))


@_query("catalog", f"SELECT provider, count(*) n, round(avg({_COMPLETE}), 5) before FROM catalog GROUP BY 1")
def completeness_by_provider(c):
    return c.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(quality.completeness()), 5).alias("before"))


@_query(
    "catalog",
    f"""SELECT software, field, value, round(least(1, w / n + CASE WHEN n > 1 THEN 0.2e0 * agree / n ELSE 0 END + CASE WHEN field = 'license' THEN CASE WHEN value IN ({", ".join(repr(x) for x in dims.SPDX_QUALITY)}) THEN 1.0e0
        WHEN regexp_matches(value, '{text.LICENSE_LIKE}') THEN 0.8e0 ELSE 0.3e0 END WHEN field = 'version' THEN regexp_matches(value, '{text.VERSION}')::INT WHEN contains(field, 'url') THEN regexp_matches(value, '{text.URL}')::INT ELSE 0 END), 5) confidence
        FROM (SELECT software, field, value, count(*) OVER f n, sum(q * confidence) OVER f w, count(*) OVER (PARTITION BY software, field, value) agree, row_number() OVER (PARTITION BY software, field ORDER BY confidence DESC, seq) rk
              FROM points WINDOW f AS (PARTITION BY software, field)) WHERE rk = 1""",
    f"""raw AS (SELECT software, seq, {_QW} q, {_REL} r, unnest(['license', 'version']) field, unnest([license, version]) AS value FROM catalog),
        points AS (SELECT software, seq, q, field, value, round(least(1, r * CASE WHEN field = 'license' AND value IN ({", ".join(repr(x) for x in dims.WELL_KNOWN_LICENSES)}) THEN 1.1e0 ELSE 1.0e0 END), 9) confidence FROM raw WHERE value <> '')""",
)
def field_confidence(c):
    fields = ("license", "version")
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    known = (F.col("field") == "license") & F.col("value").isin(*dims.WELL_KNOWN_LICENSES)
    p = c.select("software", "seq", "provider", each).where(text.truthy(F.col("value")))
    p = p.withColumn("confidence", F.round(F.least(dims.lookup(F.col("provider"), "RELIABILITY") * F.when(known, 1.1).otherwise(1.0), F.lit(1.0)), 9))
    return packages.field_confidence(p)


@_query("catalog", "SELECT seq, round(((name <> '')::INT + (coalesce(description, '') <> '')::INT + ((coalesce(homepage, '') <> '')::INT + (coalesce(source_url, '') <> '')::INT) / 3 + (coalesce(category, '') <> '')::INT + (coalesce(license, '') <> '')::INT) / 5, 6) confidence FROM catalog")
def export_confidence(c):
    return c.select("seq", F.round(packages.export_confidence(), 6).alias("confidence"))


@_query("catalog", "SELECT provider, n, quality_ppm, row_number() OVER (ORDER BY quality_ppm DESC, provider) place FROM r", _SCORES + ", r AS (SELECT provider, count(*) n, (sum(round(quality * 1000000)::BIGINT) // count(*))::BIGINT quality_ppm FROM sc GROUP BY 1)")
def provider_ranking(c):
    """Providers, of which there are few, by the mean quality of what they have."""
    ppm = F.round(F.round(quality.quality_score(F.col("i")), 6) * 1000000).cast("long")
    each = c.select("provider", quality.issues().alias("i")).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(ppm) / F.count(F.lit(1))).alias("quality_ppm"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("quality_ppm"), "provider")).cast("long"))


@_query("catalog", "SELECT provider, 'provider ' || provider || ': ' || count(DISTINCT catalog.seq) || ' packages, ' || count(path) || ' issues' AS line FROM catalog LEFT JOIN iss USING (seq) GROUP BY 1", _ISSUES)
def text_report(c):
    n = c.select("provider", F.size(quality.issues()).alias("k")).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    return n.select("provider", F.concat(F.lit("provider "), "provider", F.lit(": "), F.col("n").cast("string"), F.lit(" packages, "), F.col("k").cast("string"), F.lit(" issues")).alias("line"))


@_query("catalog", "SELECT DISTINCT category AS value FROM catalog WHERE category <> '' AND lower(category) NOT IN (" + ", ".join(repr(x) for x in dims.CATEGORIES) + ")")
def unknown_categories(c):
    return c.select(F.col("category").alias("value")).where(text.truthy(F.col("category")) & ~F.lower("category").isin(*dims.CATEGORIES)).distinct()


@_query("catalog")
def close_matches(c):
    """difflib's ratio against the known categories, the best three: SQL has no such function."""
    return packages.close_matches(c, "category", dims.CATEGORIES)


@_query("catalog", "SELECT DISTINCT provider FROM catalog WHERE provider NOT IN (SELECT provider FROM catalog WHERE score >= 0.98 AND category = 'web')")
def unavailable_providers(c):
    return packages.unavailable(c, c.where("score >= 0.98 and category = 'web'"))


@_query("catalog", "SELECT DISTINCT name, unnest(list_distinct([name, lower(name), replace(name, '-', '_'), replace(name, '_', '-'), replace(name, ' ', '-'), replace(name, ' ', '_')])) variation FROM catalog")
def name_variations(c):
    return c.select("name").distinct().select("name", F.explode(text.name_variations(F.col("name"))).alias("variation"))


@_query("catalog", "SELECT seq, unnest(list_transform(string_split(name || ' (>= ' || coalesce(version, '0') || '), ' || provider || '-base', ','), lambda x: regexp_extract(x, '([^\\s(]+)', 1))) depends_on FROM catalog")
def dependency_names(c):
    listed = F.concat("name", F.lit(" (>= "), F.coalesce("version", F.lit("0")), F.lit("), "), "provider", F.lit("-base"))
    return c.select("seq", F.explode(text.dependency_names(listed)).alias("depends_on"))


@_query("catalog", "SELECT DISTINCT category, upper(category) upper, lower(category) lower, upper(category[1]) || lower(category[2:]) capital, length(category) n, replace(category, 'e', '_') replaced, array_to_string(string_split(category, 'a'), '|') parts FROM catalog WHERE category <> ''")
def string_functions(c):
    k = F.col("category")
    return c.where(text.truthy(k)).select("category").distinct().select("category", F.upper(k).alias("upper"), F.lower(k).alias("lower"), text.capitalized(k).alias("capital"), F.char_length(k).cast("long").alias("n"), F.replace(k, F.lit("e"), F.lit("_")).alias("replaced"), F.array_join(F.split(k, "a"), "|").alias("parts"))


_LITERAL = "CASE id % 9 WHEN 0 THEN '12' WHEN 1 THEN '-1.5e3' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'none' WHEN 4 THEN '\"x y\"' WHEN 5 THEN 'a.b' WHEN 6 THEN '1.2.3' WHEN 7 THEN NULL ELSE key END"


@_query("metrics", f"SELECT DISTINCT {_LITERAL} AS literal, CASE id % 9 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' WHEN 3 THEN 'null' WHEN 4 THEN 'quoted' WHEN 7 THEN 'null' ELSE 'text' END kind FROM metrics")
def literal_kinds(m):
    return m.select(F.expr(_LITERAL).alias("literal")).distinct().select("literal", text.literal_kind(F.col("literal")).alias("kind"))


_STATUS = "CASE id % 8 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 503 WHEN 4 THEN 200 END"
_ERROR = "CASE id % 4 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'SSLError' WHEN 2 THEN 'ValueError' ELSE 'ConnectionError' END"


@_query(
    "metrics",
    """SELECT id, coalesce(attempt < 3 AND (status IN (429, 500, 502, 503, 504) OR (status IS NULL AND error IN ('ConnectionError', 'Timeout', 'HTTPError'))), false) AS again,
       CASE WHEN attempt >= 3 THEN 'Maximum retry attempts reached' WHEN status IN (429, 500, 502, 503, 504) THEN 'Retryable HTTP status: ' || status WHEN status IS NOT NULL THEN 'Non-retryable HTTP status: ' || status
       WHEN error IN ('ConnectionError', 'Timeout', 'HTTPError') THEN 'Retryable network error: ' || error WHEN contains(error, 'SSL') THEN 'SSL errors require fallback handling, not retry' ELSE 'Non-retryable error type: ' || error END reason FROM tries""",
    f"tries AS (SELECT id, {_STATUS} status, {_ERROR} error, id % 5 attempt FROM metrics WHERE name = 'error')",
)
def retry_decision(m):
    e = m.where("name = 'error'").selectExpr("id", f"{_STATUS} status", f"{_ERROR} error", "id % 5 attempt")
    return e.select("id", packages.retry(F.col("status"), F.col("error"), F.col("attempt")).alias("r")).select("id", "r.again", "r.reason")


@_query("metrics", "SELECT key, id, ts, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC)::INT place FROM metrics QUALIFY place <= 10")
def ring_buffer(m):
    return metrics.newest(m, 10).select("key", "id", "ts", "place")


@_query("metrics", "SELECT key, max(ts) AS ts, arg_max(value, ts * 10000000 + id) AS value FROM metrics WHERE name IN ('view', 'click') GROUP BY 1")
def cache_upsert(m):
    last = lambda k: m.where(F.col("name") == k).groupBy("key").agg(F.max_by(F.struct(F.struct("ts", "id").alias("ts"), "value"), F.struct("ts", "id")).alias("m")).select("key", "m.*")
    return metrics.upserted(last("view"), last("click")).select("key", "ts.ts", "value")


@_query("metrics", "SELECT key, hits, misses, round(coalesce(hits / nullif(hits + misses, 0), 0), 6) hit_rate FROM (SELECT key, count(*) FILTER (WHERE name = 'view') hits, count(*) FILTER (WHERE name = 'error') misses FROM metrics GROUP BY 1)")
def cache_hit_rate(m):
    return metrics.hit_rates(m, F.col("name") == "view", F.col("name") == "error")


_REQUIRED = ["settings.nation.k1", "settings.level.k2"]


@_query(
    "config",
    """SELECT provider, n, redundant, missing, invalid, round(greatest(0, least(1, (n - redundant) / n - least(0.3e0, 0.1e0 * missing) - least(0.2e0, 0.05e0 * invalid))), 6) quality FROM
       (SELECT provider, count(*) n, count(*) FILTER (WHERE def.path IS NOT NULL AND value IS NOT DISTINCT FROM v) redundant, 2 - max((config.path = 'settings.nation.k1')::INT)::BIGINT - max((config.path = 'settings.level.k2')::INT)::BIGINT missing,
        count(*) FILTER (WHERE value IS NULL) invalid FROM config LEFT JOIN def ON def.path = config.path GROUP BY 1)""",
    _DEFAULTS,
)
def override_quality(c):
    return documents.override_quality(c, _defaults(c), _REQUIRED)


@_query("config", "SELECT provider, path, value FROM config WHERE path <> 'settings.level' AND NOT starts_with(path, 'settings.level.') UNION ALL SELECT DISTINCT provider, 'settings.level', 'all' FROM config")
def path_edit(c):
    return documents.with_value(c, "settings.level", "all", "provider")


@_query("config", "SELECT provider, CASE WHEN count(*) FILTER (WHERE value <> '') = 0 THEN 'empty' WHEN count(*) FILTER (WHERE def.path IS NULL OR value IS DISTINCT FROM v) = 0 THEN 'redundant' WHEN count(*) FILTER (WHERE value IS NULL) > 0 THEN 'null values' ELSE 'ok' END state FROM config LEFT JOIN def ON def.path = config.path GROUP BY 1", _DEFAULTS)
def file_states(c):
    """Whether a provider's file has anything to say: files that are empty or repeat the defaults are to be removed."""
    q = documents.override_quality(c, _defaults(c), [])
    filled = c.groupBy("provider").agg(F.count_if(text.truthy(F.col("value"))).alias("filled"))
    state = F.when(F.col("filled") == 0, "empty").when(F.col("n") == F.col("redundant"), "redundant").when(F.col("invalid") > 0, "null values").otherwise("ok")
    return q.join(filled, "provider").select("provider", state.alias("state"))


def schema_types(spark, sf_dir):
    """Properties of events against a schema of types; the string that k is asked to be counts as an issue."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    join = lambda types: F.array_join(documents.type_issues(F.col("props"), types), ",")
    return e.select("event_id", join({"k": "integer"}).alias("as_integer"), join({"k": "string", "other": "number"}).alias("as_string"))


QUERIES["schema_types"] = schema_types
ORACLE_SQL["schema_types"] = """SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') OR json_type(props, '$.k') IS NULL THEN '' ELSE 'k' END as_integer,
    CASE WHEN json_type(props, '$.k') = 'VARCHAR' OR json_type(props, '$.k') IS NULL THEN '' ELSE 'k' END as_string FROM events"""
