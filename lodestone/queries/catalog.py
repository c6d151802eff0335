"""Queries of the catalog engine over the driver's tables, and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.operators import dataset, documents, metrics, quality, resolve, search
from lodestone.plans.views import view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(of: str, sql: str | None = None, views: str = ""):
    """Registers a function of a view, under its name, with the SQL that follows the views' definitions."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, of))
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {view_sql(of)}{', ' + views if views else ''} {sql}"
        return f

    return add


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '^(lib|python-|python3-|node-|ruby-)', ''), '-(dev|devel|doc|docs|common|utils|tools)$', ''), '[-_.]+', '-', 'g'), '-')"
_WEIGHT = dims.lookup_sql("lower(provider)", "SEARCH_WEIGHT")
_HIT = "hit AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) rn FROM catalog WHERE contains(lower(name), 'pkg_e') OR contains(lower(description), 'pkg_e'))"
_SHORT = ["name", "provider", "seq", "score"]


@_query("catalog", "SELECT name, provider, seq, score FROM hit WHERE rn = 1", _HIT)
def search_substring(c):
    return search.substring_search(c, "pkg_e").select(*_SHORT)


@_query("catalog", "SELECT name, provider, seq, score FROM catalog WHERE score >= 0.3")
def search_confidence(c):
    return search.by_confidence(c).select(*_SHORT)


_DEDUP = f"d AS (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY -score, -({_WEIGHT}), length(name), lower(name), seq) r FROM catalog)"


@_query("catalog", "SELECT name, provider, seq, score FROM d WHERE r = 1", _DEDUP)
def search_dedup(c):
    return search.dedup(c).select(*_SHORT)


@_query(
    "catalog",
    f"""SELECT name, provider, seq, round(least(0.4e0 * score + CASE WHEN lower(name) = 'pkg_en' THEN 0.3e0 ELSE 0 END + CASE WHEN starts_with(lower(name), 'pkg_en') THEN 0.2e0 ELSE 0 END
        + 0.1e0 * {_WEIGHT} + CASE WHEN contains(lower(description), 'pkg_en') THEN 0.1e0 ELSE 0 END, 1), 6) relevance FROM d WHERE r = 1 AND score >= 0.3
        ORDER BY relevance DESC, lower(name), seq LIMIT 20""",
    _DEDUP.replace("FROM catalog)", "FROM catalog WHERE score >= 0.3)"),
)
def search_rank_topk(c):
    return search.ranked(search.dedup(search.by_confidence(c)), "pkg_en", 20).select("name", "provider", "seq", "relevance")


@_query("catalog")
def suggest(c):
    return search.find_matches(c, "pkg_en3", 0.3, 10)


@_query("catalog")
def find_alternatives(c):
    return search.alternatives(c, "python-pkg_en-dev1")


@_query("products")
def identify_duplicates(c):
    """Packages that have an earlier one of at least 0.9 by name, description and provider."""
    return search.duplicates(c)


@_query("products")
def group_similar_packages(c):
    """Packages of each software around seeds."""
    return search.similar_groups(c)


@_query("products")
def compare_packages(c):
    """Groups of similar packages: the best one, what they share and why it is recommended."""
    out = search.compared(c)
    return out.withColumn("providers", F.array_join("providers", ","))


_SELECT = f"(0.3e0 * {dims.lookup_sql('provider', 'POPULARITY', 1)} / 10 + 0.2e0 * least(coalesce(length(description), 0) / 100.0e0, 1) + CASE WHEN version <> '' THEN 0.2e0 ELSE 0 END + 0.3e0 * score)"


@_query("catalog", f"SELECT software, provider, name, round({_SELECT}, 6) selection FROM catalog QUALIFY row_number() OVER (PARTITION BY software ORDER BY round({_SELECT}, 9) DESC, seq) = 1")
def select_best_package(c):
    return search.select_best(c)


@_query("catalog", f"SELECT software, name canonical_name FROM catalog QUALIFY row_number() OVER (PARTITION BY software ORDER BY {dims.lookup_sql('provider', 'POPULARITY', 0)} DESC, seq) = 1")
def canonical_name(c):
    return search.canonical_name(c)


@_query("catalog", f"SELECT round((count(DISTINCT provider) / count(*) + count(DISTINCT {_NORM}) / count(*)) / 2, 6) diversity FROM catalog")
def diversity_score(c):
    return search.diversity(c)


@_query("catalog", "SELECT provider, count(*) n, count(DISTINCT name) n_names, min(seq) first_seq FROM catalog GROUP BY 1")
def group_by_provider(c):
    return c.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"), F.min("seq").alias("first_seq"))


@_query(
    "catalog",
    """SELECT seq, round(0.8e0 + CASE WHEN provider IN ('apt', 'brew', 'winget', 'npm', 'pypi') THEN 0.1e0 ELSE 0 END + CASE WHEN version <> '' THEN 0.05e0 ELSE 0 END + CASE WHEN length(description) >= 20 THEN 0.05e0 ELSE 0 END, 6) score,
       concat_ws('; ', CASE WHEN provider IN ('apt', 'brew', 'winget', 'npm', 'pypi') THEN 'popular provider' END, CASE WHEN version <> '' THEN 'has version' END, CASE WHEN length(description) >= 20 THEN 'described' END) reason FROM catalog""",
)
def recommendation(c):
    score, reason = search.recommendation()
    return c.select("seq", score.alias("score"), reason.alias("reason"))


_WELL = ", ".join(f"'{x}'" for x in dims.WELL_KNOWN_LICENSES)
_POINTS = f"""raw AS (SELECT software, provider, seq, ts, 'description' field, description v FROM catalog UNION ALL SELECT software, provider, seq, ts, 'license', license FROM catalog
    UNION ALL SELECT software, provider, seq, ts, 'urls.website', homepage FROM catalog UNION ALL SELECT software, provider, seq, ts, 'urls.source', source_url FROM catalog),
  points AS (SELECT software, field, v AS value, provider, seq, ts, {dims.lookup_sql('provider', 'PRIORITY')} priority, round(least({dims.lookup_sql('provider', 'RELIABILITY')} * CASE WHEN field = 'description' THEN 0.5e0 + 0.5e0 * least(length(v) / 100.0e0, 1)
    WHEN field = 'license' AND v IN ({_WELL}) THEN 1.1e0 WHEN starts_with(field, 'urls.') AND starts_with(v, 'https://') THEN 1.05e0 ELSE 1 END, 1), 9) confidence FROM raw WHERE v <> '')"""


def _picked(order: str) -> str:
    return f"SELECT software, field, value, round(confidence, 6) confidence FROM points QUALIFY row_number() OVER (PARTITION BY software, field ORDER BY {order}, seq) = 1"


_MAJORITY = """each AS (SELECT software, field, value, count(*) n, min(seq) f, sum(confidence) c FROM points GROUP BY ALL),
  tot AS (SELECT *, sum(n) OVER (PARTITION BY software, field) a, row_number() OVER (PARTITION BY software, field ORDER BY n DESC, f) r FROM each)"""


@_query("catalog", _picked("confidence DESC"), _POINTS)
def resolve_highest_confidence(c):
    return resolve.highest_confidence(resolve.data_points(c))


@_query("catalog", "SELECT software, field, value, round(n / a * (c / n), 6) confidence FROM tot WHERE r = 1", f"{_POINTS}, {_MAJORITY}")
def resolve_majority_vote(c):
    return resolve.majority_vote(resolve.data_points(c))


@_query("catalog", _picked("ts IS NULL, coalesce(ts, 0) DESC, CASE WHEN ts IS NULL THEN confidence END DESC"), _POINTS)
def resolve_most_recent(c):
    return resolve.most_recent(resolve.data_points(c))


@_query("catalog", _picked("length(value) DESC"), _POINTS)
def resolve_longest(c):
    return resolve.longest(resolve.data_points(c))


@_query("catalog", _picked("priority DESC"), _POINTS)
def resolve_priority(c):
    return resolve.provider_priority(resolve.data_points(c))


@_query(
    "catalog",
    f"""SELECT software, string_agg(item, ',' ORDER BY seq, pos) AS items, any_value(c) confidence FROM it JOIN cf USING (software) GROUP BY software""",
    f"""it AS (SELECT software, item, seq, pos FROM (SELECT software, seq, unnest(platforms) item, generate_subscripts(platforms, 1) pos FROM catalog) QUALIFY row_number() OVER (PARTITION BY software, item ORDER BY seq, pos) = 1),
    cf AS (SELECT software, round(avg(round(least({dims.lookup_sql('provider', 'RELIABILITY')} * (0.7e0 + 0.3e0 * least(len(platforms) / 5.0e0, 1)), 1), 9)), 6) c FROM catalog WHERE len(platforms) > 0 GROUP BY 1)""",
)
def resolve_merge_lists(c):
    return resolve.merge_lists(c).select("software", F.array_join("items", ",").alias("items"), "confidence")


@_query("catalog", "SELECT software, replace(field, 'urls.', '') AS key, value FROM points WHERE starts_with(field, 'urls.') QUALIFY row_number() OVER (PARTITION BY software, field ORDER BY seq) = 1", _POINTS)
def resolve_merge_dicts(c):
    return resolve.merge_dicts(c)


@_query("catalog", "SELECT software, field, sum(n)::BIGINT n_points, count(*) n_values FROM each GROUP BY 1, 2 HAVING sum(n) > 1 AND count(*) > 1", f"{_POINTS}, {_MAJORITY}")
def conflict_report(c):
    return resolve.conflicts(resolve.data_points(c))


@_query(
    "catalog",
    """SELECT software, max(CASE WHEN field = 'license' THEN value END) license, max(CASE WHEN field = 'description' THEN value END) description, max(CASE WHEN field = 'urls.website' THEN value END) website,
       max(CASE WHEN field = 'urls.source' THEN value END) source, round(avg(confidence), 5) overall FROM done GROUP BY 1""",
    f"""{_POINTS}, {_MAJORITY}, done AS (SELECT software, field, value, round(n / a * (c / n), 6) confidence FROM tot WHERE r = 1 AND field = 'license'
    UNION ALL ({_picked('length(value) DESC').replace('FROM points', "FROM points WHERE field = 'description'")}) UNION ALL ({_picked('confidence DESC').replace('FROM points', "FROM points WHERE starts_with(field, 'urls.')")}))""",
)
def aggregate_document(c):
    return resolve.aggregate_document(c)


@_query("catalog", "SELECT software, provider, name, CASE WHEN version <> '' THEN version ELSE 'latest' END AS version FROM catalog QUALIFY row_number() OVER (PARTITION BY software, provider ORDER BY seq DESC) = 1")
def packages_by_provider(c):
    return resolve.packages_by_provider(c)


@_query("catalog", "SELECT field, count(*) n, round(avg(confidence), 5) mean_confidence, round(max(confidence), 6) most FROM points GROUP BY 1", _POINTS)
def confidence_by_field(c):
    return resolve.data_points(c).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence"), F.round(F.max("confidence"), 6).alias("most"))


_REL, _QW = dims.lookup_sql("provider", "RELIABILITY"), dims.lookup_sql("provider", "QUALITY_WEIGHT")


@_query(
    "catalog",
    "SELECT coalesce(a.software, b.software) AS key, coalesce(a.provider, b.provider) AS field, round(coalesce(least(1, s * 1.2e0), t * 0.8e0), 6) score FROM a FULL JOIN b ON a.software = b.software AND a.provider = b.provider",
    "a AS (SELECT software, provider, max(score) s FROM catalog WHERE license IS NOT NULL GROUP BY 1, 2), b AS (SELECT software, provider, max(score) t FROM catalog WHERE category IS NOT NULL GROUP BY 1, 2)",
)
def merge_confidence(c):
    best = lambda f: c.where(F.col(f).isNotNull()).groupBy(F.col("software").alias("key"), F.col("provider").alias("field")).agg(F.max("score").alias("score"))
    return resolve.merged_confidence(best("license"), best("category")).withColumn("score", F.round("score", 6))


def _cross_sql(value: str) -> tuple[str, str]:
    return (
        "SELECT software, consensus, n_conflicts, round(1 - n_conflicts / greatest(n * (n - 1) / 2, 1), 6) agreement FROM t",
        f"""l AS (SELECT software, provider, {value} AS value, seq FROM catalog WHERE {value} <> ''), m AS (SELECT software, provider, arg_max(value, seq) AS value, min(seq) seq FROM l GROUP BY 1, 2),
        e AS (SELECT software, value, count(*) n, min(seq) seq FROM m GROUP BY 1, 2), k AS (SELECT software, value FROM e QUALIFY row_number() OVER (PARTITION BY software ORDER BY n DESC, seq) = 1),
        x AS (SELECT a.software, sum(CASE WHEN a.provider < b.provider AND a.value <> b.value THEN 1 ELSE 0 END)::BIGINT n_conflicts, count(DISTINCT a.provider) n FROM m a JOIN m b USING (software) GROUP BY 1),
        t AS (SELECT software, k.value consensus, n_conflicts, n FROM x JOIN k USING (software))""",
    )


_LICENSE_NORM = "CASE WHEN contains(lower(license), 'mit') THEN 'MIT' WHEN contains(lower(license), 'apache') AND contains(lower(license), '2') THEN 'Apache-2.0' WHEN contains(lower(license), 'gpl') AND contains(lower(license), '3') THEN 'GPL-3.0' WHEN contains(lower(license), 'bsd') THEN 'BSD' ELSE license END"


@_query("catalog", *_cross_sql("name"))
def crossref_names(c):
    return quality.cross_reference(c, F.col("name"))


@_query("catalog", *_cross_sql("version"))
def crossref_versions(c):
    return quality.cross_reference(c, F.col("version"))


@_query("catalog", *_cross_sql(_LICENSE_NORM))
def crossref_licenses(c):
    return quality.cross_reference(c, text.normalized_license(F.col("license")))


@_query("catalog", *_cross_sql("description"))
def crossref_descriptions(c):
    return quality.cross_reference(c, F.col("description"))


@_query("catalog")
def crossref_versions_compatible(c):
    return quality.cross_reference_versions(c, F.col("version"))


@_query("catalog")
def crossref_descriptions_similar(c):
    return quality.cross_reference_texts(c, F.col("description"))


@_query("catalog", f"SELECT provider, round(least({_QW} + 0.2e0 * f / (3 * n), 1), 6) reliability FROM (SELECT provider, sum((coalesce(name, '') <> '')::INT + (coalesce(version, '') <> '')::INT + (coalesce(description, '') <> '')::INT) f, count(*) n FROM catalog GROUP BY 1)")
def source_reliability(c):
    return quality.source_reliability(c)


_MARKS = "(length(description) - length(translate(description, '!@#$%^&*()', '')))"


@_query(
    "catalog",
    f"SELECT seq, round(least(0.5e0 + CASE WHEN length(description) BETWEEN 20 AND 200 THEN 0.2e0 ELSE 0 END + CASE WHEN contains(description, '.') THEN 0.1e0 ELSE 0 END + CASE WHEN {_MARKS} / length(description) < 0.1 THEN 0.2e0 ELSE 0 END, 1), 6) clarity FROM catalog WHERE description <> ''",
)
def text_clarity(c):
    return c.where(text.truthy(F.col("description"))).select("seq", F.round(text.text_clarity(F.col("description")), 6).alias("clarity"))


@_query("catalog", f"SELECT seq, {_LICENSE_NORM} license_normalized, CASE WHEN license IN ({', '.join(repr(x) for x in dims.SPDX_QUALITY)}) THEN 1.0e0 WHEN regexp_matches(license, '(?i)MIT|Apache.*2\\.0|GPL.*3\\.0|GNU.*General.*Public.*License.*3|BSD') THEN 0.8e0 ELSE 0.3e0 END license_score FROM catalog WHERE license <> ''")
def license_normalize(c):
    lic = F.col("license")
    return c.where(text.truthy(lic)).select("seq", text.normalized_license(lic).alias("license_normalized"), text.license_format(lic).alias("license_score"))


@_query("catalog", "SELECT software, version latest FROM catalog WHERE version <> '' QUALIFY row_number() OVER (PARTITION BY software ORDER BY list_transform(regexp_extract_all(version, '\\d+'), lambda x: x::HUGEINT) DESC, seq) = 1")
def version_latest(c):
    key = F.struct(text.version_key(F.col("version")).alias("v"), (-F.col("seq")).alias("o"))
    return c.where(text.truthy(F.col("version"))).groupBy("software").agg(F.max_by("version", key).alias("latest"))


_KW = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[-_\\s.]+'), lambda x: length(x) >= 2 AND x NOT IN ('a','an','and','or','but','in','on','at','to','for','of','with','by','the')))"


@_query(
    "catalog",
    f"SELECT DISTINCT name, round(CASE WHEN len({_KW.format('name')}) = 0 THEN 0 ELSE len(list_intersect({_KW.format('name')}, ['python', 'pkg', 'en'])) / len(list_distinct(list_concat({_KW.format('name')}, ['python', 'pkg', 'en']))) END, 6) similarity FROM catalog",
)
def keyword_jaccard(c):
    return c.select("name").distinct().select("name", F.round(text.keyword_similarity(F.col("name"), F.lit("python-pkg_en")), 6).alias("similarity"))


@_query("catalog", "SELECT DISTINCT category, k AS known, round(levenshtein(lower(category), k) / greatest(length(category), length(k)), 6) distance FROM catalog, (SELECT unnest(['" + "', '".join(dims.CATEGORIES) + "']) k) WHERE category <> ''")
def levenshtein_typo(c):
    known = c.select("category").where(text.truthy(F.col("category"))).distinct().withColumn("known", F.explode(F.array(*map(F.lit, dims.CATEGORIES))))
    return known.select("category", "known", F.round(text.string_distance(F.lower("category"), F.col("known")), 6).alias("distance"))


@_query("catalog", "SELECT DISTINCT name, contains(lower(name), 'pkg_e') OR len(list_filter(regexp_split_to_array(lower(name), '[-_\\s.]+'), lambda x: starts_with(x, 'pkg'))) > 0 partial FROM catalog")
def partial_match(c):
    return c.select("name").distinct().select("name", text.partial_match(F.lit("pkg_e"), F.col("name")).alias("partial"))


_W = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> '')"
_BOTH = "list_intersect(wa, wb)"
_PLACES = "(list_position({0}, x) - 1)::DOUBLE / len({0})"
_NEAR = f"list_sum(list_transform({_BOTH}, lambda x: 1 - abs({_PLACES.format('wa')} - {_PLACES.format('wb')})))"
_ALIKE = f"CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE 0.7e0 * len({_BOTH}) / len(list_distinct(list_concat(wa, wb))) + 0.3e0 * coalesce({_NEAR} / nullif(len({_BOTH}), 0), 0) END"


@_query("catalog", f"SELECT seq, round({_ALIKE}, 6) similarity FROM pairs", f"pairs AS (SELECT seq, {_W.format('description')} wa, {_W.format('first')} wb FROM catalog JOIN (SELECT software, arg_min(description, seq) AS first FROM catalog GROUP BY 1) USING (software))")
def text_similarity(c):
    a = c.groupBy("software").agg(F.min_by("description", "seq").alias("first"))
    return c.join(a, "software").select("seq", F.round(text.text_similarity(F.col("description"), F.col("first")), 6).alias("similarity"))


@_query("catalog", f"SELECT seq, round(1 - avg({_ALIKE}), 5) uniqueness FROM pairs GROUP BY 1", f"pairs AS (SELECT seq, {_W.format('description')} wa, {_W.format('other')} wb FROM catalog JOIN (SELECT software, provider p, arg_min(description, seq) AS other FROM catalog GROUP BY 1, 2) USING (software) WHERE provider <> p)")
def text_uniqueness(c):
    """1 less the mean similarity to the first description of each provider of the software."""
    a = c.groupBy("software", "provider").agg(F.min_by("description", "seq").alias("other"))
    pairs = c.join(a.withColumnRenamed("provider", "_p"), "software").where(F.col("provider") != F.col("_p"))
    return pairs.groupBy("seq").agg(F.round(1 - F.avg(text.text_similarity(F.col("description"), F.col("other"))), 5).alias("uniqueness"))


_URLS = "list_filter([homepage, source_url], lambda u: u <> '')"
_ISSUE_SQL = [
    ("coalesce(version, '') = ''", "warning", "version", 0.3, True), ("coalesce(description, '') = ''", "warning", "description", 0.4, False), ("length(description) BETWEEN 1 AND 9", "info", "description", 0.2, False),
    ("coalesce(license, '') = ''", "warning", "license", 0.4, False), (f"license <> '' AND license NOT IN ({', '.join(repr(x) for x in dims.SPDX_RULES)})", "info", "license", 0.2, True),
    ("coalesce(len(platforms), 0) = 0", "warning", "platforms", 0.3, True), (f"len(list_filter(platforms, lambda p: lower(p) NOT IN ({', '.join(repr(x) for x in dims.PLATFORMS)}))) > 0", "info", "platforms", 0.1, True),
    (f"len({_URLS}) = 0", "info", "urls", 0.2, False), ("homepage <> '' AND NOT regexp_matches(homepage, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')", "error", "urls.website", 0.6, True),
    ("source_url <> '' AND NOT regexp_matches(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')", "error", "urls.source", 0.6, True), ("coalesce(category, '') = ''", "warning", "category", 0.3, True),
    (f"category <> '' AND lower(category) NOT IN ({', '.join(repr(x) for x in dims.CATEGORIES)})", "info", "category", 0.1, True), ("coalesce(name, '') = ''", "warning", "packages", 0.3, True),
]
_ISSUES = "iss AS (" + " UNION ALL ".join(f"SELECT seq, '{lv}' AS level, '{p}' AS path, {s}::DOUBLE severity, {str(fix).lower()} auto_fixable FROM catalog WHERE {w}" for w, lv, p, s, fix in _ISSUE_SQL) + ")"
_SCORES = f"{_ISSUES}, sc AS (SELECT catalog.seq, provider, round(greatest(0, 1 - coalesce(sum(severity * CASE level WHEN 'error' THEN 0.3e0 WHEN 'warning' THEN 0.1e0 WHEN 'info' THEN 0.05e0 END), 0)), 6) quality, count(path) n, coalesce(sum((level = 'error')::INT), 0) errors, coalesce(sum(auto_fixable::INT), 0) fixable FROM catalog LEFT JOIN iss USING (seq) GROUP BY ALL)"


@_query("catalog", "SELECT * FROM iss", _ISSUES)
def validate_rules(c):
    return c.select("seq", F.explode(quality.issues()).alias("i")).select("seq", "i.*")


@_query("catalog", "SELECT provider, count(*) n, sum((errors = 0)::INT)::BIGINT valid, sum(n)::BIGINT issues, sum(errors)::BIGINT errors, sum(fixable)::BIGINT fixable, (sum(round(quality * 1000000)::BIGINT) // count(*))::BIGINT quality_ppm FROM sc GROUP BY 1", _SCORES)
def validate_summary(c):
    i = c.select("provider", quality.issues().alias("i"))
    e = F.size(F.filter("i", lambda x: x["level"] == "error"))
    return i.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.sum((e == 0).cast("int")).alias("valid"), F.sum(F.size("i")).alias("issues"), F.sum(e).alias("errors"),
        F.sum(F.size(F.filter("i", lambda x: x["auto_fixable"]))).alias("fixable"), F.floor(F.sum(F.round(F.round(quality.quality_score(F.col("i")), 6) * 1000000).cast("long")) / F.count(F.lit(1))).alias("quality_ppm"),
    )


@_query("catalog", "SELECT CASE WHEN quality >= 0.9 THEN 'excellent' WHEN quality >= 0.75 THEN 'good' WHEN quality >= 0.6 THEN 'fair' WHEN quality >= 0.4 THEN 'poor' ELSE 'bad' END bucket, count(*) n, round(min(quality), 6) least FROM sc GROUP BY 1", _SCORES)
def quality_distribution(c):
    q = F.col("q")
    bucket = F.when(q >= 0.9, "excellent").when(q >= 0.75, "good").when(q >= 0.6, "fair").when(q >= 0.4, "poor").otherwise("bad")
    return c.select(F.round(quality.quality_score(quality.issues()), 6).alias("q")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("q"), 6).alias("least"))


@_query("catalog", "SELECT provider, n, (s // n)::BIGINT mean_ppm, l[1 + n // 2] AS median, l[1] AS least, l[n] AS most FROM (SELECT provider, list_sort(list(quality)) l, sum(round(quality * 1000000)::BIGINT) s, count(*) n FROM sc GROUP BY 1)", _SCORES)
def quality_statistics(c):
    """Mean, upper median, least and most quality of each provider's packages."""
    q = c.select("provider", F.round(quality.quality_score(quality.issues()), 6).alias("value"))
    plain = q.groupBy(F.col("provider").alias("_p")).agg(F.floor(F.sum(F.round(F.col("value") * 1000000).cast("long")) / F.count(F.lit(1))).alias("mean_ppm"), F.min("value").alias("least"), F.max("value").alias("most"))
    return metrics.picked(q, {"median": 0.5}, "provider").join(plain, F.col("provider") == F.col("_p")).select("provider", "n", "mean_ppm", "median", "least", "most")


@_query("catalog", "SELECT path, level, count(*) n FROM iss GROUP BY ALL ORDER BY n DESC, path, level LIMIT 10", _ISSUES)
def common_issues(c):
    return c.select(F.explode(quality.issues()).alias("i")).groupBy("i.path", "i.level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path", "level").limit(10)


_COMPLETE = f"((version <> '' AND version IS NOT NULL)::INT * 0.1e0 + (description <> '' AND description IS NOT NULL)::INT * 0.2e0 + (license <> '' AND license IS NOT NULL)::INT * 0.15e0 + (coalesce(len(platforms), 0) > 0)::INT * 0.1e0 + 0.1e0 * least(len({_URLS}) / 3, 1) + (category <> '' AND category IS NOT NULL)::INT * 0.15e0 + (name <> '')::INT * 0.2e0)"


@_query("catalog", f"SELECT seq, round({_COMPLETE}, 6) completeness FROM catalog")
def completeness(c):
    return c.select("seq", F.round(quality.completeness(), 6).alias("completeness"))


@_query("catalog", "SELECT provider, round(avg((coalesce(version, '') <> '')::INT), 6) AS version, round(avg((coalesce(license, '') <> '')::INT), 6) AS license, round(avg((coalesce(category, '') <> '')::INT), 6) AS category FROM catalog GROUP BY 1")
def field_coverage(c):
    return c.groupBy("provider").agg(*(F.round(F.avg(text.truthy(F.col(k)).cast("int")), 6).alias(k) for k in ("version", "license", "category")))


@_query("catalog", "SELECT seq, coalesce(regexp_matches(homepage, '^https?://([-\\w.])+(:[0-9]+)?(/([\\w/_.])*(\\?([\\w&=%.])*)?(#([\\w.])*)?)?$'), false) url_ok, coalesce(regexp_matches(homepage, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) has_host FROM catalog")
def url_validity(c):
    f = lambda x: F.coalesce(x, F.lit(False))
    return c.select("seq", f(text.url_ok(F.col("homepage"))).alias("url_ok"), f(text.has_scheme_and_host(F.col("homepage"))).alias("has_host"))


@_query("catalog", f"SELECT seq, round(CASE WHEN len(platforms) > 0 THEN len(list_intersect(platforms, ['linux', 'windows', 'macos'])) / 3 ELSE 0 END, 6) AS complete, round(CASE WHEN len(platforms) > 0 THEN len(list_filter(platforms, lambda p: p IN ({', '.join(repr(x) for x in dims.PLATFORMS)}))) / len(platforms) ELSE 0 END, 6) AS known, CASE WHEN provider IN ('apt', 'dnf') THEN 'linux' WHEN provider = 'brew' THEN 'macos,linux' WHEN provider IN ('winget', 'scoop', 'choco') THEN 'windows' WHEN provider IN ('npm', 'pypi', 'cargo') THEN 'linux,windows,macos' ELSE '' END inferred FROM catalog")
def platform_scores(c):
    a, b = quality.platform_scores(F.col("platforms"))
    return c.select("seq", F.round(a, 6).alias("complete"), F.round(b, 6).alias("known"), F.array_join(quality.inferred_platforms(F.col("provider")), ",").alias("inferred"))


@_query("catalog", f"SELECT seq, CASE WHEN description <> '' THEN CASE WHEN length(description) > 100 THEN 0.9e0 WHEN length(description) > 50 THEN 0.7e0 ELSE 0.5e0 END END c_description, CASE WHEN len({_URLS}) > 0 THEN round(least(0.9e0, 0.3e0 + len({_URLS}) * 0.1e0), 6) END c_urls, CASE WHEN category <> '' THEN 0.8e0 END c_category, CASE WHEN license <> '' THEN 0.8e0 END c_license, CASE WHEN len(platforms) > 0 THEN 0.7e0 END c_platforms FROM catalog")
def confidence_scores(c):
    return c.select("seq", *quality.confidence_scores())


@_query("catalog", f"SELECT provider, round(sum({_QW} * score) / sum({_QW}), 6) weighted, round(avg({_REL}), 6) reliability FROM catalog GROUP BY 1")
def quality_overall(c):
    w = dims.lookup(F.col("provider"), "QUALITY_WEIGHT")
    return c.groupBy("provider").agg(F.round(F.sum(w * F.col("score")) / F.sum(w), 6).alias("weighted"), F.round(F.avg(dims.lookup(F.col("provider"), "RELIABILITY")), 6).alias("reliability"))


@_query("catalog", "SELECT CASE WHEN regexp_matches(name, '^python') THEN 'python' WHEN regexp_matches(name, '^lib') THEN 'lib' ELSE 'plain' END naming, array_to_string(list_sort(platforms), ',') platform_set, count(*) n FROM catalog GROUP BY ALL")
def consistency_distribution(c):
    naming = F.when(F.startswith("name", F.lit("python")), "python").when(F.startswith("name", F.lit("lib")), "lib").otherwise("plain")
    return c.groupBy(naming.alias("naming"), F.array_join(F.array_sort("platforms"), ",").alias("platform_set")).agg(F.count(F.lit(1)).alias("n"))


_DEFAULTS = "def AS (SELECT path, arg_max(value, seq) FILTER (WHERE true) AS v FROM (SELECT path, value, seq FROM config WHERE value IS NOT NULL) GROUP BY 1)"


def _defaults(c: DataFrame) -> DataFrame:
    """Of each path the newest value that is not null stands for the defaults."""
    return c.where("value is not null").groupBy("path").agg(F.max_by("value", "seq").alias("value"))


@_query("config", "SELECT provider, path, value FROM config QUALIFY row_number() OVER (PARTITION BY provider, path ORDER BY seq DESC) = 1")
def config_merge_union(c):
    return documents.merge_layers(c, "provider", "path")


@_query("config", "SELECT provider, path, value FROM (SELECT provider, path, value FROM config QUALIFY row_number() OVER (PARTITION BY provider, path ORDER BY seq DESC) = 1) WHERE value IS NOT NULL")
def config_merge_replace(c):
    return documents.merge_replacing(c, "provider", "path")


@_query("config", "SELECT provider, config.path, value, seq FROM config LEFT JOIN def ON def.path = config.path WHERE def.path IS NULL OR value IS DISTINCT FROM v", _DEFAULTS)
def config_diff(c):
    return documents.differences(c, _defaults(c))


@_query("config", "SELECT provider, config.path, value, seq FROM config JOIN def ON def.path = config.path AND value IS NOT DISTINCT FROM v", _DEFAULTS)
def redundant_keys(c):
    return documents.redundant(c, _defaults(c))


@_query("config", "SELECT provider, count(*) n, sum((value IS NOT DISTINCT FROM v AND def.path IS NOT NULL)::INT)::BIGINT redundant, round(100 * sum((value IS NOT DISTINCT FROM v AND def.path IS NOT NULL)::INT) / count(*), 4) percent FROM config LEFT JOIN def ON def.path = config.path GROUP BY 1", _DEFAULTS)
def redundancy_percent(c):
    r = documents.redundant(c, _defaults(c)).groupBy("provider").agg(F.count(F.lit(1)).alias("redundant"))
    out = c.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).join(r, "provider", "left")
    red = F.coalesce("redundant", F.lit(0))
    return out.select("provider", "n", red.cast("long").alias("redundant"), F.round(100 * red / F.col("n"), 4).alias("percent"))


@_query("config", "SELECT provider, path, value, seq FROM config WHERE value <> ''")
def config_clean(c):
    return documents.without_empty(c)


@_query("config", "SELECT coalesce(a.provider, b.provider) AS provider, coalesce(a.path, b.path) AS path, coalesce(nullif(trim(a.v), ''), b.v) AS value FROM a FULL JOIN b ON a.provider = b.provider AND a.path = b.path", "a AS (SELECT provider, path, arg_min(value, seq) FILTER (WHERE value IS NOT NULL) v FROM config GROUP BY 1, 2), b AS (SELECT provider, path, max(value) v FROM config GROUP BY 1, 2)")
def config_merge_preferring(c):
    a = c.groupBy("provider", "path").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("value"))
    return documents.merge_preferring(a, c.groupBy("provider", "path").agg(F.max("value").alias("value")), "provider", "path")


@_query(
    "config",
    "SELECT a, b, similarity FROM (SELECT x.provider a, y.provider b, round(count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)), 6) similarity FROM i x JOIN i y ON x.provider < y.provider AND x.path = y.path AND x.value IS NOT DISTINCT FROM y.value JOIN s nx ON nx.provider = x.provider JOIN s ny ON ny.provider = y.provider GROUP BY 1, 2) WHERE similarity >= 0.01",
    "i AS (SELECT DISTINCT provider, path, value FROM config), s AS (SELECT provider, count(*) n FROM i GROUP BY 1)",
)
def config_similarity_pairs(c):
    return documents.similar_documents(c, "provider", 0.01)


@_query("config", "SELECT seq, CASE WHEN value IS NOT NULL THEN 'set ' || provider || ' ' || path || ' to ' || value || ' for $other' ELSE 'set ' || provider || ' ' || path || ' to none for $other' END AS command FROM config")
def substitution(c):
    t = "set $provider {{ path }} to ${value|none} for $other"
    return c.select("seq", documents.substituted(t, {k: F.col(k) for k in ("provider", "path", "value")}).alias("command"))


@_query("config", "SELECT seq, provider, path FROM config WHERE (provider = 'p1' AND value IS NOT NULL AND value <> '') OR provider IN ('p2', 'p3')")
def condition_filter(c):
    return c.where(documents.condition("provider == 'p1' and value or provider in ['p2', 'p3']", {k: F.col(k) for k in ("provider", "value")})).select("seq", "provider", "path")


_POS = "pos AS (SELECT *, coalesce(category, template, 'unknown') stratum, count(*) OVER (PARTITION BY coalesce(category, template, 'unknown')) ns, row_number() OVER (PARTITION BY coalesce(category, template, 'unknown') ORDER BY md5(id || '#42'), id) rk FROM pairs)"
_GOOD = "(coalesce(confidence >= 0.5, true) AND length(trim(instruction)) >= 10 AND length(trim(input)) >= 5 AND length(trim(output)) >= 10 AND NOT regexp_matches(concat_ws(' ', instruction, input, output), '(?i)TODO|FIXME|\\[PLACEHOLDER\\]|TBD'))"


@_query("pairs", "SELECT coalesce(category, template, 'unknown') stratum, count(*) n FROM pairs GROUP BY 1")
def strata_counts(p):
    return dataset.strata_sizes(p)


@_query("pairs", f"SELECT id, confidence FROM pairs WHERE {_GOOD}")
def quality_filter(p):
    return dataset.filter_quality(p).select("id", "confidence")


@_query(
    "pairs",
    """SELECT id, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.8 THEN 'high_quality' WHEN confidence >= 0.6 THEN 'medium_quality' WHEN confidence >= 0.4 THEN 'low_quality' ELSE 'poor_quality' END by_confidence,
       CASE WHEN s >= 5 THEN 'high_quality' WHEN s >= 3 THEN 'medium_quality' WHEN s >= 2 THEN 'low_quality' ELSE 'poor_quality' END by_rules FROM
       (SELECT *, (length(trim(instruction)) > 20)::INT + regexp_matches(lower(instruction), 'generate|create|enhance|categorize')::INT + (length(trim(input)) > 10)::INT + regexp_matches(lower(input), 'software|package')::INT + (length(trim(output)) > 20)::INT + regexp_matches(lower(output), 'version:|packages:|description:')::INT s FROM pairs)""",
)
def quality_labels(p):
    return p.select("id", dataset.confidence_label().alias("by_confidence"), dataset.heuristic_label().alias("by_rules"))


@_query("pairs", "SELECT id, stratum, CASE WHEN rk <= floor(ns * 0.8) THEN 'train' WHEN rk <= floor(ns * 0.8) + floor(ns * 0.1) THEN 'validation' ELSE 'test' END part FROM pos", _POS)
def stratified_split(p):
    return dataset.split(p).select("id", "stratum", "part")


@_query("pairs", "SELECT id, stratum, unnest(range(0, 1 + greatest(0, floor((60 - rk) / ns))::BIGINT))::INT AS copy FROM pos WHERE rk <= 60", _POS)
def balance_over(p):
    return dataset.balance(p, 60).select("id", "stratum", "copy")


@_query("pairs", "SELECT id, stratum, 0 AS copy FROM pos WHERE rk <= 60", _POS)
def balance_under(p):
    return dataset.balance(p, 60, "undersample").select("id", "stratum", "copy")


@_query("pairs", "SELECT id, regexp_replace(regexp_replace(instruction, '^Generate', 'Produce'), '^Categorize', 'Classify') instruction, round(greatest(confidence * 0.95e0, 0.1e0), 6) confidence FROM pairs WHERE CAST('0x' || md5(id || '#42a')[1:8] AS BIGINT) / 4294967296.0 < 0.4")
def augment(p):
    return dataset.augment(p).select("id", "instruction", F.round("confidence", 6).alias("confidence"))


@_query("pairs", "SELECT id, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text FROM pairs")
def format_causal(p):
    return p.select("id", dataset.causal_text().alias("text"))


@_query("pairs", "SELECT coalesce(category, 'none') AS category, coalesce(template, 'none') AS template, count(*) n, round(avg(confidence), 5) mean_confidence FROM pairs GROUP BY ALL")
def dataset_stats(p):
    return p.groupBy(F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("template", F.lit("none")).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))


@_query(
    "catalog",
    """SELECT seq, template, input, output FROM (SELECT seq, 'enhance_description' AS template, 'Package: ' || name AS input, description AS output FROM catalog
       UNION ALL SELECT seq, 'categorize_software', 'Package: ' || name, CASE WHEN category <> '' THEN 'Primary: ' || category END FROM catalog
       UNION ALL SELECT seq, 'extract_urls', 'Package: ' || name, concat_ws(chr(10), CASE WHEN homepage <> '' THEN 'website: ' || homepage END, CASE WHEN source_url <> '' THEN 'source: ' || source_url END) FROM catalog) WHERE trim(output) <> ''""",
)
def instruction_pairs(c):
    given = lambda label, f: F.when(text.truthy(F.col(f)), F.concat(F.lit(label), f))
    made = {"enhance_description": F.col("description"), "categorize_software": given("Primary: ", "category"), "extract_urls": F.concat_ws("\n", given("website: ", "homepage"), given("source: ", "source_url"))}
    pairs = c.select("seq", F.concat(F.lit("Package: "), "name").alias("input"), F.inline(F.array(*(F.struct(F.lit(k).alias("template"), v.alias("output")) for k, v in made.items()))))
    return pairs.where(F.trim("output") != "").select("seq", "template", "input", "output")


@_query("metrics", "SELECT name, count(*) n, round(min(value), 6) least, round(max(value), 6) most, round(avg(value), 4) mean, round(any_value(l[1 + least(floor(c * 0.5), c - 1)::BIGINT]), 6) p50, round(any_value(l[1 + least(floor(c * 0.95), c - 1)::BIGINT]), 6) p95, round(any_value(l[1 + least(floor(c * 0.99), c - 1)::BIGINT]), 6) p99 FROM metrics JOIN q USING (name) GROUP BY 1", "q AS (SELECT name, list_sort(list(value)) l, count(*) c FROM metrics GROUP BY 1)")
def histogram_summary(m):
    return metrics.summary(m)


@_query("metrics", "SELECT name, key, round(sum(value), 2) AS counter, arg_max(value, ts * 10000000 + id) gauge FROM metrics GROUP BY 1, 2")
def counters_gauges(m):
    return metrics.counters_and_gauges(m)


_RECENT = "count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)"


@_query("metrics", f"SELECT key, ts, id, {_RECENT} recent, {_RECENT} >= 3 unavailable FROM metrics WHERE name = 'error'")
def failure_window(m):
    return metrics.failure_windows(m.where("name = 'error'"))


@_query("metrics", f"SELECT key, arg_max(u, ts * 10000000 + id) unavailable, count(*) failures, max(ts) last_failure FROM (SELECT *, {_RECENT} >= 3 u FROM metrics WHERE name = 'error') GROUP BY 1")
def provider_status(m):
    f = metrics.failure_windows(m.where("name = 'error'"))
    return f.groupBy("key").agg(F.max_by("unavailable", F.struct("ts", "id")).alias("unavailable"), F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_failure"))


@_query("metrics", "SELECT key, ts, id, n AS requests, round(t, 4) tokens, n <= 60 AND round(t, 4) <= 90000 in_budget, CASE WHEN n <= 60 AND round(t, 4) <= 90000 THEN 0 ELSE 60 - (ts - o) END AS wait FROM (SELECT *, count(*) OVER w n, sum(value) OVER w t, min(ts) OVER w o FROM metrics WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))")
def token_budget_window(m):
    return metrics.budget_windows(m)


@_query("metrics")
def token_bucket(m):
    return metrics.token_bucket(m, 0.01, 5)


_CACHE = "cache AS (SELECT name || ':' || key AS key, min(ts) created, max(ts) last_used, (count(*) * 20)::BIGINT ttl FROM metrics GROUP BY 1)"


def _cache(m: DataFrame) -> DataFrame:
    return m.groupBy(F.concat("name", F.lit(":"), "key").alias("key")).agg(F.min("ts").alias("created"), F.max("ts").alias("last_used"), (F.count(F.lit(1)) * 20).alias("ttl"))


@_query("metrics", "SELECT key, created, last_used, ttl FROM cache WHERE 1704074400 - created > ttl", _CACHE)
def ttl_expired(m):
    return metrics.expired(_cache(m), 1704074400)


@_query("metrics", "SELECT key, created, last_used, ttl FROM cache ORDER BY last_used DESC, key LIMIT 10", _CACHE)
def lru_evict(m):
    return metrics.lru_kept(_cache(m), 10)


@_query("metrics", "SELECT key, count(*) n FROM cache WHERE regexp_matches(key, '^cl.*:user=[0-3]$') GROUP BY 1", _CACHE)
def pattern_invalidation(m):
    return _cache(m).where(text.matches_glob(F.col("key"), "cl*:user=[0-3]")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@_query("catalog", "SELECT coalesce(f.provider, t.provider) AS provider, f.provider IS NOT NULL has_source, t.provider IS NOT NULL has_template FROM (SELECT DISTINCT provider FROM catalog) f FULL JOIN (SELECT unnest(['apt', 'brew', 'npm', 'helm', 'yum']) provider) t ON f.provider = t.provider")
def provider_coverage(c):
    known = c.sparkSession.createDataFrame([(p,) for p in ("apt", "brew", "npm", "helm", "yum")], "provider string").withColumn("t", F.lit(True))
    found = c.select("provider").distinct().withColumn("f", F.lit(True)).join(known, "provider", "full_outer")
    return found.select("provider", F.col("f").isNotNull().alias("has_source"), F.col("t").isNotNull().alias("has_template"))


@_query("catalog", "SELECT seq, replace(replace(lower(coalesce(name, '')), '/', '_'), ' ', '_') || '.yaml' AS file, md5(name || '|' || coalesce(version, '')) cache_key, length(coalesce(description, '')) // 4 + 700 AS tokens FROM catalog")
def file_names_and_keys(c):
    return c.select(
        "seq", F.concat(F.translate(F.lower(F.coalesce("name", F.lit(""))), "/ ", "__"), F.lit(".yaml")).alias("file"), F.md5(F.concat("name", F.lit("|"), F.coalesce("version", F.lit("")))).alias("cache_key"),
        (F.floor(F.char_length(F.coalesce("description", F.lit(""))) / 4) + 700).cast("long").alias("tokens"),
    )


def flatten_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return documents.flatten_json(events, "props", "map<string,string>").select("event_id", F.concat(F.lit("props."), "path").alias("path"), "value")


QUERIES["flatten_csv"] = flatten_csv
ORACLE_SQL["flatten_csv"] = "SELECT event_id, 'props.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) k FROM events)"


_OPTIONAL = ["version", "description", "license", "homepage", "source_url", "category"]


@_query("catalog", "SELECT seq, concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in _OPTIONAL) + ") AS missing FROM catalog")
def missing_fields(c):
    return c.select("seq", F.array_join(F.array_compact(F.array(*(F.when(~text.truthy(F.col(k)), F.lit(k)) for k in _OPTIONAL))), ",").alias("missing"))


@_query("metrics", "SELECT id, key, ts, value FROM metrics WHERE name = 'error' ORDER BY ts DESC, id LIMIT 100")
def degradation_events(m):
    """The newest 100 failures: the limit is the report's."""
    return metrics.events(m, kind="error").select("id", "key", "ts", "value")


@_query("metrics", "SELECT key, count(*) failures, max(ts) last_failure, arg_max(id, ts * 10000000 + id) last_id, count(DISTINCT ts // 3600) n_hours FROM metrics WHERE name = 'error' GROUP BY 1")
def error_summary(m):
    e = m.where("name = 'error'")
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_failure"), F.max_by("id", F.struct("ts", "id")).alias("last_id"), F.countDistinct(F.floor(F.col("ts") / 3600)).alias("n_hours"))


@_query("metrics", "SELECT name, ts // 3600 AS hour, count(*) n, round(sum(value), 2) total FROM metrics GROUP BY 1, 2")
def metric_windows(m):
    return m.groupBy("name", F.floor(F.col("ts") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@_query("metrics", "SELECT name, least(30.0e0, 0.1e0 * power(2, least(count(*), 8) - 1)) delay, count(*) attempts FROM metrics GROUP BY 1")
def retry_delay(m):
    """Exponential backoff after so many attempts, 8 at most, without its random part."""
    n = F.count(F.lit(1))
    return m.groupBy("name").agg(F.least(F.lit(30.0), 0.1 * F.pow(F.lit(2.0), F.least(n, F.lit(8)) - 1)).alias("delay"), n.alias("attempts"))


@_query("catalog", "SELECT provider, count(*) n, sum((coalesce(category, '') <> '')::INT)::BIGINT succeeded, round(sum((coalesce(category, '') <> '')::INT) / count(*), 6) rate, sum(length(description))::BIGINT chars FROM catalog GROUP BY 1")
def enhancement_statistics(c):
    ok = F.sum(text.truthy(F.col("category")).cast("int"))
    return c.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), ok.alias("succeeded"), F.round(ok / F.count(F.lit(1)), 6).alias("rate"), F.sum(F.char_length("description")).cast("long").alias("chars"))


#: Phrases that a generated description must not hold.
REFUSALS = ["I cannot", "I don't know", "As an AI", "I'm sorry", "I apologize", "I'm not able", "I can't provide"]


def _quoted(phrase: str) -> str:
    return "'" + phrase.lower().replace("'", "''") + "'"


@_query(
    "catalog",
    "SELECT seq, CASE WHEN trim(coalesce(description, '')) = '' THEN 'empty' WHEN length(description) < 10 THEN 'too short' WHEN length(description) > 1000 THEN 'too long' WHEN "
    + " OR ".join(f"contains(lower(description), {_quoted(p)})" for p in REFUSALS) + " THEN 'refusal' END AS reason FROM catalog",
)
def description_validity(c):
    """Why a generated description is not taken; null if it is."""
    d, low = F.col("description"), F.lower("description")
    refused = F.lit(False)
    for p in REFUSALS:
        refused = refused | F.contains(low, F.lit(p.lower()))
    n = F.char_length(d)
    return c.select("seq", F.when(F.trim(F.coalesce(d, F.lit(""))) == "", "empty").when(n < 10, "too short").when(n > 1000, "too long").when(refused, "refusal").alias("reason"))
