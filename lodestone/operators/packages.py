"""Packages of several providers side by side: lookups, filters, features, merged records, fixes and their scores."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.operators import resolve

#: Statuses that are worth another attempt, and errors of the network.
RETRYABLE_STATUS = [429, 500, 502, 503, 504]
RETRYABLE_ERRORS = ["ConnectionError", "Timeout", "HTTPError"]


def first_sources(rows: DataFrame) -> DataFrame:
    """Point lookup by name for all names: the row of the first source that has it."""
    others = [c for c in rows.columns if c != "name"]
    return rows.groupBy("name").agg(F.min_by(F.struct(*others), "seq").alias("m")).select("name", "m.*")


def filtered(rows: DataFrame, exclude: Collection[str] = (), include: Collection[str] = (), with_version: bool = False, least_description: int = 0) -> DataFrame:
    """Rows that meet all criteria; a description is too short only where there is one."""
    if exclude:
        rows = rows.where(~F.col("provider").isin(*exclude))
    if include:
        rows = rows.where(F.col("provider").isin(*include))
    if with_version:
        rows = rows.where(text.truthy(F.col("version")))
    return rows.where(~text.truthy(F.col("description")) | (F.char_length("description") >= least_description))


def features(rows: DataFrame, key: str = "software") -> DataFrame:
    """What the packages of a software share: one name, one version, and how many names, versions and providers differ.
    All are counts and minima, combined before the shuffle."""
    version = F.nullif("version", F.lit(""))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"), F.countDistinct(version).alias("n_versions"), F.countDistinct("provider").alias("n_providers"), F.min("name").alias("_name"), F.min(version).alias("_version"),
    )
    same = lambda n, c: F.when(F.col(n) == 1, F.col(c))
    return out.where("n > 1").select(key, "n_names", "n_versions", "n_providers", same("n_names", "_name").alias("same_name"), same("n_versions", "_version").alias("same_version"))


def merged_record(rows: DataFrame) -> DataFrame:
    """One record of each software: the longest description, the first URLs and licence by seq, all platforms in order."""
    first = lambda c: F.min_by(c, F.when(text.truthy(F.col(c)), F.col("seq"))).alias(c)
    longest = F.max_by("description", F.when(F.col("description").isNotNull(), F.struct(F.char_length("description"), -F.col("seq")))).alias("description")
    one = rows.groupBy("software").agg(longest, first("homepage"), first("source_url"), first("license"))
    return one.join(resolve.merge_lists(rows).select("software", F.col("items").alias("platforms")), "software", "left")


def fixed(rows: DataFrame) -> DataFrame:
    """Automatic fixes: defaults for a version, licence, platforms and category that are missing, https:// for URLs without a scheme."""
    given = lambda c, d: F.when(text.truthy(F.col(c)), F.col(c)).otherwise(d)
    url = lambda c: F.when(text.truthy(F.col(c)) & ~text.has_scheme_and_host(F.col(c)), F.concat(F.lit("https://"), c)).otherwise(F.col(c))
    return rows.withColumns(
        {
            "version": given("version", "0.1"), "license": given("license", "MIT"), "category": given("category", "utilities"), "homepage": url("homepage"), "source_url": url("source_url"),
            "platforms": F.when(F.size("platforms") > 0, F.col("platforms")).otherwise(F.array(F.lit("linux"))),
        }
    )


def field_format(field: Column, value: Column) -> Column:
    """A bonus for the format of a value: of licences, versions and URLs."""
    ok = lambda pattern: F.when(value.rlike(pattern), 1.0).otherwise(0.0)
    return F.when(field == "license", text.license_format(value)).when(field == "version", ok(text.VERSION)).when(F.contains(field, F.lit("url")), ok(text.URL)).otherwise(0.0)


def field_confidence(points: DataFrame) -> DataFrame:
    """(software, field, value, confidence) of the most confident value of each field: the mean of weight by confidence,
    0.2 of the share of sources that agree where there are several, and the bonus of its format; 1 at most.

    Sources are added up by value first, so that the value that is chosen need not be joined to them."""
    weighted = dims.lookup(F.col("provider"), "QUALITY_WEIGHT") * F.col("confidence")
    each = points.groupBy("software", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(weighted).alias("w"), F.max(F.struct("confidence", (-F.col("seq")).alias("o"))).alias("best"))
    top = each.groupBy("software", "field").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("best", "value", F.col("n").alias("agree"))).alias("m"))
    agreed = F.when(F.col("n") > 1, 0.2 * F.col("m.agree") / F.col("n")).otherwise(0.0)
    total = F.col("w") / F.col("n") + agreed + field_format(F.col("field"), F.col("m.value"))
    return top.select("software", "field", "m.value", F.round(F.least(total, F.lit(1.0)), 5).alias("confidence"))


def export_confidence() -> Column:
    """The mean over five fields of what is there; three URLs count in full."""
    has = lambda c: text.truthy(F.col(c)).cast("int")
    urls = F.least((has("homepage") + has("source_url")) / 3, F.lit(1.0))
    return (has("name") + has("description") + urls + has("category") + has("license")) / 5


def retry(status: Column, error: Column, attempt: Column, most: int = 3) -> Column:
    """Whether to try again and why: a response's status decides, then the kind of error. The reasons."""
    answer = lambda again, why: F.struct(F.lit(again).alias("again"), why.alias("reason"))
    return (
        F.when(attempt >= most, answer(False, F.lit("Maximum retry attempts reached")))
        .when(status.isin(*RETRYABLE_STATUS), answer(True, F.concat(F.lit("Retryable HTTP status: "), status.cast("string"))))
        .when(status.isNotNull(), answer(False, F.concat(F.lit("Non-retryable HTTP status: "), status.cast("string"))))
        .when(error.isin(*RETRYABLE_ERRORS), answer(True, F.concat(F.lit("Retryable network error: "), error)))
        .when(F.contains(error, F.lit("SSL")), answer(False, F.lit("SSL errors require fallback handling, not retry")))
        .otherwise(answer(False, F.concat(F.lit("Non-retryable error type: "), error)))
    )


def close_matches(rows: DataFrame, column: str, candidates: Collection[str], most: int = 3, least: float = 0.3) -> DataFrame:
    """(value, match, rank): the candidates, a list of constants, that are most similar to each distinct value."""
    values = rows.select(F.lower(column).alias("value")).where(text.truthy(F.col("value"))).distinct()
    pairs = values.select("value", F.explode(F.array(*map(F.lit, candidates))).alias("match"))
    scored = pairs.withColumn("ratio", text.sequence_ratio(F.col("match"), F.col("value"))).where(F.col("ratio") >= least)
    best = scored.groupBy("value").agg(F.slice(F.sort_array(F.collect_list(F.struct("ratio", "match")), False), 1, most).alias("top"))
    return best.select("value", F.posexplode("top").alias("rank", "m")).select("value", F.col("m.match").alias("match"), (F.col("rank") + 1).alias("rank"))


def unavailable(requested: DataFrame, available: DataFrame, key: str = "provider") -> DataFrame:
    """Names that are asked for and not there."""
    return requested.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")
