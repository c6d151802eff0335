"""Quality of one document for each software against its sources: a score, a confidence and remarks for each field."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.operators import quality, resolve

FIELDS = ["description", "license", "platforms", "urls", "category", "packages"]
#: Platforms that need no check, and the URLs of a document, the first three of which count.
USUAL_PLATFORMS = ["linux", "windows", "macos", "darwin", "freebsd"]
URLS = ["website", "source", "documentation"]
#: A field of less confidence is to be verified, one of less quality improved; sources of less agreement are an issue.
CONFIDENT, GOOD, AGREED = 0.7, 0.6, 0.7


def documents(rows: DataFrame) -> DataFrame:
    """A document of each software, from all its sources: the longest description, else the first value by seq, all
    platforms, and the last package of each provider (how many, and how many of them have a name)."""
    first = lambda c: F.min_by(c, F.when(text.truthy(F.col(c)), F.col("seq"))).alias(c)
    longest = F.max_by("description", F.when(text.truthy(F.col("description")), F.struct(F.char_length("description"), -F.col("seq")))).alias("description")
    one = rows.groupBy("software").agg(longest, first("license"), first("homepage").alias("website"), first("source_url").alias("source"), first("category"))
    lists = resolve.merge_lists(rows).select("software", F.col("items").alias("platforms"))
    packages = resolve.packages_by_provider(rows).groupBy("software").agg(F.count(F.lit(1)).alias("n_packages"), F.count_if(text.truthy(F.col("name"))).alias("n_named"))
    return one.join(lists, "software", "left").join(packages, "software", "left").withColumn("documentation", F.lit(None).cast("string"))


def text_similarities(a: Column, b: Column) -> Column:
    """:func:`lodestone.functions.text.text_similarity` in time linear in the words, for long texts."""

    def places(t: str | None) -> dict[str, float]:
        words = (t or "").lower().split()
        first: dict[str, float] = {}
        for i, w in enumerate(words):
            first.setdefault(w, i / len(words))
        return first

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out, last, known = [], None, {}
            for s, t in zip(x, y, strict=True):
                if s != last:
                    last, known = s, places(s)
                other = places(t)
                both = known.keys() & other.keys()
                out.append(0.7 * len(both) / (len(known) + len(other) - len(both)) + 0.3 * sum(1 - abs(known[w] - other[w]) for w in both) / len(both) if both else 0.0)
            yield pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def _source_scores(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """What the sources of each software say about its document: sums and counts, combined before they are shuffled."""
    w = dims.lookup(F.col("provider"), "QUALITY_WEIGHT")
    d = docs.select(F.col("software").alias("_s"), *(F.col(c).alias(f"d_{c}") for c in ("description", "license", "platforms")))
    met = rows.select("software", "provider", "name", "description", "license", "homepage", w.alias("w")).join(d, F.col("software") == F.col("_s"))
    has = lambda c: text.truthy(F.col(c))
    mean = lambda of, when: F.avg(F.when(when, of))
    share = lambda hit, when: F.avg(F.when(when, F.coalesce(hit, F.lit(False)).cast("double")))
    square = F.col("w") * F.col("w")
    described, licensed = has("description") & has("d_description"), has("license") & has("d_license")
    met = met.withColumn("alike", F.when(described, text_similarities(F.col("d_description"), F.col("description"))))
    by = met.groupBy("software").agg(
        F.count_if(described).alias("description_n"), mean(square, described).alias("description_w"), share(F.col("description") == F.col("d_description"), described).alias("description_same"), F.avg("alike").alias("alike"),
        F.count_if(licensed).alias("license_n"), mean(square, licensed).alias("license_w"), share(F.col("license") == F.col("d_license"), licensed).alias("license_same"),
        share(text.normalized_license(F.col("license")) == text.normalized_license(F.col("d_license")), licensed).alias("license_like"),
        mean(square, has("homepage")).alias("urls_w"), F.avg(square).alias("packages_w"),
    )
    inferred = quality.inferred_platforms(F.col("provider"))
    each = rows.select("software", "provider").distinct().join(d.select("_s", "d_platforms"), F.col("software") == F.col("_s")).where(F.size(inferred) > 0)
    platforms = each.groupBy("software").agg(F.count(F.lit(1)).alias("platforms_n"), F.avg(w * w).alias("platforms_w"), F.avg(F.coalesce(inferred == F.col("d_platforms"), F.lit(False)).cast("double")).alias("platforms_same"))
    return by.join(platforms, "software", "left")


def assess(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(software, field, quality, confidence, issues, recommendations) for each field that a document of ``docs`` (of
    :func:`documents`) has, judged by itself and against the sources ``rows`` of its software.

    Confidence is the mean of the sources' squared weights, 0.2 of the share of sources that agree where there are
    several, and the bonus of a licence's format; 1 at most. A software without sources has no confidence.
    """
    j = docs.join(_source_scores(docs, rows), "software", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    agreed = lambda f: F.when(F.col(f"{f}_n") > 1, 0.2 * F.col(f"{f}_same")).otherwise(0.0)
    d, lic = F.col("description"), F.col("license")
    capital = F.left(d, F.lit(1)) != F.lower(F.left(d, F.lit(1)))
    complete, known = quality.platform_scores(F.col("platforms"))
    odd = F.filter("platforms", lambda p: ~F.lower(p).isin(*USUAL_PLATFORMS))
    given = [F.struct(F.lit(u).alias("kind"), F.col(u).alias("url")) for u in URLS]
    urls = F.filter(F.array(*given), lambda u: F.coalesce(u["url"] != "", F.lit(False)))
    bad = F.filter(urls, lambda u: ~text.url_ok(u["url"]))
    category = F.when(F.lower("category").isin(*dims.CATEGORIES), 1.0).otherwise(0.5)
    named = F.col("n_named") / F.col("n_packages")

    def remarks(*found: tuple[Column, str, str]) -> tuple[Column, Column]:
        """Issues and recommendations of the conditions that hold."""
        return tuple(F.array_compact(F.array(*(F.when(F.coalesce(x[0], F.lit(False)), F.lit(x[k])) for x in found))) for k in (1, 2))

    # fixed values: the wording of issues and recommendations
    fields = {
        "description": (
            text.truthy(d), (F.least(F.char_length(d) / 100, F.lit(1.0)) + F.coalesce(1 - F.col("alike"), F.lit(0.5)) + text.text_clarity(d)) / 3, zero("description_w") + agreed("description"),
            remarks((F.char_length(d) < 20, "Description is very short", "Consider expanding the description with more details"), (~capital, "Description should start with a capital letter", "Capitalize the first letter of the description")),
        ),
        "license": (
            text.truthy(lic), (text.license_format(lic) + F.coalesce(F.col("license_like"), F.lit(0.5))) / 2, F.when(F.col("license_n") > 0, zero("license_w") + agreed("license") + text.license_format(lic)).otherwise(0.0),
            remarks((text.license_format(lic) < 0.8, "License format may not be standard SPDX identifier", "Use standard SPDX license identifier")),
        ),
        "platforms": (
            F.size("platforms") > 0, (complete + known) / 2, zero("platforms_w") + agreed("platforms"),
            (F.transform(odd, lambda p: F.concat(F.lit("Platform '"), p, F.lit("' may not be standard"))), F.transform(odd, lambda p: F.concat(F.lit("Verify platform name '"), p, F.lit("' is correct")))),
        ),
        "urls": (
            F.size(urls) > 0, (1 - F.size(bad) / F.size(urls) + F.size(urls) / len(URLS)) / 2, zero("urls_w"),
            tuple(
                F.concat(F.array_compact(F.array(F.when(~text.truthy(F.col("website")), F.lit(missing)))), F.transform(bad, lambda u, s=said: F.concat(F.lit(s), u["kind"])))
                for missing, said in (("Website URL is missing", "Invalid URL format for "), ("Add website URL for better documentation", "Fix URL format for "))
            ),
        ),
        "category": (text.truthy(F.col("category")), (1.0 + category) / 2, F.lit(0.6), remarks()),
        # names of packages are those of sources
        "packages": (F.col("n_packages") > 0, (named + F.when(F.col("n_named") > 0, 1.0).otherwise(0.5)) / 2, zero("packages_w"), remarks()),
    }
    none = F.expr("cast(array() as array<string>)")
    each = F.array_compact(
        F.array(
            *(
                F.when(F.coalesce(there, F.lit(False)), F.struct(F.lit(f).alias("field"), F.least(score, F.lit(1.0)).alias("quality"), F.least(sure, F.lit(1.0)).alias("confidence"), F.coalesce(r[0].cast("array<string>"), none).alias("issues"), F.coalesce(r[1].cast("array<string>"), none).alias("recommendations")))
                for f, (there, score, sure, r) in fields.items()
            )
        )
    )
    return j.select("software", F.inline(each))


def overall(assessed: DataFrame) -> DataFrame:
    """(software, quality, confidence): means of the fields by their weights."""
    w = dims.lookup(F.col("field"), "FIELD_WEIGHT")
    mean = lambda c: F.round(F.sum(w * F.col(c)) / F.sum(w), 5).alias(c)
    return assessed.groupBy("software").agg(mean("quality"), mean("confidence"))


def consistency_issues(crossed: dict[str, DataFrame]) -> DataFrame:
    """(software, field, issue) of cross-references (software, n_conflicts, agreement) by what they compare."""
    out = None
    for name, c in crossed.items():
        found = F.array_compact(
            F.array(
                F.when(F.col("n_conflicts") > 0, F.concat(F.lit(f"Conflicting {name} found across sources: "), F.col("n_conflicts").cast("string"), F.lit(" conflicts detected"))),
                F.when(F.col("agreement") < AGREED, F.concat(F.lit("Low agreement score ("), F.format_string("%.2f", "agreement"), F.lit(f") for {name}"))),
            )
        )
        rows = c.select("software", F.lit(name).alias("field"), F.explode(found).alias("issue"))
        out = rows if out is None else out.union(rows)
    if out is None:
        raise ValueError("nothing is compared")
    return out


def recommendations(assessed: DataFrame, issues: DataFrame) -> DataFrame:
    """(software, recommendation): of each field that is unsure or poor, and its own; to resolve what conflicts."""
    number = lambda c: F.format_string("%.2f", c)
    own = F.array_compact(
        F.array(
            F.when(F.col("confidence") < CONFIDENT, F.concat(F.lit("Consider verifying "), "field", F.lit(" from additional sources (current confidence: "), number("confidence"), F.lit(")"))),
            F.when(F.col("quality") < GOOD, F.concat(F.lit("Improve "), "field", F.lit(" quality (current quality: "), number("quality"), F.lit(")"))),
        )
    )
    by_field = assessed.select("software", F.explode(F.concat(own, "recommendations")).alias("recommendation"))
    conflicts = issues.where(F.startswith("issue", F.lit("Conflicting"))).select("software", F.concat(F.lit("Resolve conflicts in "), "field", F.lit(" by manually reviewing source data")).alias("recommendation"))
    general = issues.select("software", F.lit("Review data sources for consistency issues and consider prioritizing more reliable sources").alias("recommendation"))
    return by_field.union(conflicts).union(general).distinct()
