"""Quality of metadata: cross-references between sources, reliability, completeness, rules and their issues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dims, text


def cross_reference(rows: DataFrame, value: Column, key: str = "software") -> DataFrame:
    """(key, consensus, agreement, n_conflicts): pairs of providers that differ in ``value``, counted from the sizes of
    the groups of equal values, not by comparing pairs; the consensus is the most frequent, then first value."""
    last = rows.select(key, "provider", "seq", value.alias("value")).where(text.truthy(F.col("value"))).groupBy(key, "provider").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    each = last.groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    top = each.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.max(F.struct("n", (-F.col("seq")).alias("o"), "value")).alias("m"))
    differ = (F.col("n") * F.col("n") - F.col("sq")) / 2
    return top.select(key, F.col("m.value").alias("consensus"), differ.cast("long").alias("n_conflicts"), F.round(1 - differ / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1.0)), 6).alias("agreement"))


def _first_values(rows: DataFrame, value: Column, key: str) -> DataFrame:
    """(key, provider, value, seq): each provider's first value that is not empty, and the place of the provider's first row."""
    rows = rows.select(key, "provider", "seq", value.alias("value"))
    at = F.when(text.truthy(F.col("value")), F.col("seq"))
    return rows.groupBy(key, "provider").agg(F.min_by("value", at).alias("value"), F.min("seq").alias("seq"), F.min(at).alias("_at")).where("_at is not null").drop("_at")


def cross_reference_texts(rows: DataFrame, value: Column, key: str = "software", least: float = 0.5) -> DataFrame:
    """(key, consensus, agreement, n_conflicts): pairs of providers whose first texts are less alike than ``least``; the
    consensus is the text of the highest mean similarity to those that differ from it, the first one on ties.

    Pairs are made within a key only, of one text for each provider; words are split and looked up once for each text.
    """

    def of(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["seq", "provider"])
        texts, n = list(g["value"]), len(g)
        places: list[dict[str, float]] = []
        for t in texts:
            w = t.lower().split()
            first: dict[str, float] = {}
            for i, x in enumerate(w):
                first.setdefault(x, i / len(w))
            places.append(first)
        total, conflicts = [0.0] * n, 0
        for i, a in enumerate(places):
            for j in range(i):
                b = places[j]
                common = a.keys() & b.keys()
                alike = 0.7 * len(common) / (len(a) + len(b) - len(common)) + 0.3 * sum(1 - abs(a[x] - b[x]) for x in common) / len(common) if common else 0.0
                conflicts += round(alike, 9) < least
                if texts[i] != texts[j]:
                    total[i] += alike
                    total[j] += alike
        best = max(range(n), key=lambda i: (round(total[i], 9), -i))
        return pd.DataFrame({key: [g[key].iloc[0]], "consensus": [texts[best]], "n_conflicts": [conflicts], "agreement": [round(1 - conflicts / max(1, n * (n - 1) / 2), 6)]})

    each = _first_values(rows, value, key)
    return each.groupBy(key).applyInPandas(of, f"{key} {each.schema[key].dataType.simpleString()}, consensus string, n_conflicts long, agreement double")


def cross_reference_versions(rows: DataFrame, value: Column, key: str = "software") -> DataFrame:
    """(key, consensus, agreement, n_conflicts): pairs of providers whose first versions have different major numbers,
    counted from the sizes of the groups of equal ones; a version without a number conflicts with none. The consensus is
    the latest version, the first one on ties."""
    each = _first_values(rows, value, key).withColumn("k", text.version_key(F.col("value"))).withColumn("major", F.get("k", F.lit(0)))
    by = each.groupBy(key, "major").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("k", (-F.col("seq")).alias("o"), "value")).alias("m"))
    known = F.when(F.col("major").isNotNull(), F.col("n")).otherwise(0)
    top = by.groupBy(key).agg(F.sum("n").alias("n"), F.sum(known).alias("known"), F.sum(known * known).alias("sq"), F.max("m").alias("m"))
    differ = (F.col("known") * F.col("known") - F.col("sq")) / 2
    return top.select(key, F.col("m.value").alias("consensus"), differ.cast("long").alias("n_conflicts"), F.round(1 - differ / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1.0)), 6).alias("agreement"))


def source_reliability(rows: DataFrame) -> DataFrame:
    filled = sum((text.truthy(F.col(c)).cast("int") for c in ("name", "version", "description")), F.lit(0))
    out = rows.groupBy("provider").agg(F.sum(filled).alias("f"), F.count(F.lit(1)).alias("n"))
    return out.select("provider", F.round(F.least(dims.lookup(F.col("provider"), "QUALITY_WEIGHT") + 0.2 * F.col("f") / (3 * F.col("n")), F.lit(1.0)), 6).alias("reliability"))


def platform_scores(platforms: Column) -> tuple[Column, Column]:
    """Share of the common platforms, share of known names."""
    low = F.transform(platforms, lambda p: F.lower(p))
    n = F.size(platforms)
    common = F.size(F.array_intersect(F.array_distinct(low), F.array(*map(F.lit, ("linux", "windows", "macos"))))) / 3
    known = F.size(F.filter(low, lambda p: p.isin(*dims.PLATFORMS))) / n
    return F.when(n > 0, common).otherwise(0.0), F.when(n > 0, known).otherwise(0.0)


def inferred_platforms(provider: Column) -> Column:
    out = F.expr("cast(array() as array<string>)")
    for names, providers in dims.PLATFORMS_OF:
        out = F.when(provider.isin(*providers), F.array(*map(F.lit, names))).otherwise(out)
    return out


def _urls() -> Column:
    return F.filter(F.array("homepage", "source_url"), lambda u: F.coalesce(u != "", F.lit(False)))


def completeness() -> Column:
    """Weights: version .1, description .2, license .15, platforms .1, urls .1 (3 count in full), category .15, packages .2."""
    has = lambda c, w: F.when(text.truthy(F.col(c)), w).otherwise(0.0)
    return (
        has("version", 0.1) + has("description", 0.2) + has("license", 0.15) + F.when(F.size("platforms") > 0, 0.1).otherwise(0.0)
        + 0.1 * F.least(F.size(_urls()) / 3, F.lit(1.0)) + has("category", 0.15) + has("name", 0.2)
    )


def issues() -> Column:
    """What the rules find in a row, as an array of (level, path, severity, auto_fixable)."""
    absent = lambda c: ~text.truthy(F.col(c))
    bad_url = lambda c: text.truthy(F.col(c)) & ~text.has_scheme_and_host(F.col(c))
    no_urls = F.size(_urls()) == 0
    odd_platform = F.size(F.filter("platforms", lambda p: ~F.lower(p).isin(*dims.PLATFORMS))) > 0
    rules = [
        (absent("version"), "warning", "version", 0.3, True),
        (absent("description"), "warning", "description", 0.4, False),
        (F.char_length("description").between(1, 9), "info", "description", 0.2, False),
        (absent("license"), "warning", "license", 0.4, False),
        (text.truthy(F.col("license")) & ~F.col("license").isin(*dims.SPDX_RULES), "info", "license", 0.2, True),
        (F.coalesce(F.size("platforms"), F.lit(0)) <= 0, "warning", "platforms", 0.3, True),
        (odd_platform, "info", "platforms", 0.1, True),
        (no_urls, "info", "urls", 0.2, False),
        (bad_url("homepage"), "error", "urls.website", 0.6, True),
        (bad_url("source_url"), "error", "urls.source", 0.6, True),
        (absent("category"), "warning", "category", 0.3, True),
        (text.truthy(F.col("category")) & ~F.lower("category").isin(*dims.CATEGORIES), "info", "category", 0.1, True),
        (absent("name"), "warning", "packages", 0.3, True),
    ]
    found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(lv).alias("level"), F.lit(p).alias("path"), F.lit(s).alias("severity"), F.lit(fix).alias("auto_fixable"))) for c, lv, p, s, fix in rules]
    return F.array_compact(F.array(*found))


def quality_score(found: Column) -> Column:
    """1 less 0.3, 0.1 or 0.05 of the severity of each error, warning or info; between 0 and 1."""
    share = lambda i: F.when(i["level"] == "error", 0.3).when(i["level"] == "warning", 0.1).otherwise(0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(found, F.lit(1.0), lambda a, i: a - i["severity"] * share(i))))


def confidence_scores() -> list[Column]:
    """Rules of thumb: by length of the description, number of packages and URLs; null where there is nothing."""
    n = F.char_length("description")
    n_urls = F.size(_urls())
    return [
        F.when(text.truthy(F.col("description")), F.when(n > 100, 0.9).when(n > 50, 0.7).otherwise(0.5)).alias("c_description"),
        F.when(n_urls > 0, F.round(F.least(F.lit(0.9), 0.3 + n_urls * 0.1), 6)).alias("c_urls"),
        F.when(text.truthy(F.col("category")), 0.8).alias("c_category"),
        F.when(text.truthy(F.col("license")), 0.8).alias("c_license"),
        F.when(F.size("platforms") > 0, 0.7).alias("c_platforms"),
    ]
