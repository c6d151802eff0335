"""Overrides of providers against defaults: what is necessary, what breaks rules, and how consistent all are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a provider must not set, paths that a provider needs on a platform, and hints of platforms.
FORBIDDEN = {"apt": ["supported"]}
REQUIRED_ON = {
    "apt": {"linux": ["packages.default.name"]},
    "brew": {"macos": ["packages.default.name"], "linux": ["packages.default.name"]},
    "winget": {"windows": ["packages.default.name"]},
    "choco": {"windows": ["packages.default.name"]},
    "scoop": {"windows": ["packages.default.name"]},
}
HINTS = {
    "windows": ["winget", "choco", "scoop", ".exe", "C:\\", "Program Files"],
    "linux": ["apt", "dnf", "yum", "pacman", "/usr/", "/etc/", "systemd"],
    "macos": ["brew", "/usr/local/", "/Applications/", "launchd"],
}


def suggests(text: Column, platform: str) -> Column:
    out = F.lit(False)
    for h in HINTS[platform]:
        out = out | F.contains(F.lower(text), F.lit(h.lower()))
    return out


def validated(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """(provider, supported, n_necessary, n_redundant, n_issues, n_missing, quality, potential) of each provider's leaves
    (provider, path, value) against ``defaults`` (path, value).

    A top-level key is necessary if something at or below it differs from the defaults; ``version`` always is. Rules give
    issues for forbidden keys; paths that a platform needs are missing if the configuration hints at the platform. A
    provider that is not supported should say nothing else. All is counted; no configuration is collected.
    """
    top = F.substring_index("path", ".", 1)
    d = defaults.select(F.col("path").alias("_p"), F.col("value").alias("_v")).withColumn("_d", F.lit(True))
    met = rows.join(d, F.col("path") == F.col("_p"), "left").withColumn("same", F.coalesce(F.col("_d") & F.col("value").eqNullSafe(F.col("_v")), F.lit(False)))
    keys = met.groupBy("provider", top.alias("key")).agg(F.min("same").alias("same"))
    by_key = keys.groupBy("provider").agg(
        F.count_if(~F.col("same") | (F.col("key") == "version")).alias("n_necessary"), F.count_if(F.col("same") & (F.col("key") != "version")).alias("n_redundant"), F.count_if(~F.col("key").isin("version", "supported")).alias("n_extra"),
        *(F.count_if((F.col("provider") == p) & F.col("key").isin(*ks)).alias(f"forbidden_{p}") for p, ks in FORBIDDEN.items()),
    )
    said = F.concat_ws(" ", "provider", "path", "value")
    paths = sorted({p for of in REQUIRED_ON.values() for ps in of.values() for p in ps})
    by_leaf = rows.groupBy("provider").agg(
        F.max(((F.col("path") == "supported") & (F.lower("value") == "false")).cast("int")).alias("off"), *(F.max(suggests(said, x).cast("int")).alias(f"on_{x}") for x in HINTS), *(F.max((F.col("path") == p).cast("int")).alias(f"has_{i}") for i, p in enumerate(paths))
    )
    missing = F.lit(0)
    for p, of in REQUIRED_ON.items():
        for platform, needed in of.items():
            for path in needed:
                missing = missing + F.when((F.col("provider") == p) & (F.col(f"on_{platform}") == 1) & (F.col(f"has_{paths.index(path)}") == 0), 1).otherwise(0)
    issues = F.lit(0)
    for p in FORBIDDEN:
        issues = issues + F.col(f"forbidden_{p}").cast("int")
    j = by_key.join(by_leaf, "provider").select("*", missing.alias("n_missing"), issues.alias("n_issues"))
    off = F.coalesce(F.col("off") == 1, F.lit(False))
    n = F.col("n_necessary") + F.col("n_redundant")
    score = F.col("n_necessary") / n - F.least(F.lit(0.3), 0.1 * F.col("n_missing")) - F.least(F.lit(0.2), 0.05 * F.col("n_issues"))
    quality = F.when(off, F.when(F.col("n_extra") > 0, 0.5).otherwise(0.8)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    long = lambda on, other: F.when(off, on).otherwise(other).cast("long")
    return j.select(
        "provider", (~off).alias("supported"), long(0, F.col("n_necessary")).alias("n_necessary"), long(F.col("n_extra"), F.col("n_redundant")).alias("n_redundant"), long((F.col("n_extra") > 0).cast("int"), F.col("n_issues")).alias("n_issues"),
        long(0, F.col("n_missing")).alias("n_missing"), F.round(quality, 6).alias("quality"), F.round(F.when(off, 0.0).otherwise(F.col("n_redundant") / n), 6).alias("potential"),
    )


def consistency(results: DataFrame) -> DataFrame:
    """One row of :func:`validated`: how many, their mean quality, redundant keys in all, and how many could be made a
    lot (over 0.5), somewhat (over 0.2) or little shorter."""
    p = F.col("potential")
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 5).alias("quality"), F.coalesce(F.sum("n_redundant"), F.lit(0)).alias("n_redundant"),
        F.count_if(p > 0.5).alias("high"), F.count_if((p > 0.2) & (p <= 0.5)).alias("medium"), F.count_if(p <= 0.2).alias("low"),
    )


def extra_keys(rows: DataFrame, allowed: tuple[str, ...] = ("version", "supported")) -> DataFrame:
    """(provider, key): top-level keys that are none of ``allowed``."""
    return rows.select("provider", F.substring_index("path", ".", 1).alias("key")).distinct().where(~F.col("key").isin(*allowed))


def meaningful(rows: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(provider, meaningful) of leaves (provider, path, value): whether a file of its own is worth it, which takes a value
    besides version and support that is not empty and, if there are ``defaults`` (path, value), not theirs."""
    own = ~F.substring_index("path", ".", 1).isin("version", "supported") & F.coalesce(F.col("value") != "", F.lit(False))
    if defaults is None:
        return rows.groupBy("provider").agg(F.max(own).alias("meaningful"))
    d = defaults.select(F.col("path").alias("_p"), F.col("value").alias("_v"))
    met = rows.join(d, F.col("path") == F.col("_p"), "left")
    return met.groupBy("provider").agg(F.max(own & ~F.coalesce(F.col("value") == F.col("_v"), F.lit(False))).alias("meaningful"))
