"""Whether a provider has a software: by its repository, else its template, else rules of thumb about names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Providers that have only what one of these words is part of the name of; all others have anything.
KEYWORDS = {
    "cargo": ["rust", "rs"],
    "gem": ["ruby", "rb", "rails"],
    "rubygems": ["ruby", "rb", "rails"],
    "nuget": ["net", "dotnet", "csharp", "c#"],
    "maven": ["java", "jvm", "scala", "kotlin"],
    "gradle": ["java", "jvm", "scala", "kotlin"],
    "composer": ["php", "laravel", "symfony"],
    "go": ["go", "golang"],
    "golang": ["go", "golang"],
    "apk": ["lib", "dev", "server", "daemon"],
    "scoop": ["cli", "tool", "dev", "git"],
    "helm": ["k8s", "kubernetes", "server", "database", "web"],
    "flatpak": ["app", "desktop", "gui"],
    "guix": ["gnu", "free", "lib"],
    "spack": ["hpc", "scientific", "compute", "mpi"],
}


def likely(name: Column, provider: Column) -> Column:
    """Whether a provider would have a software of that name."""
    out = F.when(F.lit(False), F.lit(True))
    for p, words in KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(name), F.lit(w))
        out = out.when(F.lower(provider) == p, hit)
    return out.otherwise(True)


def supported(requests: DataFrame, packages: DataFrame, templates: DataFrame) -> DataFrame:
    """(name, provider, supported, reason) of ``requests`` (name, provider), each once.

    What the repository of a provider says comes first: of a provider with any ``packages`` (name, provider) those it has.
    Then ``templates`` (provider, supported; a row for each, few): none means no, and so does false; else the rules.
    """
    asked = requests.select("name", "provider").distinct()
    had = packages.select(F.col("name").alias("_n"), F.col("provider").alias("_p")).distinct()
    known = packages.select(F.col("provider").alias("_k")).distinct().withColumn("known", F.lit(True))
    t = templates.select(F.col("provider").alias("_t"), F.coalesce("supported", F.lit(True)).alias("allowed"))
    j = asked.join(had.withColumn("has", F.lit(True)), (F.col("name") == F.col("_n")) & (F.col("provider") == F.col("_p")), "left")
    j = j.join(known, F.col("provider") == F.col("_k"), "left").join(F.broadcast(t), F.col("provider") == F.col("_t"), "left")
    reason = F.when(F.col("known"), "repository").when(F.col("_t").isNull(), "no template").when(~F.col("allowed"), "template").otherwise("rule")
    answer = F.when(F.col("known"), F.coalesce("has", F.lit(False))).when(F.col("_t").isNull() | ~F.col("allowed"), False).otherwise(likely(F.col("name"), F.col("provider")))
    return j.select("name", "provider", answer.alias("supported"), reason.alias("reason"))
