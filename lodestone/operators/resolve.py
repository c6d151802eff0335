"""Conflict resolution: sources of a software as data points (software, field, value), one value for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dims, text

#: How each field's conflicts are resolved; all others by the highest confidence.
STRATEGY = {"description": "longest", "license": "majority", "version": "most_recent", "name": "priority"}
#: Columns of sources and the fields of a document that they are.
FIELDS = {"description": "description", "license": "license", "homepage": "urls.website", "source_url": "urls.source"}
MORE_FIELDS = FIELDS | {"download_url": "urls.download", "license_url": "urls.license", "version": "version", "name": "name", "category": "category.default"}


def data_points(rows: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(software, field, value, provider, seq, ts, priority, confidence) for each value that is there: one pass, no join.
    ``fields`` that ``rows`` has no column for are left out."""
    own = {c: f for c, f in (FIELDS if fields is None else fields).items() if c in rows.columns}
    reliability = dims.lookup(F.col("provider"), "RELIABILITY")
    points = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for c, f in own.items())))
    p = rows.select("software", "provider", "seq", "ts", reliability.alias("r"), dims.lookup(F.col("provider"), "PRIORITY").alias("priority"), points).where(text.truthy(F.col("value")))
    factor = (
        F.when(F.col("field") == "description", 0.5 + 0.5 * F.least(F.char_length("value") / 100, F.lit(1.0)))
        .when((F.col("field") == "license") & F.col("value").isin(*dims.WELL_KNOWN_LICENSES), 1.1)
        .when(F.startswith(F.col("field"), F.lit("urls.")) & F.startswith(F.col("value"), F.lit("https://")), 1.05)
        .otherwise(1.0)
    )
    return p.select("software", "field", "value", "provider", "seq", "ts", "priority", F.round(F.least(F.col("r") * factor, F.lit(1.0)), 9).alias("confidence"))


def _best(points: DataFrame, *order) -> DataFrame:
    key = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), (-F.col("seq")).alias("first"))
    picked = points.groupBy("software", "field").agg(F.max(F.struct(key.alias("k"), F.col("value"), F.col("confidence"))).alias("m"))
    return picked.select("software", "field", "m.value", F.round("m.confidence", 6).alias("confidence"))


def highest_confidence(points: DataFrame) -> DataFrame:
    return _best(points, F.col("confidence"))


def most_recent(points: DataFrame) -> DataFrame:
    """The newest; those without time only if none has one, then by confidence."""
    return _best(points, F.col("ts").isNotNull(), F.coalesce("ts", F.lit(0)), F.when(F.col("ts").isNull(), F.col("confidence")))


def longest(points: DataFrame) -> DataFrame:
    return _best(points, F.char_length("value"))


def provider_priority(points: DataFrame) -> DataFrame:
    return _best(points, F.col("priority"))


def majority_vote(points: DataFrame) -> DataFrame:
    """The most frequent value, the first seen on ties; its share times the mean confidence of those that have it.
    Values are counted before fields are: two combined aggregations, no list of points."""
    each = points.groupBy("software", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.sum("confidence").alias("c"))
    top = each.groupBy("software", "field").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("o"), "value", "c")).alias("m"))
    return top.select("software", "field", "m.value", F.round(F.col("m.n") / F.col("all") * (F.col("m.c") / F.col("m.n")), 6).alias("confidence"))


def merge_lists(rows: DataFrame, column: str = "platforms") -> DataFrame:
    """All items of the lists of a software in order of first sight; the lists' confidence over the number of sources
    that have one. Items are reduced to their first place before they are collected."""
    listed = rows.where(F.size(column) > 0)
    conf = F.round(F.least(dims.lookup(F.col("provider"), "RELIABILITY") * (0.7 + 0.3 * F.least(F.size(column) / 5, F.lit(1.0))), F.lit(1.0)), 9)
    items = listed.select("software", "seq", F.posexplode(column).alias("pos", "item")).groupBy("software", "item").agg(F.min(F.struct("seq", "pos")).alias("at"))
    merged = items.groupBy("software").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))
    means = listed.groupBy("software").agg(F.round(F.avg(conf), 6).alias("confidence"))
    return merged.join(means, "software")


def merge_dicts(rows: DataFrame) -> DataFrame:
    """(software, key, value): for each URL key the first value by seq that is not empty."""
    points = rows.select("software", "seq", F.inline(F.array(F.struct(F.lit("website").alias("key"), F.col("homepage").alias("value")), F.struct(F.lit("source").alias("key"), F.col("source_url").alias("value")))))
    return points.where(text.truthy(F.col("value"))).groupBy("software", "key").agg(F.min_by("value", "seq").alias("value"))


def conflicts(points: DataFrame) -> DataFrame:
    each = points.groupBy("software", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("software", "field").agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_values")).where("n_points > 1 and n_values > 1")


def conflicting_values(points: DataFrame) -> DataFrame:
    """(software, field, value, provider, confidence, priority, seq): all points of fields in which sources conflict."""
    of = conflicts(points).select(F.col("software").alias("_s"), F.col("field").alias("_f"))
    return points.join(of, (F.col("software") == F.col("_s")) & (F.col("field") == F.col("_f")), "left_semi").select("software", "field", "value", "provider", "confidence", "priority", "seq")


def resolved(points: DataFrame, strategies: dict[str, str] | None = None) -> DataFrame:
    """(software, field, value, confidence) of each field by its strategy (highest, longest, majority, most_recent or
    priority), in one aggregation for those that choose a point, and one more for votes. Of a field with one point that."""
    how = STRATEGY if strategies is None else strategies
    kinds = {"longest": F.char_length("value").cast("double"), "priority": F.col("priority").cast("double"), "most_recent": F.coalesce(F.col("ts").cast("double"), F.lit(float("-inf"))), "highest": F.col("confidence")}
    if unknown := set(how.values()) - {*kinds, "majority"}:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    kind = F.lit("highest")
    for field, name in how.items():
        kind = F.when(F.col("field") == field, name).otherwise(kind)
    score = kinds["highest"]
    for name, c in kinds.items():
        score = F.when(F.col("_kind") == name, c).otherwise(score)
    p = points.withColumn("_kind", kind)
    # points without a time are compared by confidence, if no point of the field has one
    untimed = F.when((F.col("_kind") == "most_recent") & F.col("ts").isNull(), F.col("confidence")).otherwise(0.0)
    return _best(p.where("_kind <> 'majority'"), score, untimed).unionByName(majority_vote(p.where("_kind = 'majority'")))


def aggregate_document(rows: DataFrame) -> DataFrame:
    """One row per software: each field by its strategy, and the mean confidence of all fields."""
    done = resolved(data_points(rows))
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return done.groupBy("software").agg(
        pick("license").alias("license"), pick("description").alias("description"), pick("urls.website").alias("website"), pick("urls.source").alias("source"), F.round(F.avg("confidence"), 5).alias("overall")
    )


def whole_document(rows: DataFrame) -> DataFrame:
    """(software, fields, confidences, platforms, packages): all fields that the columns of ``rows`` give, as maps from
    their paths; all platforms; of each provider the last package; the mean confidence as ``overall``."""
    done = resolved(data_points(rows, MORE_FIELDS))
    sure = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "confidence"))))
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))
    one = done.groupBy("software").agg(fields.alias("fields"), sure.alias("confidences"), F.sum("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"))
    lists = merge_lists(rows).select("software", F.col("items").alias("platforms"), F.col("confidence").alias("_p"))
    packages = packages_by_provider(rows).groupBy("software").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", F.struct("name", "version"))))).alias("packages"))
    out = one.join(lists, "software", "full_outer").join(packages, "software", "full_outer")
    total = F.coalesce("_c", F.lit(0.0)) + F.coalesce("_p", F.lit(0.0))
    n = F.coalesce("_n", F.lit(0)) + F.col("_p").isNotNull().cast("int")
    return out.select("software", "fields", "confidences", "platforms", "packages", F.round(F.when(n > 0, total / n).otherwise(0.5), 5).alias("overall"))


def agreement(docs: DataFrame, rows: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(software, field, share): the share of all sources ``rows`` of a software that have the value its document (the
    columns of FIELDS, and platforms) has; for each platform the share of those that list it. Documents without sources
    have 0.5; ``overall`` is the mean of all."""
    own = FIELDS if columns is None else columns
    d = docs.select(F.col("software").alias("_s"), *(F.col(c).alias(f"d_{c}") for c in own), F.col("platforms").alias("d_platforms"))
    met = d.join(rows.select("software", *own, "platforms"), F.col("_s") == F.col("software"), "left")
    share = lambda hit: F.when(F.count("software") == 0, 0.5).otherwise(F.avg(F.coalesce(hit, F.lit(False)).cast("double")))
    plain = met.groupBy("_s").agg(*(F.when(text.truthy(F.first(f"d_{c}")), share(F.col(c) == F.col(f"d_{c}"))).alias(c) for c in own))
    each = plain.select("_s", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("share")) for c, f in own.items())))).where("share is not null")
    listed = met.select("_s", "software", "platforms", F.explode("d_platforms").alias("p")).groupBy("_s", "p").agg(share(F.array_contains("platforms", F.col("p"))).alias("share"))
    every = each.union(listed.select("_s", F.concat(F.lit("platforms."), "p"), "share"))
    whole = every.groupBy("_s").agg(F.lit("overall").alias("field"), F.avg("share").alias("share"))
    return every.union(whole).select(F.col("_s").alias("software"), "field", F.round("share", 5).alias("share"))


def as_configuration(rows: DataFrame) -> DataFrame:
    """(doc, path, value, items): each package of ``rows`` as the leaves of a configuration; doc is its seq. What a row
    does not say has no leaf."""
    paths = {"name": "packages.default.name", "version": "packages.default.version", "description": "description"} | {c: f for c, f in MORE_FIELDS.items() if f.startswith("urls.")} | {"license": "license"}
    none = F.lit(None).cast("array<string>")
    leaf = [F.struct(F.lit(p).alias("path"), F.col(c).cast("string").alias("value"), none.alias("items")) for c, p in paths.items() if c in rows.columns]
    if "platforms" in rows.columns:
        leaf.append(F.struct(F.lit("platforms").alias("path"), F.lit(None).cast("string").alias("value"), F.when(F.size("platforms") > 0, F.col("platforms")).alias("items")))
    return rows.select(F.col("seq").alias("doc"), F.inline(F.array(*leaf))).where(text.truthy(F.col("value")) | F.col("items").isNotNull())


def packages_by_provider(rows: DataFrame) -> DataFrame:
    """The last source of each provider wins; a version that is missing is 'latest'."""
    last = rows.groupBy("software", "provider").agg(F.max_by(F.struct("name", "version"), "seq").alias("m"))
    return last.select("software", "provider", "m.name", F.when(text.truthy(F.col("m.version")), F.col("m.version")).otherwise("latest").alias("version"))


def merged_confidence(repository: DataFrame, generated: DataFrame) -> DataFrame:
    """Of two tables (key, field, score): the repository's scores times 1.2, 1 at most; others times 0.8."""
    both = repository.withColumnRenamed("score", "a").join(generated.withColumnRenamed("score", "b"), ["key", "field"], "full_outer")
    return both.select("key", "field", F.coalesce(F.least(F.lit(1.0), F.col("a") * 1.2), F.col("b") * 0.8).alias("score"))


def with_overall(merged: DataFrame) -> DataFrame:
    """Scores (key, field, score) of :func:`merged_confidence` and, as the field ``overall``, their mean."""
    whole = merged.groupBy("key").agg(F.lit("overall").alias("field"), F.avg("score").alias("score"))
    return merged.select("key", "field", "score").union(whole.select("key", "field", "score"))
