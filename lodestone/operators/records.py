"""Documents as JSON, one for each row: types against a schema, rules for records, fields that are missing, answers of models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a variant's schema shows a type of JSON schema; a null is of its own type.
_KINDS = {"object": "OBJECT<.*", "array": "ARRAY<.*", "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "null": "VOID"}
#: Fields that can be filled in, known categories and what a document weighs.
FIELDS = ["description", "license", "urls.website", "urls.source", "urls.documentation", "urls.support", "urls.download", "urls.changelog", "urls.icon", "category.default", "category.sub", "category.tags", "platforms", "language"]
URL_FIELDS = ["website", "source", "documentation", "support", "download", "changelog", "icon"]
WEIGHTS = {"version": 0.1, "description": 0.2, "license": 0.15, "platforms": 0.1, "urls": 0.1, "category": 0.15, "packages": 0.2}
_ISSUE = "array<struct<path:string,expected:string>>"


def at(j: Column, path: str, kind: str = "variant") -> Column:
    """What a variant has at ``a.b``; null if there is nothing of that kind."""
    return F.try_variant_get(j, "$." + path if path else "$", kind)


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^(?:{_KINDS[kind]})$"), F.lit(False))


def _members(v: Column) -> Column:
    """(key, value) of an object's members; none if it is no object."""
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))


def schema_issues(json: Column, schema: Mapping) -> Column:
    """What of a JSON text breaks a schema of draft 7, as a list of (path, expected): ``type`` (one or several), ``properties``,
    ``additionalProperties`` (a schema, or false for none), ``items``, ``required`` and ``enum`` of texts. Null has no issues;
    what is no JSON has one, at the root. The schema is read on the driver: the result is one expression."""
    none = F.expr(f"cast(array() as {_ISSUE})")

    def issue(path: Column, expected: str) -> Column:
        return F.array(F.struct(path.alias("path"), F.lit(expected).alias("expected")))

    def check(v: Column, of: Mapping, path: Column) -> Column:
        kinds = [of["type"]] if isinstance(of.get("type"), str) else list(of.get("type", []))
        found = []
        if kinds:
            fits = F.lit(False)
            for k in kinds:
                fits = fits | is_kind(v, k)
            found.append(F.when(v.isNotNull() & ~fits, issue(path, "|".join(kinds))).otherwise(none))
        if "enum" in of:
            found.append(F.when(is_kind(v, "string") & ~F.coalesce(F.try_variant_get(v, "$", "string").isin(*of["enum"]), F.lit(False)), issue(path, "enum")).otherwise(none))
        dot = lambda k: F.concat(path, F.lit("."), k)
        for k in of.get("required", []):
            found.append(F.when(is_kind(v, "object") & at(v, f"{k}").isNull(), issue(dot(F.lit(k)), "required")).otherwise(none))
        for k, sub in of.get("properties", {}).items():
            found.append(check(at(v, k), sub, dot(F.lit(k))))
        more = of.get("additionalProperties")
        if more is False or isinstance(more, Mapping):
            own = list(of.get("properties", {}))
            others = F.filter(_members(v), lambda e: ~e["key"].isin(*own)) if own else _members(v)
            sub = (lambda e: issue(dot(e["key"]), "nothing")) if more is False else (lambda e: check(e["value"], more, dot(e["key"])))
            found.append(F.coalesce(F.flatten(F.transform(others, sub)), none))
        if isinstance(of.get("items"), Mapping):
            listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
            found.append(F.flatten(F.transform(listed, lambda x, i: check(x, of["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        return F.concat(*found) if found else none

    j = F.try_parse_json(json)
    return F.when(json.isNotNull() & j.isNull(), issue(F.lit("$"), "JSON")).otherwise(F.coalesce(check(j, schema, F.lit("$")), none))


def filled(j: Column, path: str) -> Column:
    """Whether there is something at ``path``: not null, no blank text, no empty list or object."""
    v = at(j, path)
    shape = F.schema_of_variant(v)
    empty = shape.isin("VOID", "ARRAY<VOID>", "OBJECT<>") & ((shape != "ARRAY<VOID>") | (F.size(F.try_variant_get(v, "$", "array<variant>")) <= 0))
    blank = (shape == "STRING") & (F.trim(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\s", "")) == "")
    return F.coalesce(v.isNotNull() & ~empty & ~blank, F.lit(False))


def missing_fields(json: Column, paths: list[str] | None = None) -> Column:
    """Those of ``paths`` (FIELDS) that a document doesn't fill."""
    j = F.try_parse_json(json)
    return F.array_compact(F.array(*(F.when(~filled(j, p), F.lit(p)) for p in (FIELDS if paths is None else paths))))


def record_issues(json: Column) -> Column:
    """What the rules for records find in a document, as a list of (level, path): a version is required, as are names of
    packages and ports from 1 to 65535; a list of packages, description, category, licence, platforms and protocols are wanted."""
    j = F.try_parse_json(json)
    found = [("error", "version"), ("warning", "packages"), ("warning", "description"), ("warning", "category.default"), ("warning", "license"), ("warning", "platforms")]
    plain = [F.when(~filled(j, p), F.struct(F.lit(lv).alias("level"), F.lit(p).alias("path"))) for lv, p in found]

    def each(section: str, rule) -> Column:
        of = F.transform(_members(at(j, section)), lambda e: F.array_compact(F.array(*rule(e["value"], F.concat(F.lit(section + "."), e["key"])))))
        return F.flatten(of)

    def note(level: str, path: Column, name: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.concat(path, F.lit("." + name)).alias("path"))

    port = lambda v: F.coalesce(at(v, "port", "long"), at(v, "number", "long"))
    packages = each("packages", lambda v, p: [F.when(~filled(v, "name"), note("error", p, "name"))])
    ports = each("ports", lambda v, p: [F.when(~F.coalesce(port(v).between(1, 65535), F.lit(False)), note("error", p, "number")), F.when(~filled(v, "protocol"), note("warning", p, "protocol"))])
    containers = each("containers", lambda v, p: [F.when(~filled(v, "image"), note("error", p, "image"))])
    return F.concat(F.array_compact(F.array(*plain)), packages, ports, containers)


def completeness(json: Column) -> Column:
    """The share of the weights of a document's fields: URLs count by thirds, a category without default and packages
    without names by half."""
    j = F.try_parse_json(json)
    urls = F.size(F.filter(_members(at(j, "urls")), lambda e: filled(e["value"], "")))
    named = F.exists(_members(at(j, "packages")), lambda e: filled(e["value"], "name"))
    credit = {
        "urls": F.when(is_kind(at(j, "urls"), "object"), F.least(F.lit(1.0), urls / 3)).otherwise(1.0),
        "category": F.when(is_kind(at(j, "category"), "object") & ~filled(j, "category.default"), 0.5).otherwise(1.0),
        "packages": F.when(is_kind(at(j, "packages"), "object") & ~named, 0.5).otherwise(1.0),
    }
    total = F.lit(0.0)
    for f, w in WEIGHTS.items():
        total = total + F.when(filled(j, f), w * credit.get(f, F.lit(1.0))).otherwise(0.0)
    return total / sum(WEIGHTS.values())


def category_reason(json: Column) -> Column:
    """Why an answer that names a category is not taken; null if it is. The wording."""
    j = F.try_parse_json(json)
    sure = at(j, "confidence")
    number = at(j, "confidence", "double")
    return (
        F.when(j.isNull(), "Invalid JSON")
        .when(~is_kind(j, "object"), "Category data must be a dictionary")
        .when(at(j, "default").isNull(), "Category data must have 'default' field")
        .when(~is_kind(at(j, "default"), "string") | ~filled(j, "default"), "Default category must be a non-empty string")
        .when(sure.isNotNull() & ~(is_kind(sure, "number") & F.coalesce(number.between(0, 1), F.lit(False))), "Confidence must be a number between 0 and 1")
    )


def fields_reason(json: Column) -> Column:
    """Why an answer that completes fields is not taken; null if it is. The wording."""
    j = F.try_parse_json(json)
    out = F.when(j.isNull(), "Invalid JSON").when(~is_kind(j, "object"), "Field data must be a dictionary")
    for f in URL_FIELDS:
        url = at(j, f, "string")
        out = out.when(filled(j, f) & ~is_kind(at(j, f), "string"), f"URL field '{f}' must be a string").when(F.coalesce((url != "") & ~url.rlike("^https?://"), F.lit(False)), f"URL field '{f}' must be a valid HTTP/HTTPS URL")
    return out.when(at(j, "platforms").isNotNull() & ~is_kind(at(j, "platforms"), "array"), "Platforms must be a list")


def typed(json: Column, schema: str) -> Column:
    """A document as a struct of ``schema``: members it doesn't name are dropped, what has another type is null."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def estimated_tokens(json: Column, kinds: int) -> Column:
    """A rough number of tokens of a request for ``kinds`` sorts of additions to a document."""
    return (F.floor(F.char_length(json) / 4) + 200 * kinds + 500).cast("long")


def kind_of(v: Column) -> Column:
    """The type of a variant as JSON schema names it."""
    shape = F.schema_of_variant(v)
    out = F.when(shape.isNull(), F.lit(None).cast("string"))
    for kind in ("null", "string", "boolean", "integer", "array", "object"):
        out = out.when(shape.rlike(f"^(?:{_KINDS[kind]})$"), kind)
    return out.otherwise("number")


def flattened(rows: DataFrame, key: str, column: str, depth: int = 8) -> DataFrame:
    """(key, path, kind, value): the members of JSON documents that are no objects, or empty ones, by their paths ``a.b``;
    lists are opaque. Texts are as they are, all else is JSON. Objects deeper than ``depth`` are opaque too; what is no JSON
    or no object gives no rows. Objects are opened level by level, where the row lies."""
    spark = rows.sparkSession
    left = rows.select(key, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where(is_kind(F.col("v"), "object"))
    out = None
    for level in range(depth):
        inside = left.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(key, F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "key").alias("path"), F.col("value").alias("v"))
        opened = is_kind(F.col("v"), "object") & (F.to_json("v") != "{}")
        leaves = inside if level == depth - 1 else inside.where(~opened)
        leaves = leaves.select(key, "path", kind_of(F.col("v")).alias("kind"), F.coalesce(F.when(is_kind(F.col("v"), "string"), F.try_variant_get("v", "$", "string")), F.to_json("v")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        left = inside.where(opened)
    return out


def signatures(leaves: DataFrame, key: str) -> DataFrame:
    """(signature, n): how many documents of :func:`flattened` have which paths with which types."""
    each = leaves.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "kind"))), ",").alias("signature"))
    return each.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def name_pattern(c: Column) -> Column:
    """How a package's name is written. The patterns' names."""
    cased = F.lower(c) != F.upper(c)
    return (
        F.when(F.contains(c, F.lit("{{")) & F.contains(c, F.lit("}}")), "templated").when(F.contains(c, F.lit("-")), "hyphenated").when(F.contains(c, F.lit("_")), "underscored")
        .when(cased & (c == F.lower(c)), "lowercase").when(cased & (c == F.upper(c)), "uppercase").when(c.isNotNull(), "mixed_case")
    )


def key_pattern(c: Column) -> Column:
    """How a key of a configuration is written. The patterns' names."""
    return F.when(F.contains(c, F.lit("_")), "snake_case").when((F.lower(c) != F.upper(c)) & (c == F.lower(c)), "lowercase").when(c != F.lower(c), "camelCase").when(c.isNotNull(), "other")
