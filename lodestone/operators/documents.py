"""Nested documents as rows (doc, path, value, seq): merging, differences, cleaning, paths, substitution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import expressions


def merge_layers(rows: DataFrame, *by: str, layer: str = "seq") -> DataFrame:
    """Overlay: of each path the value of the last layer wins, be it null."""
    return rows.groupBy(*by).agg(F.max_by("value", layer).alias("value"))


def merge_replacing(rows: DataFrame, *by: str, layer: str = "seq") -> DataFrame:
    """Overlay in which a null deletes its path."""
    return merge_layers(rows, *by, layer=layer).where(F.col("value").isNotNull())


def _above(path: Column) -> Column:
    """Paths of the objects that a path lies in: ``a`` and ``a.b`` of ``a.b.c``."""
    parts = F.split(path, r"\.")
    return F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def merge_trees(rows: DataFrame, doc: str = "doc", layer: str = "seq", deletes: bool = False) -> DataFrame:
    """(doc, path, value, items): the leaves of documents after all their layers are laid on each other, in order.

    ``rows`` (doc, layer, path, value, items) are leaves; ``items`` is a list, or null for a plain value, which may be
    null. A layer has a path once and nothing both at and below it. The later layer wins; a plain value or list replaces
    an object with all that lies in it, and an object replaces them. Lists are joined without repeats, in order of
    layers, back to the last one that had something else there; if it ``deletes``, lists replace each other, and a null
    deletes its path and what lies below. An empty table gives no rows.

    Paths meet only their own ancestors, so the work grows with the depth, not with the pairs of a document's paths.
    """
    rows = rows.select(doc, "path", F.col(layer).alias("_l"), "value", "items")
    top = F.max_by(F.struct("value", "items"), "_l").alias("top")
    last = rows.groupBy(doc, "path").agg(F.max("_l").alias("last"), top)
    leaf = last.select(F.col(doc).alias("_d"), F.col("path").alias("_p"), "last")
    up = leaf.withColumn("_a", F.explode(_above(F.col("_p"))))
    plain = rows.select(F.col(doc).alias("d"), F.col("path").alias("at"), "_l", F.col("items").isNull().alias("plain"))
    above = up.join(plain, (F.col("_d") == F.col("d")) & (F.col("_a") == F.col("at"))).select("_d", "_p", "last", "_l", F.lit(True).alias("other"))
    below = plain.select("d", "_l", F.explode(_above(F.col("at"))).alias("at")).distinct()
    below = leaf.join(below, (F.col("_d") == F.col("d")) & (F.col("_p") == F.col("at"))).select("_d", "_p", "last", "_l", F.lit(True).alias("other"))
    same = leaf.join(plain.where("plain"), (F.col("_d") == F.col("d")) & (F.col("_p") == F.col("at"))).select("_d", "_p", "last", "_l", F.lit(False).alias("other"))
    met = above.union(below).union(same).groupBy("_d", "_p").agg(F.max(F.when(F.col("_l") < F.col("last"), F.col("_l"))).alias("floor"), F.max(F.col("other") & (F.col("_l") > F.col("last"))).alias("gone"))
    on = (F.col(doc) == F.col("_d")) & (F.col("path") == F.col("_p"))
    kept = last.join(met, on, "left").where(~F.coalesce("gone", F.lit(False))).select(doc, "path", "floor", "top")
    if deletes:
        return kept.select(doc, "path", "top.value", "top.items").where("value is not null or items is not null")
    lists = kept.where("top.items is not null").select(F.col(doc).alias("_d"), F.col("path").alias("_p"), "floor")
    joined = rows.where("items is not null").join(lists, on).where(F.col("floor").isNull() | (F.col("_l") > F.col("floor")))
    firsts = joined.select("_d", "_p", "_l", F.posexplode_outer("items").alias("pos", "item")).groupBy("_d", "_p", "item").agg(F.min(F.struct("_l", "pos")).alias("place"), F.count("pos").alias("n"))
    whole = firsts.groupBy("_d", "_p").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("place", "item")))).alias("all"))
    whole = whole.select("_d", "_p", F.transform("all", lambda x: x["item"]).alias("items"))
    return kept.join(whole, on, "left").select(doc, "path", "top.value", F.when(F.col("top.items").isNotNull(), F.coalesce("items", F.expr("cast(array() as array<string>)"))).alias("items"))


def overlay(*layers: DataFrame, doc: str = "doc", deletes: bool = False) -> DataFrame:
    """:func:`merge_trees` of tables (doc, path, value, items), the later ones on the earlier: base, the provider's
    defaults, the overrides of a software, what the repository has."""
    out = None
    for i, rows in enumerate(layers):
        numbered = rows.select(doc, "path", "value", "items", F.lit(i).alias("_layer"))
        out = numbered if out is None else out.union(numbered)
    if out is None:
        raise ValueError("no layers are given")
    return merge_trees(out, doc, "_layer", deletes)


def renamed_items(rows: DataFrame, provider: str = "provider", sections: tuple[str, ...] = ("services", "directories", "processes", "ports", "containers", "files")) -> DataFrame:
    """Paths of providers' configurations as they lie in a merged document: items of ``sections`` are named
    ``provider_item``, or the provider for ``default``; the default package is named after the provider."""
    parts = F.split("path", r"\.")
    section, item = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), ".")
    tail = F.when(rest != "", F.concat(F.lit("."), rest)).otherwise("")
    named = F.when(item == "default", F.col(provider)).otherwise(F.concat(F.col(provider), F.lit("_"), item))
    moved = F.when(section.isin(*sections) & item.isNotNull(), F.concat(section, F.lit("."), named, tail)).when((section == "packages") & (item == "default"), F.concat(F.lit("packages."), F.col(provider), tail))
    return rows.where(~((section == "packages") & F.coalesce(item != "default", F.lit(False)))).withColumn("path", F.coalesce(moved, F.col("path")))


def merged_configurations(rows: DataFrame, doc: str = "software") -> DataFrame:
    """(doc, path, value) of providers' configurations (doc, provider, path, value, seq) as one document: the longest
    description, else of each renamed path the first value by seq that is not empty."""
    r = renamed_items(rows).where(F.coalesce(F.col("value") != "", F.lit(False)))
    long = F.when(F.col("path") == "description", F.char_length("value")).otherwise(0)
    best = F.struct((-long).alias("a"), F.col("seq").alias("b"))
    return r.groupBy(doc, "path").agg(F.min_by("value", best).alias("value"))


def merge_preferring(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Values of ``a``; of ``b`` where ``a`` has none or a blank one."""
    both = a.select(*by, F.col("value").alias("_a")).join(b.select(*by, F.col("value").alias("_b")), list(by), "full_outer")
    return both.select(*by, F.coalesce(F.nullif(F.trim("_a"), F.lit("")), F.col("_b")).alias("value"))


def differences(rows: DataFrame, defaults: DataFrame, by: str = "path") -> DataFrame:
    """Rows whose value is not that of the same path in ``defaults``: overrides only."""
    d = defaults.select(F.col(by).alias("_p"), F.col("value").alias("_v"))
    return rows.join(d, (F.col(by) == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v")), "left_anti")


def redundant(rows: DataFrame, defaults: DataFrame, by: str = "path") -> DataFrame:
    d = defaults.select(F.col(by).alias("_p"), F.col("value").alias("_v"))
    return rows.join(d, (F.col(by) == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v")), "left_semi")


def without_empty(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("value") != "", F.lit(False)))


def similar_documents(rows: DataFrame, doc: str, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of documents with a Jaccard similarity of ``least`` or more of their (path, value) pairs.

    Exact by a prefix filter: two such documents share one of the rarest items of each, as many as may be missing, and
    their sizes are near each other. So an item that all documents have, as a default, brings none together unless they
    hold hardly anything else. What is shared is counted for those that meet only.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0, and 1 at most")
    items = rows.select(F.col(doc).alias("doc"), F.xxhash64("path", "value").alias("h")).distinct()
    counts = items.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy("doc")  # one document
    sized = items.join(counts, "h").select("doc", "h", F.row_number().over(own.orderBy("df", "h")).alias("rank"), F.count(F.lit(1)).over(own).alias("n"))
    prefix = sized.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    a, b = (prefix.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), "h") for x in "ab")
    near = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    met = a.join(b, "h").where(near).select("a", "b", "na", "nb").distinct()
    one = items.select(F.col("doc").alias("a"), "h")
    both = met.join(one, "a").join(items.select(F.col("doc").alias("b"), "h"), ["b", "h"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    return both.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity")).where(F.col("similarity") >= least)


def flatten_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """(…, path, value) of a JSON object of plain values; what is not JSON gives no rows."""
    return rows.withColumn("_m", F.from_json(column, schema)).select("*", F.explode("_m").alias("path", "value")).drop("_m")


_PLACE = re.compile(r"\$\{([\w.]+)(?:\|([^}]*))?\}|\{\{\s*([\w.]+)\s*(?:\|\s*([^}]*?)\s*)?\}\}|\$(\w+)")


def substituted(template: str, known: dict[str, Column]) -> Column:
    """``template`` with $v, ${v|default} and {{ v | default }} filled in; what is not known stays as it is written.

    The template is read on the driver; the result is one concatenation."""
    parts: list[Column] = []
    at = 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at, name, default = m.end(), m[1] or m[3] or m[5], m[2] if m[2] is not None else m[4]
        if name in known:
            parts.append(F.coalesce(known[name].cast("string"), F.lit(default if default is not None else m[0])))
        else:
            parts.append(F.lit(default if default is not None else m[0]))
    return F.concat(*parts, F.lit(template[at:]))


def condition(expression: str, known: dict[str, Column]) -> Column:
    """A condition of :mod:`lodestone.operators.expressions` over the columns ``known``, all strings; names that are not
    known are null. Never null itself."""

    def value(x: expressions.Node) -> Column:
        return F.lit(x[1]) if x[0] == "text" else known.get(x[1], F.lit(None)).cast("string")

    def column(x: expressions.Node) -> Column:
        kind, *of = x
        if kind in ("or", "and"):
            out = column(of[0][0])
            for part in of[0][1:]:
                out = out | column(part) if kind == "or" else out & column(part)
            return out
        if kind == "not":
            return ~column(of[0])
        if kind in ("==", "!="):
            same = value(of[0]).eqNullSafe(value(of[1]))
            return same if kind == "==" else ~same
        if kind in ("in", "not in"):
            listed = of[1][0] == "list"
            hit = value(of[0]).isin(*(i[1] for i in of[1][1])) if listed else F.contains(value(of[1]), value(of[0]))
            return F.coalesce(hit, F.lit(False)) if kind == "in" else ~F.coalesce(hit, F.lit(False))
        return value(of[0]).isNotNull() if kind == "exists" else F.coalesce(value(of[0]) != "", F.lit(False))

    return column(expressions.parse(expression))


def with_value(rows: DataFrame, path: str, value: str | None, doc: str = "doc") -> DataFrame:
    """Each document's rows (doc, path, value) with ``value`` at ``path``, which is made where it is missing."""
    return without_path(rows, path).select(doc, "path", "value").union(rows.select(doc).distinct().select(doc, F.lit(path), F.lit(value).cast("string")))


def without_path(rows: DataFrame, path: str) -> DataFrame:
    """Rows that are neither at ``path`` nor below it."""
    under = (F.col("path") == path) | F.startswith("path", F.lit(path + ".")) | F.startswith("path", F.lit(path + "["))
    return rows.where(~under)


def override_quality(rows: DataFrame, defaults: DataFrame, required: list[str], doc: str = "provider") -> DataFrame:
    """(doc, n, redundant, missing, invalid, quality): the share of keys that differ from the defaults, less 0.1 for each
    required path that is missing (0.3 at most) and 0.05 for each null value (0.2 at most); between 0 and 1."""
    d = defaults.select(F.col("path").alias("_p"), F.col("value").alias("_v")).withColumn("_d", F.lit(True))
    same = F.coalesce(F.col("_d") & F.col("value").eqNullSafe(F.col("_v")), F.lit(False))
    has = [F.max((F.col("path") == p).cast("int")) for p in required]
    met = rows.join(d, F.col("path") == F.col("_p"), "left").groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("redundant"), (F.lit(len(required)) - sum(has, F.lit(0))).cast("long").alias("missing"), F.count_if(F.col("value").isNull()).alias("invalid")
    )
    score = (F.col("n") - F.col("redundant")) / F.col("n") - F.least(F.lit(0.3), 0.1 * F.col("missing")) - F.least(F.lit(0.2), 0.05 * F.col("invalid"))
    return met.withColumn("quality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def type_issues(json: Column, types: dict[str, str]) -> Column:
    """What of a JSON object breaks a schema of simple types (integer, number, string, boolean): paths, or ``$`` if it is no
    JSON at all. Paths that are missing are no issue."""
    names = {"integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN"}
    j = F.try_parse_json(json)
    wrong = [
        F.when(F.try_variant_get(j, f"$.{p}", "variant").isNotNull() & ~F.schema_of_variant(F.try_variant_get(j, f"$.{p}", "variant")).rlike(f"^(?:{names[t]})$"), F.lit(p)) for p, t in types.items()
    ]
    return F.when(json.isNotNull() & j.isNull(), F.array(F.lit("$"))).otherwise(F.array_compact(F.array(*wrong)))
