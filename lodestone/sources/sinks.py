"""Datasets as files: JSON lines, flat CSV, Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a training record leaves out.
PRIVATE = ("timestamp", "source", "confidence_score", "metadata")


def flat(df: DataFrame) -> DataFrame:
    """Fields of structs as columns joined by ``_``, lists as text joined by ``, ``; columns in order of their names."""
    out = []

    def walk(prefix: str, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f"{prefix}.`{f.name}`", f"{name}_{f.name}", f.dataType)
        elif isinstance(kind, T.ArrayType):
            out.append(F.array_join(F.col(prefix).cast("array<string>"), ", ").alias(name))
        elif isinstance(kind, T.MapType):
            out.append(F.to_json(prefix).alias(name))
        else:
            out.append(F.col(prefix).alias(name))

    for f in df.schema:
        walk(f"`{f.name}`", f.name, f.dataType)
    made = df.select(*out)
    return made.select(*sorted(made.columns))


@dataclass
class Report:
    """What an export wrote: records, bytes, and where."""

    path: str
    kind: str
    count: int
    bytes: int


def export_report(df: DataFrame, path: str, kind: str = "jsonl", metadata: bool = True) -> Report:
    """Writes ``df`` as ``kind`` (jsonl, csv or parquet) to a folder. Records are counted while they are written."""
    rows = df if metadata else df.drop(*PRIVATE)
    seen = Observation()
    if kind not in ("jsonl", "csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    rows = (flat(rows) if kind == "csv" else rows).observe(seen, F.count(F.lit(1)).alias("n"))
    if kind == "jsonl":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return Report(path, kind, seen.get["n"], size)


def export(df: DataFrame, path: str, kind: str = "jsonl", metadata: bool = True) -> DataFrame:
    """:func:`export_report`, and what was written, read from the folder: nothing is computed again."""
    export_report(df, path, kind, metadata)
    rows = df if metadata else df.drop(*PRIVATE)
    if kind == "csv":
        return df.sparkSession.read.schema(flat(rows).schema).option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.schema(rows.schema).format("json" if kind == "jsonl" else "parquet").load(path)


def nested_yaml(rows: DataFrame, root: str = "name", file: str = "provider") -> DataFrame:
    """(root, file, value): documents (root, file, path, value, and items, if there are lists) as nested YAML, without what
    is null or empty; keys in order. What is grouped is one document."""
    lists = F.col("items") if "items" in rows.columns else F.lit(None).cast("array<string>")
    leaves = rows.select(root, file, "path", "value", lists.alias("items")).where((F.coalesce(F.col("value") != "", F.lit(False))) | (F.size("items") > 0))
    docs = leaves.groupBy(root, file).agg(F.collect_list(F.struct("path", "value", "items")).alias("leaves"))

    def run(batches):
        import yaml

        for pdf in batches:
            texts = []
            for leaves in pdf["leaves"]:
                tree: dict = {}
                for leaf in leaves:
                    at, (*above, key) = tree, leaf["path"].split(".")
                    for k in above:
                        at = at.setdefault(k, {})
                        if not isinstance(at, dict):
                            raise ValueError(f"{leaf['path']} lies below a plain value")
                    at[key] = leaf["value"] if leaf["items"] is None else list(leaf["items"])
                texts.append(yaml.safe_dump(tree, allow_unicode=True, sort_keys=True))
            yield pdf[[root, file]].assign(value=texts)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return docs.mapInPandas(run, f"{root} {kinds[root]}, {file} {kinds[file]}, value string")


def export_trees(rows: DataFrame, path: str, root: str = "name", file: str = "provider") -> DataFrame:
    """Documents (root, file, path, value) as YAML, in a folder for each root and file, and what was written as text.

    Each line is a whole path with its value in JSON's quoting, which YAML reads; values that are null or empty, and files
    without any other, are not written. What is grouped is one document."""
    lines = rows.where(F.coalesce(F.col("value") != "", F.lit(False))).groupBy(root, file).agg(F.sort_array(F.collect_set(F.struct("path", "value"))).alias("l"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    text = lines.select(root, file, F.array_join(F.transform("l", lambda x: F.concat(quoted(x["path"]), F.lit(": "), quoted(x["value"]))), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy(root, file).text(path)
    return text
