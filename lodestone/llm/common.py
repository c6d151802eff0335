"""What the operators of this subpackage share: durable intermediate tables, checked broadcasts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a table that may be broadcast, as its rows lie in memory; beyond it joins shuffle.
BROADCAST_BYTES = 48_000_000
#: What a row costs in a hashed relation besides its values.
ROW_BYTES = 48
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints that all executors share. A folder of our own, on this machine, only if the session
    names none and runs in this process; on a cluster that would lose data, so it is an error there."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestone-"))
    return (found or sc.getCheckpointDir()).rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in reliable checkpoint files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: columns stay compressed and can be pruned."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what :func:`table` wrote for this application: for when none of its results is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in a partition for 25,000 of them, 4 at least: what is small leaves a few files in each
    shuffle that follows, not as many as the last shuffle had partitions."""
    return df.coalesce(max(4, rows // 25_000))


def forget(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffles that nothing refers to any more are then deleted from the disks of
    the executors. For between the rounds of an iteration whose tables are cut."""
    spark._jvm.System.gc()


def in_memory_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` (plain columns and lists of strings) as a hashed relation holds them, by one pass over it."""
    fixed, total = ROW_BYTES, F.lit(0).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            total = total + F.coalesce(F.octet_length(F.array_join(f"`{f.name}`", "")) + 20 * F.size(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"the size of {f.name} isn't known")
        fixed += 8
    return df.agg(F.coalesce(F.sum(total + fixed), F.lit(0))).first()[0]


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` (BROADCAST_BYTES) bytes. Give a checkpoint or a table: it is
    read to be measured."""
    return F.broadcast(df) if in_memory_bytes(df) <= (BROADCAST_BYTES if most is None else most) else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Names of the columns of a row's key.
KEY = ["key_id", "key_1", "key_2"]


def row_key(*more: str) -> list[Column]:
    """The columns KEY of a row of documents, none null: its doc_id and 128 bits of doc_id, text (null: empty) and the
    columns ``more``. Rows of one doc_id, or of none, are told apart by their texts."""
    parts = [F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), *(x for c in more for x in (F.col(c), F.col(c).isNull()))]
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key_id"), F.xxhash64(*parts).alias("key_1"), F.xxhash64(F.lit(1), *parts).alias("key_2")]


def unused(df: DataFrame, prefix: str) -> str:
    """``prefix``, made longer until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def without(docs: DataFrame, gone: DataFrame, *more: str) -> DataFrame:
    """Rows of ``docs`` whose :func:`row_key` is not in ``gone`` (the columns KEY, computed once): a row goes by what it
    is, whatever other rows have its doc_id, and so do rows that have none."""
    of = unused(docs, "_gone_")
    same = F.lit(True)
    for k, own in zip(KEY, row_key(*more), strict=True):
        same = same & (own == F.col(f"{of}{k}"))
    return docs.join(small(gone.select(*(F.col(k).alias(f"{of}{k}") for k in KEY))), same, "left_anti")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): a row (node, root) for each node, root the least node reachable.

    Alternating large-star and small-star rounds: each round keeps at most as many edges as the last one had, so no
    neighbourhood is ever collected; minima are combined before each shuffle. A self-loop names a lone node. No edges
    give no rows.
    """
    now = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = now.count()
    now = gathered(now, n)
    lone = now.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    now = now.where("u <> v")
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = gathered(both.groupBy("u").agg(F.min("v").alias("m")), n).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = gathered(large.where("u <> v").distinct(), n)
        low = gathered(large.groupBy("u").agg(F.min("v").alias("m")), n).withColumnRenamed("u", "k")
        met = large.join(low, F.col("u") == F.col("k"))
        star = met.select("u", F.col("m").alias("v")).union(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(gathered(star.where("u <> v").distinct(), n))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    child = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return child.union(now.select("v", "v").distinct()).union(lone.join(child.select("node"), "node", "left_anti")).distinct()
