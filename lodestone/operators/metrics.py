"""Metrics, provider health, budgets and caches over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(value: Column) -> Column:
    """A coarse place of a number: equal or greater for greater numbers, some thousands for all there are."""
    size = F.floor(F.log2(F.abs(value)) * 32)
    return F.when(value > 0, 100_000 + size).when(value < 0, -100_000 - size).otherwise(0)


def picked(rows: DataFrame, shares: dict[str, float], by: str = "name", value: str = "value") -> DataFrame:
    """(by, n, a column for each of ``shares``): of the n sorted values of each ``by`` that at min(int(n share), n - 1).

    Bins of values are counted and cumulated, a few thousand for each key; then only distinct values of the bins that
    hold a wanted place are put in order, each bin by itself: no key is one window over all its values.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_bin", _bin(F.col("_v")))
    bins = each.groupBy("_by", "_bin").agg(F.sum("_c").alias("_c"))
    run, whole = Window.partitionBy("_by").orderBy("_bin"), Window.partitionBy("_by")
    bins = bins.select("_by", "_bin", (F.sum("_c").over(run) - F.col("_c")).alias("before"), F.sum("_c").over(run).alias("upto"), F.sum("_c").over(whole).alias("n"))
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("place")) for k, p in shares.items()))
    at = bins.select("_by", "_bin", "before", "upto", "n", F.explode(wanted).alias("w")).where((F.col("w.place") >= F.col("before")) & (F.col("w.place") < F.col("upto")))
    inside = Window.partitionBy("_by", "_bin").orderBy("_v")
    hit = at.select("_by", "_bin").distinct()
    ordered = each.join(hit, ["_by", "_bin"], "left_semi").withColumn("_upto", F.sum("_c").over(inside))
    met = ordered.join(at.select(F.col("_by").alias("_b"), F.col("_bin").alias("_i"), "before", "n", "w"), (F.col("_by") == F.col("_b")) & (F.col("_bin") == F.col("_i")))
    found = met.where(F.col("before") + F.col("_upto") > F.col("w.place")).groupBy("_by", "n", "w.k").agg(F.min("_v").alias("v"))
    return found.groupBy(F.col("_by").alias(by), "n").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in shares))


def summary(rows: DataFrame, by: str = "name") -> DataFrame:
    """Count, least, most, mean and p50, p95, p99 as sorted[min(int(n p), n - 1)]."""
    plain = rows.groupBy(F.col(by).alias("_key")).agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.avg("value"), 4).alias("mean"))
    at = picked(rows, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by)
    return at.join(plain, F.col(by) == F.col("_key")).select(by, "n", "least", "most", "mean", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


def counters_and_gauges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name", "key").agg(F.round(F.sum("value"), 2).alias("counter"), F.max_by("value", F.struct("ts", "id")).alias("gauge"))


def _trailing(rows: DataFrame, seconds: int) -> tuple[DataFrame, Window]:
    """``rows`` (key, ts in seconds), each in its own stretch of ``seconds`` and once more, as not ``_own``, in the next
    one; and the window of the ``seconds`` that end with a row. Both lie in one stretch, so a key's whole history is no
    window, however long it is."""
    stretch = F.floor(F.col("ts") / seconds)
    twice = rows.withColumn("_b", F.explode(F.array(stretch, stretch + 1))).withColumn("_own", F.col("_b") == F.floor(F.col("ts") / seconds))
    return twice, Window.partitionBy("key", "_b").orderBy("ts").rangeBetween(-(seconds - 1), 0)


def failure_windows(rows: DataFrame, seconds: int = 3600, most: int = 3, permanent: str | None = None) -> DataFrame:
    """Each failure (key, ts, id) with the failures of its key in the ``seconds`` up to it; ``most`` make it unavailable,
    and so does one that the column ``permanent`` says is for good."""
    twice, w = _trailing(rows, seconds)
    n = F.count(F.lit(1)).over(w)
    for_good = F.coalesce(F.col(permanent), F.lit(False)) if permanent else F.lit(False)
    return twice.select("key", "ts", "id", n.alias("recent"), ((n >= most) | for_good).alias("unavailable"), "_own").where("_own").drop("_own")


def budget_windows(rows: DataFrame, seconds: int = 60, requests: int = 60, tokens: float = 90_000) -> DataFrame:
    """Each request (key, ts, id, value tokens) with the requests and tokens of its key in the ``seconds`` up to it, whether
    they are within the limits, and how many seconds to wait if not: until the oldest of them leaves the window."""
    twice, w = _trailing(rows, seconds)
    n, total = F.count(F.lit(1)).over(w), F.round(F.sum("value").over(w), 4)
    ok = (n <= requests) & (total <= tokens)
    wait = F.when(ok, 0).otherwise(F.lit(seconds) - (F.col("ts") - F.min("ts").over(w))).cast("long")
    return twice.select("key", "ts", "id", n.alias("requests"), total.alias("tokens"), ok.alias("in_budget"), wait.alias("wait"), "_own").where("_own").drop("_own")


def events(rows: DataFrame, key: str | None = None, kind: str | None = None, most: int = 100) -> DataFrame:
    """The newest ``most`` events (key, name, ts, id), of one key or kind if given: the limit is the report's."""
    for column, value in (("key", key), ("name", kind)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("ts"), "id").limit(most)


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, salt: Column | None = None) -> Column:
    """Seconds to wait before an attempt (from 1): doubled each time, ``most`` at most, and from 0.1 up to 0.5 more, drawn
    from ``salt`` if it is given: the same on any cluster."""
    fixed = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))
    if salt is None:
        return fixed
    return fixed + 0.1 + 0.4 * F.conv(F.substring(F.md5(salt), 1, 8), 16, 10).cast("double") / float(2**32)


def expired(rows: DataFrame, now: int, ttl: int = 3600) -> DataFrame:
    return rows.where(F.lit(now) - F.col("created") > F.coalesce("ttl", F.lit(ttl)))


def lru_kept(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries that were used last: a top-k."""
    return rows.orderBy(F.desc("last_used"), "key").limit(most)


def token_bucket(rows: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, ts, id, tokens, allowed): a bucket of ``burst`` that fills at ``rate`` a second; each event takes one.

    Events of a key are folded in order as a sorted stream of a partition; only the state of one key is held."""

    def run(batches):
        key, last, left = object(), 0.0, burst
        for pdf in batches:
            out = []
            for k, ts, i in zip(pdf["key"], pdf["ts"], pdf["id"], strict=True):
                if k != key:
                    key, last, left = k, ts, burst
                left, last = min(burst, left + (ts - last) * rate), ts
                ok = left >= 1
                left -= ok
                out.append((k, ts, i, round(left, 6), bool(ok)))
            import pandas as pd

            yield pd.DataFrame(out, columns=["key", "ts", "id", "tokens", "allowed"])

    events = rows.select("key", "ts", "id").repartition("key").sortWithinPartitions("key", "ts", "id")
    return events.mapInPandas(run, "key string, ts long, id long, tokens double, allowed boolean")


def newest(rows: DataFrame, most: int, by: str = "key") -> DataFrame:
    """Ring buffers: the last ``most`` rows of each key. Spark cuts each partition's groups to so many before the shuffle."""
    place = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)


def upserted(old: DataFrame, new: DataFrame, key: str = "key", stamp: str = "ts") -> DataFrame:
    """Rows of both by key; the one with the later stamp replaces the other, one of ``new`` if they are equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(stamp, "_new")).alias("m")).select(key, "m.*")


def hit_rates(rows: DataFrame, hit: Column, miss: Column, by: str = "key") -> DataFrame:
    """(key, hits, misses, hit_rate); the rate is 0 if there was neither."""
    n = rows.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    return n.withColumn("hit_rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 6))
