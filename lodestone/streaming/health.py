"""Streams of events: windowed metrics with late data, health of providers, retention."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestone.session import ship

#: So many failures within so many seconds make a provider unavailable.
MOST, SECONDS = 3, 3600


def windowed_metrics(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count and sum by event type and window of event time; rows later than ``late`` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def provider_health(failures: DataFrame) -> DataFrame:
    """(key, id, ts, recent, unavailable) for each failure (key, ts in seconds, id) of a stream, as it comes: the failures
    of its key in the window that ends with it, of those that are known by then.

    The state of a key is the times of its failures since a window before the latest, and stays. :func:`provider_states`
    waits for late events instead, and forgets.
    """

    def step(key, batches, state):
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for ts, same in rows.groupby("ts", sort=True):
            times += [int(ts)] * len(same)
            n = sum(ts - SECONDS < t <= ts for t in times)
            out += [(key[0], int(i), int(ts), n, n >= MOST) for i in same["id"]]
        state.update(([t for t in times if t > max(times) - SECONDS],))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "recent", "unavailable"])

    return failures.groupBy("key").applyInPandasWithState(step, "key string, id long, ts long, recent long, unavailable boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def advanced(times: list[int], down: bool, lost: bool, ts: int, failure: bool, permanent: bool) -> tuple[list[int], bool, bool, str | None]:
    """The state of a provider after an event: its recent failures, whether it is marked unavailable, whether for good,
    and what is to be reported. A recovery lifts the mark; a provider that is lost for good stays unavailable."""
    if not failure:
        return times, False, lost, "recovered" if down else None
    times = [t for t in times if t > ts - SECONDS] + [ts]
    if down or not (permanent or len(times) >= MOST):
        return times, down, lost, None
    return times, True, lost or permanent, "marked_unavailable"


def provider_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(key, id, ts, recent, available, permanent, event) for each event (key, ts in seconds, id, failure, permanent) of a
    stream, in the order of ts and id whatever the order they come in.

    Events wait in the state of their key until the watermark says that none before them can come any more; what is
    later than that is left out. A key whose failures are all older than a window and that is available is forgotten.
    """
    ship(events.sparkSession)
    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    columns = ["key", "id", "ts", "recent", "available", "permanent", "event"]

    def step(key, batches, state):
        waiting, times, down, lost = ([], [], False, False) if not state.exists else (list(zip(*state.get[:4], strict=True)), list(state.get[4]), state.get[5], state.get[6])
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b["ts"].tolist(), b["id"].tolist(), b["failure"].tolist(), b["permanent"].tolist(), strict=True)
        waiting.sort()
        out = []
        while waiting and waiting[0][0] * 1000 <= now:
            ts, i, failure, permanent = waiting.pop(0)
            times, down, lost, event = advanced(times, down, lost, ts, bool(failure), bool(permanent))
            out.append((key[0], i, ts, len([t for t in times if t > ts - SECONDS]), not (down or lost), lost, event))
        forget = not waiting and not down and not lost and (not times or times[-1] + SECONDS <= now // 1000)
        if forget:
            state.remove()
        else:
            at = [list(c) for c in zip(*waiting, strict=True)] if waiting else [[], [], [], []]
            state.update((*at, times, down, lost))
            # whole seconds: what waits is at least one after the watermark
            wake = waiting[0][0] * 1000 - 1 if waiting else (max(times[-1], now // 1000) + SECONDS) * 1000 if times else now + SECONDS * 1000
            state.setTimeoutTimestamp(max(wake, now + 1))
        yield pd.DataFrame(out, columns=columns)

    kept = "ts array<long>, id array<long>, failure array<boolean>, permanent array<boolean>, times array<long>, down boolean, lost boolean"
    return timed.groupBy("key").applyInPandasWithState(step, "key string, id long, ts long, recent long, available boolean, permanent boolean, event string", kept, "append", GroupStateTimeout.EventTimeTimeout)


def retained(events: DataFrame, now: int, seconds: int = 3600) -> DataFrame:
    """Events no older than ``seconds``."""
    return events.where(F.unix_seconds(F.col("ts").cast("timestamp")) >= now - seconds)


def retained_stream(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Events (event_id, ts) of a stream without repeats: what is older than ``seconds`` before the latest event is left
    out, and no state outlives that."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{seconds} seconds")
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def drained(spark: SparkSession, stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that a stream gives for the data there is now, as files in ``folder`` (else in the folder of checkpoints)."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    at = f"{base or tempfile.mkdtemp(prefix='lodestone-')}/streams/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
