"""Streaming forms of resampling and alerting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.session import new_path


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with a declared schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into files of the shared folder, and read them back."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = write(stream, f"{path}/data", f"{path}/checkpoint", mode, available_now=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False) -> StreamingQuery:
    """Exactly-once parquet sink."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def hourly_means(
    stream: DataFrame, entity: str, ts: str, variable: str, value: str, delay: str = "1 hour"
) -> DataFrame:
    """Mean per entity, hour and variable; an hour is emitted once the watermark has passed its end."""
    hour = F.window(ts, "1 hour")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.col(entity), F.col(variable), hour)
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
        .select(entity, variable, F.col("window.start").alias("hour"), "mean", "n")
    )


def alert_feed(
    stream: DataFrame, thr: float, refractory_h: float = 24, entity: str = "stay_id", ts: str = "index_time", prob: str = "prob", delay: str = "1 hour"
) -> DataFrame:
    """Alerts of a scored stream with refractory suppression, the same whatever order rows arrive in within ``delay``.

    A hit waits in its entity's state until the watermark has passed it, since an earlier hit that is still on its way
    would silence it. Then waiting hits are judged in time order. The state is the waiting hits (those of the last
    ``delay``) and the end of the running silence; event-time timers bring it up when no new row does, and it is
    forgotten once nothing waits and the silence is over. Rows behind the watermark are dropped.
    """
    wait = int(refractory_h * 3_600_000_000)
    # all rows move the watermark, not only hits: a condition that names the time is not pushed below it
    hit = F.when(F.col(ts).isNotNull(), F.col(prob)) >= F.lit(float(thr))
    hits = stream.withWatermark(ts, delay).where(hit).select(F.col(entity).alias("entity"), F.col(ts).alias("at"))

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, waiting = state.get if state.exists else (None, [])
        known = [np.asarray(waiting, dtype=np.int64)]
        if not state.hasTimedOut:
            known += [b["at"].astype("datetime64[us]").to_numpy().astype("int64") for b in batches]
        times = np.unique(np.concatenate(known))
        passed_ms = state.getCurrentWatermarkMs()
        ready, waiting = times[times <= passed_ms * 1000], times[times > passed_ms * 1000]
        kept = []
        at = 0 if until is None else int(np.searchsorted(ready, until))
        while at < len(ready):
            kept.append(int(ready[at]))
            until = kept[-1] + wait
            at = int(np.searchsorted(ready, until))
        if len(waiting) or (until is not None and until > passed_ms * 1000):
            state.update((until, waiting.tolist()))
            due = int(waiting[0]) if len(waiting) else until
            # a timer goes off once the watermark is beyond it, and a hit is ready once the watermark has reached it
            state.setTimeoutTimestamp(max(-(-due // 1000) - 1, passed_ms))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"entity": [key[0]] * len(kept), "alert_us": kept})

    kind = stream.schema[entity].dataType.simpleString()
    kept = hits.groupBy("entity").applyInPandasWithState(
        judge, f"entity {kind}, alert_us long", "until long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return kept.select(F.col("entity").alias(entity), F.timestamp_micros("alert_us").alias("alert_time"))


def arriving(df: DataFrame, ts: str, slices: int = 5, jitter_minutes: int = 50, name: str = "arriving") -> str:
    """Write rows as ``slices`` files in the order of a jittered time, one after the other; the folder to stream from.

    A reader that takes one file a trigger then sees rows out of order by up to the jitter.
    """
    path = new_path(df.sparkSession, name)
    seconds = F.unix_seconds(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*df.columns), F.lit(jitter_minutes * 60))
    timed = df.withColumn("__s", seconds)
    ends = timed.agg(F.min("__s").alias("lo"), F.max("__s").alias("hi")).first()
    width = max(1, -(-(ends["hi"] - ends["lo"] + 1) // slices)) if ends["lo"] is not None else 1
    for i in range(slices if ends["lo"] is not None else 0):
        part = timed.where(F.floor((F.col("__s") - ends["lo"]) / width) == i).drop("__s")
        part.coalesce(1).write.mode("append").parquet(path)
    return path
