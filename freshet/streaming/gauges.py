"""Streaming surface: windowed gauge readings with late data, a token bucket per client, stages for a stream of discharges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.functions.scalar import interp

#: Rows of a frame that a task gives back at once.
PIECE = 10_000


def windowed(readings: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """site, start, n, mean and peak of readings (site, ts, value) per window; as a stream, rows later than `late` are dropped."""
    source = readings.withWatermark("ts", late) if readings.isStreaming else readings
    return source.groupBy("site", F.window("ts", length, slide or length).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak")).select("site", F.col("w.start").alias("start"), "n", "mean", "peak")


def admit(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float]:
    """Whether a request at `now` is admitted, and the tokens left."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def token_bucket(requests: DataFrame, per_minute: float = 30.0, burst: int = 10, late: str = "10 minutes") -> DataFrame:
    """client, ts, admitted of a stream of requests (client, ts): continuous refill, in event time.

    Spark hands a client's requests over in pieces of any order, so those of a micro-batch are put in order of time before they are
    judged; times are whole microseconds, of which differences are exact. An idle bucket is dropped once the watermark says that it is
    full again, so the state holds recent clients only.
    """
    if per_minute <= 0 or burst < 1:
        raise ValueError("the rate must be positive and the burst at least 1")
    rate = per_minute / 60

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(burst), None)
        rows = pd.concat([part[["ts", "us"]] for part in parts]).sort_values("us", kind="stable")
        out = []
        for now in rows["us"].tolist():
            good, tokens = admit(tokens, 0.0, 0.0 if last is None else (now - last) / 1e6, rate, burst)
            last = now if last is None else max(last, now)
            out.append(good)
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last / 1000 + 1000 * burst / rate), state.getCurrentWatermarkMs() + 1))
        for at in range(0, len(rows), PIECE):
            yield pd.DataFrame({"client": key[0], "ts": rows["ts"].iloc[at : at + PIECE].to_numpy(), "admitted": out[at : at + PIECE]})

    timed = requests.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("client").applyInPandasWithState(step, "client long, ts timestamp, admitted boolean", "tokens double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def stages(discharges: DataFrame, curves: DataFrame) -> DataFrame:
    """Stage of every reading of discharge (reach, ts, discharge_cms) on the static curves (reach, stages, flows): stream-static join."""
    return discharges.join(curves, "reach").select(*discharges.columns, interp(F.col("discharge_cms"), F.col("flows"), F.col("stages")).alias("stage_m"))


def extents(stage_stream: DataFrame, extent: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write the extent of every micro-batch of stages (reach, step, stage_m): a folder a batch, with the batch's last step.

    extent gives cell, depth_m and connected for one stage a reach. A batch that is run again overwrites its own folder with the same
    rows, so a restart after a lost driver changes nothing; connectivity is decided within the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("reach").agg(F.max_by("stage_m", "step").alias("stage_m"))
        step = batch.agg(F.max("step").alias("step"))
        extent(last).crossJoin(F.broadcast(step)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # one step a batch

    return stage_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
