"""Structured Streaming: ingest, windowed statistics with kept state, detections joined with flows, and the sinks.

The batch definitions of the library are reused: a stream is normalised by the same projections, and a micro-batch of a
windowed aggregation gives what the batch plan gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowmill.operators import windower


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A folder as a stream; a broker's source has the same place in a deployment."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", seconds: int | None = None, kind: str = "parquet") -> StreamingQuery:
    """Write to a sink folder: every `seconds`, or all that is there and then stop."""
    writer = df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def start_each(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", seconds: int | None = None) -> StreamingQuery:
    """Hand each micro-batch to a function (several sinks, upserts, a broker's client)."""
    writer = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def tumbling_counts(flows: DataFrame, time: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Flows and bytes per window and protocol; the watermark bounds the state."""
    return flows.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds").alias("w"), "protocol").agg(
        F.count("*").alias("n"), F.sum("in_bytes").alias("in_bytes")
    ).select(F.col("w.start").alias("time"), "protocol", "n", "in_bytes")


def detections_with_flows(detections: DataFrame, flows: DataFrame, retention: str = "1 hour") -> DataFrame:
    """Inner join on flow_id; both sides keep state for the retention, as the tables of the dashboards do."""
    d = detections.withWatermark("event_time", retention).alias("d")
    f = flows.withWatermark("time", retention).alias("f")
    near = F.expr(f"d.event_time >= f.time AND d.event_time <= f.time + interval {retention}")
    return d.join(f, (F.col("d.flow_id") == F.col("f.flow_id")) & near).select(
        "d.flow_id", "d.event_name", "d.detector", "d.metric", "d.event_time", "f.ip_src", "f.ip_dst", "f.protocol"
    )


WINDOW_STATE = "first long, current long, flows long, bytes long, history array<struct<id:long,flows:long,bytes:long>>"
WINDOW_OUT = "ip_src string, window_id long, flows long, bytes long, closed long, mean_flows double, mean_bytes double"


def stateful_windows(flows: DataFrame, window_ms: int, min_flows: int = 2, timeout: int = 700, max_windows: int = 200, t0: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Per source: each window when it closes, with the mean of the closed windows before it.

    Windows are right-closed on the grid of t0. State holds the open window and at most max_windows closed ones not older
    than the timeout, and survives restarts; a late flow is counted in the open window. A window closes when
    a later flow of the source comes. The state of a source that is idle for idle_ms of processing time is dropped. For all 58
    features see feature_batches.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, flows_now, bytes_now, past = -1, 0, 0, []
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            _, current, flows_now, bytes_now, kept = state.get
            past = [tuple(x) for x in kept]
        out = []
        rows = pd.concat(list(parts)).sort_values(["end_ms", "arrival_seq"], kind="stable")
        for end, size in zip(rows["end_ms"], rows["in_bytes"]):
            window = max(current, 0, -(-(int(end) - t0) // window_ms) - 1)
            if window > current:
                if current >= 0:
                    past = [x for x in past if current - x[0] <= timeout][-max_windows:]
                    n = len(past)
                    out.append((key[0], current, flows_now, bytes_now, n, sum(x[1] for x in past) / n if n else 0.0, sum(x[2] for x in past) / n if n else 0.0))
                    if flows_now >= min_flows:
                        past.append((current, flows_now, bytes_now))
                current, flows_now, bytes_now = window, 0, 0
            flows_now, bytes_now = flows_now + 1, bytes_now + int(size)
        state.update((t0, current, flows_now, bytes_now, past))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in WINDOW_OUT.split(", ")])

    return flows.groupBy("ip_src").applyInPandasWithState(run, WINDOW_OUT, WINDOW_STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def feature_batches(folder: str, settings: windower.Settings = windower.Settings(), first_ms: int | None = None, reset_per_batch: bool = False) -> Callable[[DataFrame, int], None]:
    """A handler for start_each: each flow's history features, as windower.window_features gives them, in folder/features/batch=N.

    folder/state/N holds what the next batch needs: the flows of the current window, the statistics of closed windows within the
    timeout and the clock. So a source that is idle for longer leaves the state, and a batch that is run again after a failure reads
    the state before it and overwrites its own results. Windows are on the grid of first_ms (default: the first batch's
    least end). With reset_per_batch nothing is kept, and each batch is a capture of its own.
    """
    keys = ["ip_src", "window_id"]

    def handle(batch: DataFrame, number: int) -> None:
        spark, here, last = batch.sparkSession, f"{folder}/state/{number}", f"{folder}/state/{number - 1}"
        clock = None if reset_per_batch or not number else spark.read.json(f"{last}/clock").first()
        start = clock["first_ms"] if clock else first_ms if first_ms is not None else batch.agg(F.min("end_ms")).first()[0]
        placed = windower.assign_windows(batch, settings.window_ms, start or 0).withColumn("new", F.lit(True))
        if clock:
            placed = placed.withColumn("window_id", F.greatest("window_id", F.lit(clock["now"])))
            open_flows = spark.read.parquet(f"{last}/rows").where(F.col("window_id") == clock["now"]).withColumn("new", F.lit(False))
            placed = placed.unionByName(open_flows)
        placed.write.mode("overwrite").parquet(f"{here}/rows")
        rows = spark.read.parquet(f"{here}/rows")
        now = rows.agg(F.max("window_id")).first()[0]
        now = now if now is not None else clock["now"] if clock else 0
        stats = windower.window_stats(rows.drop("new"), settings)
        if clock:
            stats = stats.unionByName(spark.read.parquet(f"{last}/stats").where((F.col("window_id") < clock["now"]) & (F.col("window_id") >= clock["now"] - settings.timeout)))
        stats.write.mode("overwrite").parquet(f"{here}/stats")
        past = windower.history(spark.read.parquet(f"{here}/stats"), settings)
        features = rows.where("new").select("arrival_seq", *keys).join(past, keys).drop("window_total", "window_span")
        features.write.mode("overwrite").parquet(f"{folder}/features/batch={number}")
        spark.createDataFrame([(start, now)], "first_ms long, now long").coalesce(1).write.mode("overwrite").json(f"{here}/clock")
        if number > 1:
            _drop(spark, f"{folder}/state/{number - 2}")

    return handle


def run_available(spark: SparkSession, df: DataFrame, folder: str, mode: str = "append", schema: str | None = None) -> DataFrame:
    """Run a stream over all that is there into Parquet below `folder`, and read the result."""
    sink = f"{folder}/out"
    if mode == "append":
        start(df, sink, f"{folder}/checkpoint").awaitTermination()
    else:
        start_each(df, lambda batch, _: batch.write.mode("overwrite").parquet(sink), f"{folder}/checkpoint", mode).awaitTermination()
    return spark.read.schema(schema or df.schema).parquet(sink)
