"""Streaming over run events and run output lines.

``live_sessions`` merges a run's events into sessions that end after a gap; a watermark
bounds the state, so a session is emitted once no late event can extend it.
``parse_lines`` turns the output lines of a run into tagged events; it needs no state.
``preview_blocks`` keeps the open multi-line block of each run in state and emits it when
the next event line arrives, or once the watermark says that none will.
``upsert_batches`` writes the latest row of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP = "120 seconds"
LATE = "10 minutes"


def _timed(events: DataFrame) -> DataFrame:
    """Event time as an instant; tables without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def live_sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(user_id, start, end, n): one row for each run of events without the gap."""
    return (
        _timed(events).withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events per type and tumbling window."""
    return (
        _timed(events).withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def line_event(line: Column) -> Column:
    """struct(kind, num, name, detail) of an output line."""
    stage = r"^\[(\d+(?:\.\d+)?)/\d+\]\s*([^:]+)"
    marker = r"^\s*(?:→|->)\s*(vault|inbox|merge)(?:\s*\(([^)]*)\))?"
    is_stage, is_marker = line.rlike(stage), line.rlike(marker)
    return F.struct(
        F.when(is_stage, "stage").when(is_marker, F.regexp_extract(line, marker, 1)).otherwise("log").alias("kind"),
        F.when(is_stage, F.regexp_extract(line, stage, 1).cast("double")).alias("num"),
        F.when(is_stage, F.trim(F.regexp_extract(line, stage, 2))).alias("name"),
        F.when(is_marker, F.nullif(F.regexp_extract(line, marker, 2), F.lit(""))).alias("detail"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines with their event columns."""
    return lines.withColumn("e", line_event(F.col("value"))).select(*lines.columns, "e.*")


def preview_blocks(parsed: DataFrame, late: str = LATE, wait_ms: int = 120_000) -> DataFrame:
    """Blocks of consecutive log lines of a run, emitted when another event follows.

    Lines have an event time ``ts``.  A run's lines come in order of ``seq``; a line that
    comes after one of a greater ``seq`` is put in its place only within its micro-batch.
    The open block of a run without further lines is emitted when the watermark passes its
    last line by ``wait_ms``, so the result does not depend on the clock."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (held,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "block": [held]})
            return
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        done = []
        for kind, value in zip(rows["kind"], rows["value"], strict=True):
            if kind == "log":
                held = f"{held}\n{value}" if held else value
            elif held:
                done.append(held)
                held = ""
        if held:
            state.update((held,))
            last = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"run_id": [key[0]] * len(done), "block": done})

    return (
        _timed(parsed).withWatermark("ts", late)
        .groupBy("run_id")
        .applyInPandasWithState(step, "run_id string, block string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def blocks(lines: DataFrame) -> DataFrame:
    """(run_id, at, block) of a whole log: what the stream and its final flush emit, in batch.

    A block is a run of log lines between two events; its number is that of events before."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parse_lines(lines).withColumn("at", F.sum((F.col("kind") != "log").cast("int")).over(w)).where("kind = 'log'")
    part = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return rows.groupBy("run_id", "at").agg(F.array_join(F.transform(part, lambda x: x["value"]), "\n").alias("block"))


def upsert_batches(updates: DataFrame, path: str, key: str, order: str):
    """A foreachBatch writer: the table at ``path`` keeps the latest row of each key.

    Each batch writes a new version beside the last and a reader takes the newest, so a
    batch that runs again after a failure overwrites its own version only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if batch_id:
            merged = batch.unionByName(spark.read.parquet(f"{path}/v={batch_id - 1}"))
        rest = [c for c in merged.columns if c != key]
        latest = merged.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return updates.writeStream.outputMode("append").foreachBatch(write)


def run_events(lines: DataFrame) -> DataFrame:
    """(run_id, place, kind, detail): the events of a finished run's lines, and its exit behind them."""
    seen = parse_lines(lines).select("run_id", F.struct(F.lit(0).alias("end"), "seq").alias("place"), "kind", "detail")
    last = lines.groupBy("run_id").agg(F.max("seq").alias("seq"))
    end = last.select("run_id", F.struct(F.lit(1).alias("end"), "seq").alias("place"), F.lit("exited").alias("kind"), F.lit(None).cast("string").alias("detail"))
    return seen.unionByName(end)


def admitted(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The first request of each key: one session at a time."""
    return requests.groupBy(key).agg(F.min(order).alias(order))
