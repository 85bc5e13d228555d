"""Captures as a stream: ingestion, changes by state, changes in windows of time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.captures import snapshot_fields
from ..operators.html import clean_pages
from ..sources.log import append_run

TARGET = ["county", "page_type"]


def read_captures(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Captures as files arrive. Event times need a zone: times without one are in the session's."""
    df = spark.readStream.schema(schema).format(kind).load(path)
    return df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def deduplicated(captures: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Each capture once, if its copies come within the lateness."""
    return captures.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark([*keys, "fetched_at"])


def ingest(captures: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `batch` on all captures that are there: clean them, append to history, merge into latest. Restarts go on
    where the checkpoint stands; a batch may come again after a failure, with its number, so `batch` writes by number."""
    return captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture_job(root: str) -> Callable[[DataFrame, int], None]:
    """A batch of captures (county, page_type, html, content_type, error, fetched_at, ...): cleaned and appended to the archive
    (sources.log) as the run of the batch's number, so that one that comes again adds nothing. Copies of a capture count once; one that
    comes late goes into the history and does not replace a newer one."""

    def run(batch: DataFrame, number: int) -> None:
        append_run(snapshot_fields(clean_pages(batch)).drop("html"), root, number)

    return run


def changes(captures: DataFrame, keys: list[str], contents: tuple[str, ...] = ("html_sha256", "text_sha256")) -> DataFrame:
    """Changes as they come: keys, fetched_at, previous, content (of the first of the contents). A capture differs if any of
    its contents does. State is the contents' hashes and the time of each target's last capture.

    Captures of a batch are put in order of time; one that is older than the state is late and changes nothing.
    """
    types = dict(captures.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("fetched_at", kind="stable")
        *last, at = state.get if state.exists else (*[None] * len(contents), None)
        out = []
        for when, *values in rows[["fetched_at", *contents]].itertuples(index=False):
            if at is not None and when.value // 1000 < at:
                continue
            if at is not None and values != last:
                out.append((*key, when, last[0], values[0]))
            last, at = values, when.value // 1000
        state.update((*last, at))
        yield pd.DataFrame(out, columns=[*keys, "fetched_at", "previous", "content"])

    held = ", ".join(f"last{k} string" for k in range(len(contents)))
    return captures.groupBy(*keys).applyInPandasWithState(step, f"{key_schema}, fetched_at timestamp, previous string, content string", f"{held}, at long", "append", GroupStateTimeout.NoTimeout)


def followed(captures: DataFrame, keys: list[str], silence: str, lateness: str = "1 day", contents: tuple[str, ...] = ("html_sha256", "text_sha256")) -> DataFrame:
    """Changes as they come, of state that ends: keys, fetched_at, status, previous, content (of the first of the contents).

    A target without a capture for longer than `silence` gives one row `stale`, at its last capture's time plus silence, and its state
    goes, so state holds only targets that are still captured; its next capture is a first one. Other rows are `changed`. The row comes
    when a later capture of the target shows the gap, or when the watermark (the latest capture's time less `lateness`) has passed it.
    Captures older than the watermark are dropped, ones older than their target's state change nothing. As a table: history.gaps.
    """
    types = dict(captures.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    span = pd.Timedelta(silence).value // 1000
    held = ", ".join(f"last{k} string" for k in range(len(contents)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        *last, at = state.get if state.exists else (*[None] * len(contents), None)
        if state.hasTimedOut:
            at = _gone_silent(out, key, at + span, last)
        else:
            rows = pd.concat(list(batches)).sort_values("at_us", kind="stable")
            for when, *values in rows[["at_us", *contents]].itertuples(index=False):
                if at is not None and when < at:
                    continue
                if at is not None and when > at + span:
                    at = _gone_silent(out, key, at + span, last)
                values = [None if pd.isna(v) else v for v in values]
                if at is not None and values != last:
                    out.append((*key, when, "changed", last[0], values[0]))
                last, at = values, int(when)
            ends = -(-(at + span) // 1000)
            if ends <= state.getCurrentWatermarkMs():
                at = _gone_silent(out, key, at + span, last)
        if at is None:
            state.remove()
        else:
            state.update((*last, at))
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame(out, columns=[*keys, "at_us", "status", "previous", "content"])

    timed = captures.withWatermark("fetched_at", lateness).withColumn("at_us", F.unix_micros("fetched_at"))
    out = timed.groupBy(*keys).applyInPandasWithState(step, f"{key_schema}, at_us long, status string, previous string, content string", f"{held}, at long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, F.timestamp_micros("at_us").alias("fetched_at"), "status", "previous", "content")


def _gone_silent(out: list[tuple], key: tuple, when: int, last: list) -> None:
    """Adds the row; what is returned is the time of the last capture from here on: none."""
    out.append((*key, when, "stale", last[0], None))


def per_window(changed: DataFrame, width: str = "3 hours", lateness: str | None = None) -> DataFrame:
    """Changes in tumbling windows; with a lateness for streams, without one for tables."""
    if lateness:
        changed = changed.withWatermark("fetched_at", lateness)
    return changed.groupBy(F.window("fetched_at", width)).agg(F.count("*").alias("n_changes")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_changes")
