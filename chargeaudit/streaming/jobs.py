"""Continuous jobs. Each gives the rows its batch counterpart gives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from chargeaudit import constants as c
from chargeaudit.operators.redact import count_column, labels, redact, with_gate
from chargeaudit.operators.rules import LINE, finding_columns, price_overcharges, with_explanations
from chargeaudit.session import broadcast_if_small


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer


def stream_redact(
    stream: DataFrame,
    safe_path: str,
    held_path: str,
    checkpoint: str,
    text_col: str = "text",
    profile: str = "safe",
    available_now: bool = True,
    gate_profile: str | None = None,
    counts_path: str | None = None,
) -> StreamingQuery:
    """Redact as texts arrive; only texts that pass the gate reach ``safe_path``.

    ``held_path`` gets the counts of the others but no text at all; ``gate_profile`` is the
    profile of the gate if it isn't that of the redaction. Each batch writes a folder of its
    own number, so a repeated batch replaces itself.

    ``counts_path`` gets one row for each batch, written last: texts, texts held, and matches
    and texts for each label, observed while the safe texts are written. A batch counts as
    committed to both sinks once that row is there; ``committed`` reads no others.
    """
    redacted = with_gate(redact(stream, text_col, profile), "redacted_text", gate_profile or profile).drop(text_col)
    names = [count_column(name) for name in labels(profile)]

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            seen = Observation()
            sums = [F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in names]
            texts = [F.count_if(F.col(name) > 0).alias(f"texts_{name}") for name in names]
            totals = [F.count("*").alias("n_texts"), F.count_if(~F.col("is_safe")).alias("n_held")]
            safe = batch.observe(seen, *totals, *sums, *texts).where("is_safe").drop("is_safe")
            safe.write.mode("overwrite").parquet(f"{safe_path}/batch={number}")
            held = batch.where("not is_safe").drop("is_safe", "redacted_text")
            held.write.mode("overwrite").parquet(f"{held_path}/batch={number}")
            if counts_path is not None:
                row = seen.get
                schema = ", ".join(f"{name} long" for name in row)
                counts = batch.sparkSession.createDataFrame([tuple(row.values())], schema)
                counts.coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/batch={number}")
        finally:
            batch.unpersist()

    writer = redacted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def committed(spark: SparkSession, path: str, counts_path: str) -> DataFrame:
    """Rows of a sink of ``stream_redact`` whose batch has reached all sinks."""
    batches = spark.read.parquet(counts_path).select("batch")
    return spark.read.parquet(path).join(broadcast_if_small(batches), "batch", "left_semi").drop("batch")


def label_counts(spark: SparkSession, counts_path: str, profile: str = "safe") -> DataFrame:
    """(label, n_matches, n_texts) over all committed batches."""
    totals = spark.read.parquet(counts_path)
    rows = [
        F.struct(
            F.lit(name).alias("label"),
            F.sum(count_column(name)).alias("n_matches"),
            F.sum(f"texts_{count_column(name)}").alias("n_texts"),
        )
        for name in labels(profile)
    ]
    return totals.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def stream_prices(
    lines: DataFrame,
    catalog: DataFrame,
    path: str,
    checkpoint: str,
    per_unit: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Overcharge findings of lines as they arrive, against a fixed catalog."""
    findings = with_explanations(price_overcharges(lines, catalog, per_unit))
    writer = (
        findings.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, available_now).start()


def throttle_audit(
    events: DataFrame,
    limit: int = c.REQUESTS_PER_MINUTE,
    window: str = "1 minute",
    client: str = "user_id",
    time: str = "ts",
    watermark: str | None = None,
) -> DataFrame:
    """Clients with more than ``limit`` events in a window, batch or stream.

    On a stream, give a ``watermark``; rows later than that are dropped.
    """
    timed = events.withColumn("_time", F.col(time).cast("timestamp"))
    if watermark is not None:
        timed = timed.withWatermark("_time", watermark)
    return (
        timed.groupBy(F.col(client), F.window("_time", window).alias("_window"))
        .agg(F.count("*").alias("n_events"))
        .where(F.col("n_events") > limit)
        .select(
            client,
            F.col("_window.start").alias("window_start"),
            "n_events",
            (F.col("n_events") - limit).alias("n_over"),
        )
    )


def stream_duplicates(
    lines: DataFrame,
    keys: Sequence[str] = ("bill_id", "code"),
    time: str = "ts",
    max_gap_days: int = 1,
    watermark: str | None = None,
) -> DataFrame:
    """Keys charged more than once within ``max_gap_days``, batch or stream.

    Every pair of charges that close falls into one of the overlapping windows
    of ``max_gap_days + 1`` days, so a counter per key and window is all the
    state that is kept; no charge is joined with another.
    """
    timed = lines.withColumn("_time", F.date_trunc("day", F.col(time).cast("timestamp")))
    if watermark is not None:
        timed = timed.withWatermark("_time", watermark)
    days = F.window("_time", f"{max_gap_days + 1} days", "1 day")
    return (
        timed.groupBy(*[F.col(key) for key in keys], days.alias("_days"))
        .agg(
            F.count("*").alias("n_charges"),
            F.min("_time").alias("first_day"),
            F.max("_time").alias("last_day"),
        )
        .where("n_charges > 1")
        .select(
            *keys,
            F.to_date("_days.start").alias("window_start"),
            "n_charges",
            F.to_date("first_day").alias("first_day"),
            F.to_date("last_day").alias("last_day"),
        )
    )


class ChargedDays(StatefulProcessor):
    """State of a shard of keys: lines of days that may still get more, and the keys' last closed days.

    A day closes when the watermark has passed it. Then all its lines are known, however they
    arrived, and its first line and the day before it decide what repeats what; so the result
    doesn't depend on the order of arrival. One timer wakes a shard for its earliest open day,
    and all days that have closed by then are judged together. Closed lines leave the state,
    and so does a last day that nothing can be near any more.
    """

    DAY = 86_400_000
    ROWS = 10_000  # rows of an entry of the state

    def __init__(self, line_schema: StructType, keys: list[str], place: list[str], max_gap_days: int):
        self.names = line_schema.names
        self.keys = keys
        self.place = place
        self.max_gap_days = max_gap_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.last = handle.getListState("last", "rows binary")
        self.closed = handle.getValueState("closed", "day long")

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for frame in rows:
            self.open.appendList(self._packed(frame[self.names]))
            earliest = min(int(frame["day_number"].min()), earliest if earliest is not None else 1 << 40)
        if earliest is not None:
            self.handle.registerTimer((earliest + 1) * self.DAY)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        closed = timerValues.getCurrentWatermarkInMs() // self.DAY  # the first day still open
        if self.closed.exists() and self.closed.get()[0] >= closed:
            yield pd.DataFrame()
            return
        self.closed.update((int(closed),))
        of_day = ["day_number", *self.keys]
        lines, last = self._rows(self.open, self.names), self._rows(self.last, of_day)
        is_done = lines["day_number"] < closed
        done, kept = lines[is_done], lines[~is_done]
        self._keep(self.open, kept)
        if len(kept):
            self.handle.registerTimer((int(kept["day_number"].min()) + 1) * self.DAY)
        # A key's days in order: most have one line and no day near, and only the others' lines are looked at.
        days = pd.concat([done.groupby(of_day, sort=False).size().reset_index(name="n"), last.assign(n=0)])
        days = days.drop_duplicates(of_day).sort_values([*self.keys, "day_number"])
        days["previous"] = days.groupby(self.keys, sort=False)["day_number"].shift()
        newest = days.drop_duplicates(self.keys, keep="last")[of_day]
        self._keep(self.last, newest[newest["day_number"] >= closed - self.max_gap_days])
        near = days["day_number"] - days["previous"] <= self.max_gap_days
        yield self._repeats(done.merge(days[(days["n"] > 1) | near].drop(columns="n"), on=of_day))

    def _repeats(self, done: pd.DataFrame) -> pd.DataFrame:
        of_day = ["day_number", *self.keys]
        done = done.sort_values([*of_day, *self.place], kind="stable")
        firsts = done.groupby(of_day, sort=False)[self.place].transform("first")
        later, equal = pd.Series(False, done.index), pd.Series(True, done.index)
        for name in self.place:
            later |= equal & (done[name] > firsts[name])
            equal &= done[name] == firsts[name]
        near = done["day_number"] - done["previous"] <= self.max_gap_days
        found = done.assign(later=later, related_day=done["previous"].where(~later, done["day_number"]))[later | near]
        found = found.astype({"related_day": "int64"})
        return found[[*self.names[1:], "later", "related_day"]]

    def _packed(self, rows: pd.DataFrame) -> list[tuple[bytes]]:
        """Rows as entries of the state, ``ROWS`` in one: a call for each row costs more than all else."""
        entries = []
        for start in range(0, len(rows), self.ROWS):
            batch = pa.RecordBatch.from_pandas(rows.iloc[start : start + self.ROWS], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            entries.append((sink.getvalue().to_pybytes(),))
        return entries

    @staticmethod
    def _rows(state, names: list[str]) -> pd.DataFrame:
        frames = [pa.ipc.open_stream(entry[0]).read_all().to_pandas() for entry in state.get()]
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({name: [] for name in names}).astype({"day_number": "int64"})

    def _keep(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put(self._packed(rows))
        else:
            state.clear()

    def close(self) -> None:
        pass


LINES_PER_SHARD = 50_000  # a task holds the lines of one shard at a time


def shards_for(n_lines: int, least: int = 16) -> int:
    """Shards for about so many lines that may be open at once, so that a shard's memory doesn't grow with the input."""
    return max(least, -(-n_lines // LINES_PER_SHARD))


def stream_duplicate_charges(
    lines: DataFrame,
    keys: Sequence[str] = ("bill_id", "code"),
    max_gap_days: int = 1,
    time: str = "ts",
    watermark: str = "1 day",
    shards: int = 64,
) -> DataFrame:
    """The findings of ``duplicate_charges``, on a stream: lines may arrive out of order within the watermark.

    ``lines`` has the columns of a charge line, those of ``keys``, and a timestamp ``time`` on
    the day of service. A finding is emitted when its day has closed. Keys are dealt to
    ``shards``, each with one state for all its keys, since a call of the state store costs as
    much for one key as for many; it should be some times the number of cores, and enough that
    the open lines of a shard fit into a task (``shards_for``). It can't be changed later. The session needs the RocksDB state store, see ``rocksdb_state``.
    """
    timed = lines.withWatermark(time, watermark)
    for key in keys:
        timed = timed.where(F.col(key).isNotNull())
    names = ["day_number", *dict.fromkeys([*keys, *LINE])]
    ready = timed.select(
        F.pmod(F.xxhash64(*keys), F.lit(shards)).alias("shard"),
        F.unix_date(F.to_date(time)).cast("long").alias("day_number"),
        *names[1:],
        time,
    )
    schema = StructType([ready.schema[name] for name in names])
    out = StructType([*schema.fields[1:], StructField("later", BooleanType()), StructField("related_day", LongType())])
    place = ["line_no"] if "bill_id" in keys else ["bill_id", "line_no"]
    found = ready.groupBy("shard").transformWithStateInPandas(
        ChargedDays(schema, list(keys), place, max_gap_days), out, "Append", "eventtime"
    )
    severity = F.when(F.col("later"), c.SAME_DAY_DUPLICATE_SEVERITY).otherwise(c.ADJACENT_DUPLICATE_SEVERITY)
    related = F.date_format(F.date_from_unix_date(F.col("related_day").cast("int")), "MM/dd/yyyy")
    return found.select(*LINE, *finding_columns("duplicate_charge", severity, related=related))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Start jobs with state of their own on the RocksDB store; the session's setting comes back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def write_windows(
    result: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append closed windows of the two windowed jobs to a table."""
    writer = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, available_now).start()
