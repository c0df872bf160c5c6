"""Keyed state, sinks and restarts of the continuous jobs."""

import datetime as dt
import os
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chargeaudit.operators.rules import duplicate_charges
from chargeaudit.plans.queries import QUERIES
from chargeaudit.streaming import jobs

LINES = (
    "patient_id int, bill_id long, line_no long, code string, description string, quantity long, "
    "billed_amount double, service_date string, ts timestamp"
)


def _lines(n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        # A third of all lines belong to one patient and code.
        patient, code = (1, "A") if i % 3 == 0 else (rng.randrange(1, 9), rng.choice("ABC"))
        day = start + dt.timedelta(days=rng.randrange(60))
        price = None if rng.random() < 0.2 else float(rng.randrange(99))
        rows.append((patient, rng.randrange(40), i, code, rng.choice(["x", None]), 1, price, day.strftime("%m/%d/%Y"), day))
    return rows


def test_duplicates_with_state_equal_batch_however_lines_arrive(spark, tmp_path):
    rows = _lines(400, 3)
    rows += [(None, 1, 900, "A", "x", 1, 1.0, "01/05/2024", dt.datetime(2024, 1, 5)), (2, 1, 901, None, "x", 1, 1.0, "01/05/2024", dt.datetime(2024, 1, 5))]
    rng = random.Random(1)
    arrival = sorted(rows, key=lambda r: (r[-1] + dt.timedelta(days=rng.randrange(3))).toordinal())
    beat = (-1, -1, 0, "", None, None, None, None, dt.datetime(2026, 1, 1))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [arrival[:150], arrival[150:151], arrival[151:], [beat]]
    with jobs.rocksdb_state(spark):
        for number, batch in enumerate(batches):
            spark.createDataFrame(batch, LINES).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(LINES).parquet(source)
            found = jobs.stream_duplicate_charges(stream, ("patient_id", "code"), watermark="4 days")
            jobs.write_windows(found, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    expected = duplicate_charges(spark.createDataFrame(rows, LINES), ("patient_id", "code"))
    ours = spark.read.parquet(out).select(*expected.columns)
    assert expected.count() > 50
    assert sorted(map(str, ours.collect())) == sorted(map(str, expected.collect()))


def test_state_takes_lines_by_the_batch():
    class State(list):
        def appendList(self, entries):
            self.extend(entries)

        def put(self, entries):
            self[:] = entries

        def get(self):
            return iter(self)

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):
            return self.states.setdefault(name, State())

        def getValueState(self, name, schema):
            return type("Value", (), {"exists": lambda self: False, "update": lambda self, value: None})()

        def registerTimer(self, at):
            self.timers.append(at)

    rows = [(n % 40, n % 900, "AB"[n % 2], n, n, None, 1, 1.0, "d") for n in range(25_000)]
    names = ["day_number", "patient_id", "code", "bill_id", "line_no", "description", "quantity", "billed_amount", "service_date"]
    schema = StructType([StructField(name, StringType() if name in ("code", "description", "service_date") else LongType()) for name in names])
    handle, job = Handle(), jobs.ChargedDays(schema, ["patient_id", "code"], ["bill_id", "line_no"], 1)
    job.init(handle)
    list(job.handleInputRows(None, iter([pd.DataFrame(rows, columns=names)]), None))
    assert len(handle.states["open"]) == 3 and handle.timers == [jobs.ChargedDays.DAY]
    watermark = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 30 * jobs.ChargedDays.DAY})()
    (found,) = job.handleExpiredTimer(None, watermark, None)
    firsts = {}
    for row in rows:
        firsts.setdefault(row[:3], row[4])
    assert sorted(found["line_no"][found["later"]]) == [r[4] for r in rows if r[0] < 30 and firsts[r[:3]] != r[4]]
    assert len(handle.states["open"]) == 1 and handle.timers[-1] == 31 * jobs.ChargedDays.DAY
    assert list(found.columns) == [*names[1:], "later", "related_day"]


def test_sinks_commit_once_and_count(spark, tmp_path):
    texts = [(1, "call 555-123-4567 now"), (2, "nothing"), (3, "seen on 01/02/2024 mail a@b.co"), (4, None), (5, "mail c@d.org and e@f.org")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    source = str(tmp_path / "in")
    paths = [str(tmp_path / name) for name in ("safe", "held", "checkpoint")]
    counts = str(tmp_path / "counts")

    def run():
        stream = spark.readStream.schema(docs.schema).parquet(source)
        jobs.stream_redact(stream, *paths, profile="parity", gate_profile="strict", counts_path=counts).awaitTermination(120)

    def state():
        sinks = [sorted((r.doc_id, r.n_total) for r in jobs.committed(spark, p, counts).collect()) for p in paths[:2]]
        return sinks, {r.label: (r.n_matches, r.n_texts) for r in jobs.label_counts(spark, counts, "parity").collect()}

    docs.where("doc_id < 4").coalesce(1).write.mode("append").parquet(source)
    run()
    docs.where("doc_id >= 4").coalesce(1).write.mode("append").parquet(source)
    run()
    sinks, labels = state()
    assert sorted(sinks[0] + sinks[1]) == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 2)]
    assert labels["EMAIL"] == (3, 2) and labels["PHONE"] == (1, 1)
    assert "text" not in jobs.committed(spark, paths[1], counts).columns
    # The run dies before its last batch is marked as done: the batch comes again and replaces itself.
    last = max(int(n) for n in os.listdir(f"{paths[2]}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{paths[2]}/commits/{name}"):
            os.remove(f"{paths[2]}/commits/{name}")
    run()
    assert state() == (sinks, labels)


def test_a_batch_without_its_counts_is_not_read(spark, tmp_path):
    safe, counts = str(tmp_path / "safe"), str(tmp_path / "counts")
    spark.range(3).write.parquet(f"{safe}/batch=0")
    spark.range(3, 5).write.parquet(f"{safe}/batch=1")
    spark.createDataFrame([(3,)], "n_texts long").write.parquet(f"{counts}/batch=0")
    assert sorted(r.id for r in jobs.committed(spark, safe, counts).collect()) == [0, 1, 2]


def test_throttle_of_late_events_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2024, 3, 1)
    rows = [(rng.randrange(4), start + dt.timedelta(minutes=rng.randrange(600))) for _ in range(300)]
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(20)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id int, ts timestamp"
    for batch in (arrival[:100], arrival[100:], [(None, start + dt.timedelta(days=9))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        over = jobs.throttle_audit(stream, limit=3, window="15 minutes", watermark="30 minutes")
        jobs.write_windows(over, out, str(tmp_path / "checkpoint")).awaitTermination(60)
    expected = jobs.throttle_audit(spark.createDataFrame(rows, schema), limit=3, window="15 minutes")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, expected.collect()))
    assert expected.where(F.col("n_over") > 0).count() > 5


def test_stream_of_a_table_that_is_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"text {n} mail a{n}@b.org") for n in range(9)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    rows = [sorted(map(str, QUERIES["stream_redact"](spark, str(tmp_path / kind)).collect())) for kind in ("file", "folder")]
    assert len(rows[0]) == 9 and rows[0] == rows[1]


def test_shards_grow_with_the_lines():
    assert jobs.shards_for(1000) == 16
    for n_lines in (10**6, 10**8):
        assert n_lines / jobs.shards_for(n_lines) <= jobs.LINES_PER_SHARD


def test_the_duplicate_stream_deals_its_keys_by_its_lines(spark, monkeypatch):
    asked = []
    started = jobs.stream_duplicate_charges
    monkeypatch.setattr(jobs, "LINES_PER_SHARD", 250, raising=False)
    monkeypatch.setattr(jobs, "stream_duplicate_charges", lambda *a, shards, **k: asked.append(shards) or started(*a, shards=shards, **k))
    folder = "/root/testdata/sf0.001"
    ours = QUERIES["stream_duplicate_charge"](spark, folder)
    assert set(asked) == {-(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // 250)}
    assert sorted(map(str, ours.collect())) == sorted(map(str, QUERIES["duplicate_charge"](spark, folder).select(*ours.columns).collect()))
