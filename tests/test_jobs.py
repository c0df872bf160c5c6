import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from chargeaudit.operators import checks, extract
from chargeaudit.operators.catalog import build_catalog, compute_rates, require_columns, with_document
from chargeaudit.plans import queries, tables
from chargeaudit.plans.audit import audit_bills
from chargeaudit.sources.files import classify_files, numbered_names, read_below_preamble, read_strings
from chargeaudit.sources.tables import catalog_readiness, current_version, publish_catalog, read_catalog
from chargeaudit.streaming import jobs

CODE_TABLE = "code string, long_description string, short_description string"


def _catalog(spark, rows):
    return spark.createDataFrame(rows, "code string, medicare_reference_price double")


def test_candidate_codes(spark):
    many = " ".join(f"{n:05d}" for n in range(110))
    texts = [(1, "99213 j0696 99213 A0428 x99213 123456"), (2, "nothing"), (3, many)]
    bills = spark.createDataFrame(texts, "bill_id int, redacted_text string")
    found = extract.candidate_codes(bills)
    rows = [(r.bill_id, r.code) for r in found.orderBy("bill_id", "position").collect()]
    assert [code for bill, code in rows if bill == 1] == ["99213", "J0696", "A0428"]
    assert len([1 for bill, _ in rows if bill == 3]) == 110
    assert extract.candidate_codes(bills, limit=100).where("bill_id = 3").count() == 100


@pytest.mark.parametrize("length, status", [(49, "bill_too_short"), (50, "ok")])
def test_text_status(spark, length, status):
    df = spark.createDataFrame([("\n " + "x" * length + " \t",)], "redacted_text string")
    assert extract.with_text_status(df).first().text_status == status


def test_pages_in_parts(spark):
    pages = spark.createDataFrame(
        [(1, 2, " b "), (1, 1, "a"), (1, 3, " \n"), (1, 4, "d"), (2, 1, None)],
        "bill_id int, page_no int, text string",
    )
    whole = {r.bill_id: (r.text, r.status) for r in extract.assemble_pages(pages).collect()}
    assert whole == {1: ("[Page 1]\na\n\n[Page 2]\nb\n\n[Page 4]\nd", "ok"), 2: (None, "ocr_failed")}
    parts = extract.assemble_pages(pages, pages_per_part=2).where("bill_id = 1").orderBy("part_no").collect()
    assert "\n\n".join(r.text for r in parts) == whole[1][0]


def test_findings_report(spark):
    good = '{"description":"d","anomaly_type":"upcoding","severity":"low","explanation":"e","suggested_action":"a"}'
    bad = ['{"anomaly_type":"upcoding"}', good.replace("upcoding", "other"), good.replace('"d"', "5"),
           good.replace('"d"', '"d","quantity":0')]
    report = '{"total_line_items": 7, "anomalies": [' + ",".join([good, *bad]) + "]}"
    df = spark.createDataFrame([(1, report), (2, "broken"), (3, "{}")], "bill_id int, report string")
    assert [(r.bill_id, r.item_no, r.quantity) for r in checks.parse_findings(df).collect()] == [(1, 0, 1)]
    stats = {r.bill_id: (r.total_line_items, r.n_reported, r.n_valid, r.n_skipped) for r in checks.finding_stats(df).collect()}
    assert stats == {1: (7, 5, 1, 4), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_raw_files(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_bytes(
        "Title é,,\n\nHCPCS,MOD,Work RVU,FAC PE RVU,MP RVU\n99213, ,1.0,1.5,0.05\n99213,26,9,9,9\nabc12,,x,,2\nbad,,1,1,1\n".encode("latin-1")
    )
    raw = read_below_preamble(spark, str(path))
    assert raw.columns == ["row_id", "hcpcs", "mod", "work_rvu", "fac_pe_rvu", "mp_rvu"]
    rates = {r.code: (r.total_rvu, r.medicare_reference_price) for r in compute_rates(raw, ["row_id"]).collect()}
    assert rates == {"99213": (2.55, 83.49), "ABC12": (2.0, 65.48)}
    plain = tmp_path / "codes.csv"
    plain.write_text("Code , Long Description\n1,a\n")
    assert read_strings(spark, str(plain)).columns == ["code", "long_description"]
    assert numbered_names(["rvu", "x", "rvu"]) == ["rvu", "x", "rvu.1"]
    with pytest.raises(ValueError, match="missing columns: y"):
        require_columns(raw, ["y"])


def test_records_across_lines_and_blocks(spark, tmp_path):
    rng = random.Random(4)
    cells = ["plain", 'say ""hi""', "two\nlines", "a,b", "\n\n", "é", "x" * 40, "", "cr\r\nlf", '""']
    rows = [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(400)]
    for name in ("a", "b"):
        body = "".join(",".join(f'"{v}"' for v in row) + ("\r\n" if name == "b" else "\n") for row in rows)
        head = "Title\n\nHCPCS,MOD,Text\n" if name == "a" else "HCPCS,Text,MOD\n"
        (tmp_path / f"{name}.csv").write_bytes((head + body).encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
    try:
        raw = read_below_preamble(spark, str(tmp_path))
        assert raw.columns == ["row_id", "hcpcs", "mod", "text"]
        ours = [(r.hcpcs, r.mod, r.text) for r in raw.orderBy("hcpcs").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    clean = [[v.replace('""', '"') for v in row] for row in rows]
    expected = [tuple(v or None for v in row) for row in clean] + [(i or None, b or None, a or None) for i, a, b in clean]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(ours, key=key) == sorted(expected, key=key)
    ordered = [r.hcpcs for r in read_below_preamble(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()]
    assert ordered == [str(i) for i in range(400)]
    (tmp_path / "open.csv").write_text('HCPCS,MOD\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="never closes"):
        read_below_preamble(spark, str(tmp_path / "open.csv"))
    (tmp_path / "none.csv").write_text("\n".join(f"a{i},b" for i in range(12)))
    with pytest.warns(UserWarning, match="line 9"):
        assert read_below_preamble(spark, str(tmp_path / "none.csv")).columns == ["row_id", "a9", "b"]


def test_uploads(spark, tmp_path):
    for name, data in {
        "a.pdf": b"%PDF-1.7 x", "b.jpg": b"\xff\xd8\xff\xe0", "c.png": b"\x89PNG\r\n\x1a\n", "d.pdf": b"<html>",
        "full.pdf": b"%PDF-" + b"0" * (1024 * 1024 - 5), "large.html": b"0" * (1024 * 1024 + 1),
    }.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.original_filename: (r.file_type, r.status) for r in classify_files(spark, str(tmp_path), max_mb=1).collect()}
    assert rows == {
        "a.pdf": ("pdf", "ok"), "b.jpg": ("image", "ok"), "c.png": ("image", "ok"),
        "d.pdf": (None, "invalid_file_type"), "full.pdf": ("pdf", "ok"), "large.html": (None, "file_too_large"),
    }


def test_publication(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert catalog_readiness(spark, path).first().status == "unavailable"
    publish_catalog(_catalog(spark, [("A", 1.0)]).limit(0), path)
    assert catalog_readiness(spark, path).first().status == "degraded"
    publish_catalog(_catalog(spark, [("A", 1.0), ("B", 1.0)]), path)
    publish_catalog(_catalog(spark, [("Z", 1.0)]), path)
    after = publish_catalog(_catalog(spark, [("B", 2.0), ("C", 3.0)]), path, "upsert")
    assert sorted(tuple(r) for r in after.collect()) == [("A", 1.0), ("B", 2.0), ("C", 3.0)]
    assert catalog_readiness(spark, path).first().collection_size == 3
    # a publication that dies before its number is written changes nothing
    _catalog(spark, [("X", 9.0)]).write.parquet(f"{path}/version-unfinished")
    assert catalog_readiness(spark, path).first().collection_size == 3
    assert publish_catalog(_catalog(spark, [("X", 9.0)]), path).count() == 3


def test_no_upsert_of_several_writers_is_lost(spark, tmp_path):
    path = str(tmp_path / "catalog")
    publish_catalog(_catalog(spark, [("A", 1.0)]), path)

    def write(writer):
        for n in range(3):
            publish_catalog(_catalog(spark, [(f"W{writer}{n}", float(n)), ("A", float(writer))]), path, "upsert")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    rows = read_catalog(spark, path).collect()
    assert sorted(r.code for r in rows) == ["A", *[f"W{w}{n}" for w in range(3) for n in range(3)]]
    assert current_version(spark, path).endswith("version-000000000010")


def test_streams_equal_batch(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    rows = [(n % 3, "99213", start + dt.timedelta(seconds=40 * n)) for n in range(60)]
    rows.append((9, "X", start + dt.timedelta(days=30)))  # closes all earlier windows
    events = spark.createDataFrame(rows, "user_id int, code string, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    cases = {
        "throttle": lambda df, mark: jobs.throttle_audit(df, limit=4, window="10 minutes", watermark=mark),
        "duplicates": lambda df, mark: jobs.stream_duplicates(df, keys=("user_id", "code"), watermark=mark),
    }
    for name, job in cases.items():
        out = str(tmp_path / name)
        jobs.write_windows(job(stream(), "1 minute"), out, out + "-checkpoint").awaitTermination(60)
        expected = sorted(map(tuple, job(events, None).collect()))
        assert expected and sorted(map(tuple, spark.read.parquet(out).collect())) == expected


def test_audit_routes_every_bill(spark):
    codes = spark.createDataFrame([("99213", "Office visit", "Visit")], CODE_TABLE)
    rates = spark.createDataFrame([("99213", 3.05, 100.0)], "code string, total_rvu double, medicare_reference_price double")
    catalog = with_document(build_catalog(codes, rates))
    text = "Patient Name: John Smith\n01/15/2025 99213 Office visit established patient $450.00"
    bills = spark.createDataFrame(
        [(1, text, "pdf"), (2, "too short", "pdf"), (3, text, "gif"), (4, " ", "image")],
        "bill_id int, text string, file_type string",
    )
    lines = spark.createDataFrame(
        [(b, 1, " 99213", "Office visit", 1, 450.0, "01/15/2025") for b in (1, 3)],
        "bill_id int, line_no long, code string, description string, quantity int, billed_amount double, service_date string",
    )
    audit = audit_bills(bills, lines, catalog)
    assert {r.bill_id: r.status for r in audit.bills.collect()} == {
        1: "ok", 2: "bill_too_short", 3: "invalid_file_type", 4: "ocr_failed",
    }
    assert "John" not in audit.bills.where("bill_id = 1").first().redacted_text
    assert [r.code for r in audit.lookups.collect()] == ["99213"]
    letter = audit.letters.first()
    assert letter.anomaly_codes == ["99213"] and "$450.00" in letter.body
    document = audit.documents.select(F.get_json_object("document", "$.bill_summary.anomaly_count")).collect()
    assert [r[0] for r in document] == ["1"]


@pytest.mark.parametrize("name, column", [("customer", "c_custkey"), ("part", "p_partkey"), ("embeddings", "vec_id")])
def test_rows_of_one_file_are_dealt_over_all_cores(spark, tmp_path, name, column):
    spark.range(4000).withColumnRenamed("id", column).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    sizes = tables.table(spark, str(tmp_path), name).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 2000


def test_stored_documents_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_stream_folder", lambda _: str(tmp_path))
    text = '{"anomalies": [], "dispute_letter": null}'
    made = spark.range(2000).select(F.col("id").alias("bill_id"), F.lit(text).alias("document"))
    monkeypatch.setattr(queries, "_documents", lambda *_: made)
    stored = queries._stored_documents(spark, "")
    assert sorted(map(str, stored.collect())) == sorted(map(str, made.collect()))
    assert sum(f.stat().st_size for f in (tmp_path / "documents").iterdir() if f.name.startswith("part")) < 2000 * len(text) / 3
