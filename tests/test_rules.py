import re

import pytest
from pyspark.sql import functions as F

from chargeaudit.operators import lookup, rules, summary
from chargeaudit.operators.catalog import with_document
from chargeaudit.operators.extract import candidate_codes_of_pages
from chargeaudit.operators.numbering import number_rows
from chargeaudit.plans.tables import lettered_code, part_code, supplier_code

LINES = "bill_id int, line_no long, code string, description string, quantity int, billed_amount double, service_date string"


@pytest.fixture(scope="module")
def catalog(spark):
    return with_document(
        spark.createDataFrame(
            [
                ("99213", "Office visit", "Visit", 3.05, 100.0),
                ("J0696", "Drug", "Drug", 0.0, 0.0),
                ("80053", "Panel", "Panel", 1.0, 50.0),
                ("82947", "Glucose", "Glucose", 0.5, 10.0),
            ],
            "code string, long_description string, short_description string, total_rvu double, medicare_reference_price double",
        )
    )


def _lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


@pytest.mark.parametrize(
    "billed, severity",
    [(119.9, None), (120.0, "low"), (149.9, "low"), (150.0, "medium"), (300.0, "medium"), (300.1, "high")],
)
def test_tiers(spark, catalog, billed, severity):
    rows = rules.price_overcharges(_lines(spark, [(1, 1, "99213", "v", 1, billed, None)]), catalog).collect()
    assert [r.severity for r in rows] == ([severity] if severity else [])


def test_no_price_no_amount_no_finding(spark, catalog):
    lines = _lines(spark, [(1, 1, "J0696", "d", 1, 900.0, None), (1, 2, "99213", "v", 1, None, None)])
    assert rules.price_and_code_findings(lines, catalog).count() == 0


def test_per_unit(spark, catalog):
    line = [(1, 1, "99213", "v", 4, 400.0, None)]
    assert rules.price_overcharges(_lines(spark, line), catalog).first().overcharge_ratio == 4.0
    assert rules.price_overcharges(_lines(spark, line), catalog, per_unit=True).count() == 0


def test_duplicates_against_pairs(spark):
    rows = [
        (1, 1, "99213", "v", 1, 1.0, "01/05/2025"),
        (1, 2, "99213", "v", 1, 1.0, "01/05/2025"),
        (1, 3, "99213", "v", 1, 1.0, "2025-01-06"),
        (1, 4, "99213", "v", 1, 1.0, "1/9/2025"),
        (1, 5, "99213", "v", 1, 1.0, "unreadable"),
        (1, 6, "80053", "v", 1, 1.0, "01/06/2025"),
        (2, 1, "99213", "v", 1, 1.0, "01/05/2025"),
        (2, 2, None, "v", 1, 1.0, "01/05/2025"),
        (2, 3, None, "v", 1, 1.0, "01/05/2025"),
    ]
    found = rules.duplicate_charges(_lines(spark, rows)).orderBy("bill_id", "line_no").collect()
    assert [(r.bill_id, r.line_no, r.severity, r.related) for r in found] == [
        (1, 2, "high", "01/05/2025"),
        (1, 3, "medium", "01/05/2025"),
    ]
    assert rules.duplicate_charges(_lines(spark, rows), max_gap_days=3).count() == 3


def test_unbundling(spark):
    lines = _lines(
        spark,
        [
            (1, 1, "80053", "p", 1, 1.0, None),
            (1, 2, "82947", "g", 1, 1.0, None),
            (1, 3, "82947", "g", 1, 1.0, None),
            (2, 1, "82947", "g", 1, 1.0, None),
        ],
    )
    pairs = spark.createDataFrame([("80053", "82947")], "code string, component_code string")
    assert [tuple(r) for r in rules.unbundled_pairs(lines, pairs).collect()] == [(1, "80053", "82947")]
    found = rules.unbundled_lines(lines, pairs).orderBy("line_no").collect()
    assert [(r.line_no, r.related) for r in found] == [(2, "80053"), (3, "80053")]


def test_detection_texts_order_and_summary(spark, catalog):
    lines = _lines(
        spark,
        [
            (1, 1, "82947", "Glucose", 1, 13.0, "01/01/2025"),
            (1, 2, "99213", "Visit", 1, 450.0, "01/15/2025"),
            (1, 3, "ZZZZZ", "Mystery", 1, 20.0, "01/15/2025"),
            (2, 1, None, "ROOM & BOARD", 1, 900.0, None),
            (3, 1, "99213", "Visit", 1, 90.0, "01/15/2025"),
            (3, 2, "99213", "Visit", 1, None, "03/15/2025"),
        ],
    )
    findings = rules.detect_anomalies(lines, catalog)
    rows = rules.number_anomalies(findings).orderBy("bill_id", "anomaly_no").collect()
    assert [(r.bill_id, r.anomaly_no, r.anomaly_type, r.severity) for r in rows] == [
        (1, 1, "price_overcharge", "high"),
        (1, 2, "unknown_code", "medium"),
        (1, 3, "price_overcharge", "low"),
        (2, 1, "unknown_code", "info"),
    ]
    assert rows[0].explanation == (
        "Code 99213 was billed at $450.00, which is 4.5x the Medicare reference rate of $100.00."
    )
    assert "itemized bill" in rows[3].suggested_action
    totals = {r.bill_id: r for r in summary.bill_summary(findings, lines).collect()}
    assert totals[1].anomaly_count == 3 and totals[1].high_severity_count == 1
    assert totals[1].potential_overcharge_total == 353.0
    assert totals[1].total_billed_amount == 483.0
    assert totals[2].potential_overcharge_total is None
    assert (totals[3].anomaly_count, totals[3].total_billed_amount) == (0, None)


def test_overcharge_of_300_at_three(spark):
    finding = spark.createDataFrame(
        [(1, 1, "price_overcharge", "medium", 300.0, 3.0), (2, 1, "upcoding", "high", 300.0, 3.0)],
        "bill_id int, line_no long, anomaly_type string, severity string, billed_amount double, overcharge_ratio double",
    )
    totals = {r.bill_id: r.potential_overcharge_total for r in summary.finding_totals(finding).collect()}
    assert totals == {1: 200.0, 2: None}


@pytest.mark.parametrize(
    "kinds, subject",
    [
        (["duplicate_charge"], "Dispute: Duplicate Charge — Itemized Review Requested"),
        (
            ["unknown_code", "price_overcharge", "price_overcharge"],
            "Dispute: 3 Billing Issues (Possible Overcharge and Others) — Review Requested",
        ),
        (
            ["unknown_code", "upcoding"],
            "Dispute: 2 Billing Issues (Unknown Charge Code and Others) — Review Requested",
        ),
    ],
)
def test_subject(spark, kinds, subject):
    rows = [(1, n, kind, "medium") for n, kind in enumerate(kinds)]
    findings = spark.createDataFrame(rows, "bill_id int, line_no long, anomaly_type string, severity string")
    assert summary.subject_lines(findings).first().subject_line == subject


def test_lookup(spark, catalog):
    codes = spark.createDataFrame([(1, " 99213 "), (1, "j0696"), (1, "00000"), (1, " ")], "bill_id int, code string")
    found = {r.code: r.found for r in lookup.lookup_codes(codes, catalog).collect()}
    assert found == {"99213": True, "J0696": True, "00000": False, None: False}
    assert [r.code for r in lookup.unknown_codes(codes, catalog).collect()] == ["00000"]
    row = lookup.lookup_coverage(codes, catalog).first()
    assert (row.n_codes, row.n_found, row.n_unknown) == (3, 2, 1)


def test_hot_key_numbering_equals_the_plain_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("bill_id"),
        (F.col("id") * 7919 % 5000).alias("place"),
    )
    plain = number_rows(df, "bill_id", ["place"], "n")
    hot = number_rows(df, "bill_id", ["place"], "n", hot_rows=500)
    assert hot.exceptAll(plain).count() == 0 and plain.exceptAll(hot).count() == 0


def test_codes_of_keys_are_lossless(spark):
    keys = [1, 9_999, 10_000, 10_001, 99_999, 100_000, 100_001, 1_223_055, 1_313_055, 1_313_056, 9_000_000]
    column = F.col("key")
    made = spark.createDataFrame([(key,) for key in keys], "key long").select(
        "key", part_code(column).alias("part"), F.when(column < 1_223_056, supplier_code(column)).alias("supplier")
    )
    rows = {r.key: (r.part, r.supplier) for r in made.collect()}
    assert rows[9_999] == ("09999", "J9999") and rows[10_000] == ("10000", "JA000")
    assert rows[1_223_055][1] == "JZZZZ" and rows[100_000][0] == "0A000" and rows[1_313_056][0] == "1A000"
    codes = [code for pair in rows.values() for code in pair if code]
    assert len(set(codes)) == len(codes) and all(re.fullmatch("[A-Z0-9]{5}", code) for code in codes)


def test_codes_of_equal_rows_have_one_order(spark):
    codes = [f"{n * 7919 % 90_000 + 10_000}" for n in range(30)]
    rows = spark.createDataFrame([(1, 5, "99999"), *[(1, 7, code) for code in codes]], "bill_id long, line_no long, text string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        for limit in (None, 12):
            found = {r.position: r.code for r in candidate_codes_of_pages(rows, ["line_no"], limit=limit).collect()}
            assert [found[n + 1] for n in range(len(found))] == ["99999", *sorted(codes)][:limit]
    finally:
        spark.conf.set(coalesce, "true")


def test_unknown_codes_have_no_last_key(spark):
    keys = [0, 9_999, 10_000, 1_223_055, 1_223_056, 7_199_999, 44_893_071, 44_893_072, 3_000_000_000]
    made = spark.createDataFrame([(key,) for key in keys], "key long").select("key", lettered_code("X", F.col("key")).alias("code"))
    codes = {r.key: r.code for r in made.collect()}
    assert codes[9_999] == "X9999" and codes[10_000] == "XA000" and codes[1_223_055] == "XZZZZ"
    assert codes[1_223_056] == "XA0000" and codes[44_893_071] == "XZZZZZ" and codes[44_893_072] == "XA00000"
    assert len(set(codes.values())) == len(keys)
    # The catalog has no room for a sixth sign: such a supplier's code would be dropped from it.
    beyond = spark.createDataFrame([(1_223_056,)], "key long").select(supplier_code(F.col("key")))
    with pytest.raises(Exception, match="beyond the range"):
        beyond.collect()


def test_quantity_of_zero_is_not_judged_per_unit(spark):
    lines = spark.createDataFrame(
        [(1, 1, "99213", "Visit", 0, 500.0, "01/02/2024")],
        "bill_id int, line_no int, code string, description string, quantity long, "
        "billed_amount double, service_date string",
    )
    prices = spark.createDataFrame(
        [("99213", 100.0, True)], "code string, medicare_reference_price double, has_price_data boolean"
    )
    assert rules.price_and_code_findings(lines, prices, per_unit=True).count() == 0
