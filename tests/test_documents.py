"""Response documents, exact rounding, column choice and the approximate vector index."""

import json
import random
import time
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import fixed, round_exact, usd
from chargeaudit.operators.catalog import resolve_column, resolve_columns
from chargeaudit.operators.densesearch import search_probed
from chargeaudit.operators.report import check_documents, document_rows, letter_citations, letters, to_documents
from chargeaudit.operators.rules import with_explanations
from chargeaudit.operators.summary import bill_summary
from chargeaudit.operators.similarity import search_similar


def test_amounts_are_rounded_as_in_python(spark):
    rng = random.Random(1)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 0.285, 1234567.895, 1e-9, 99999.995, 4503599627370.495, 0.0]
    values += [rng.randrange(10**6) / 1000 for _ in range(1500)] + [rng.randrange(10**7) / 8 for _ in range(300)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(800)] + [rng.randrange(-(10**5), 10**5) + 0.005 for _ in range(500)]
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for r in df.select("x", fixed(x, 2).alias("two"), fixed(x, 1).alias("one"), round_exact(x, 2).alias("round"), usd(x).alias("usd")).collect():
        if r.x is None:
            assert (r.two, r.round, r.usd) == (None, None, "N/A")
            continue
        assert float(r.two) == float(f"{r.x:.2f}") and float(r.one) == float(f"{r.x:.1f}") and r.round == round(r.x, 2)
        cents = abs(Decimal(r.x).quantize(Decimal("0.01"), ROUND_HALF_UP))
        assert r.usd == f"{'-' if r.x < 0 else ''}${cents:,.2f}"


def test_columns_are_chosen_by_rank_then_place(spark):
    frame = lambda names: spark.createDataFrame([tuple("x" * len(names))], ", ".join(f"`{n}` string" for n in names))
    assert resolve_column(frame(["my_code", "hcpc"]), ["hcpc", "code"]) == "hcpc"
    assert resolve_column(frame(["b_hcpc", "a_hcpc"]), ["hcpc"]) == "b_hcpc"
    raw = frame(["hcpcs", "work_rvu", "rvu", "non_fac_pe_rvu", "mp_rvu", "rvu.1"])
    chosen = raw.select(*[col.alias(name) for name, col in resolve_columns(raw, c.RATE_COLUMNS).items()])
    assert chosen.columns == ["code", "work_rvu", "pe_rvu", "mp_rvu"]
    assert resolve_column(raw, c.RATE_COLUMNS["work_rvu"][1], c.RATE_COLUMNS["work_rvu"][0]) == "rvu"
    assert resolve_column(raw, c.RATE_COLUMNS["mp_rvu"][1], c.RATE_COLUMNS["mp_rvu"][0]) == "rvu.1"
    with pytest.raises(KeyError, match="liability"):
        resolve_column(raw, ["liability"])


def _document():
    line = {"code": "99213", "description": "visit", "quantity": 1, "billed_amount": 10.5, "service_date": None}
    finding = {
        "anomaly_no": 1, "line_item": line, "anomaly_type": "upcoding", "severity": "low", "explanation": "e",
        "medicare_reference_price": None, "overcharge_ratio": 2, "suggested_action": "a",
    }
    summary = {
        "total_line_items": 3, "total_billed_amount": None, "anomaly_count": 2, "high_severity_count": 0,
        "medium_severity_count": 0, "potential_overcharge_total": None,
    }
    letter = {"subject_line": "s", "body": "b", "anomaly_codes": ["99213"]}
    return {"anomalies": [finding, {**finding, "anomaly_no": 2}], "dispute_letter": letter, "bill_summary": summary}


def test_documents_are_checked_and_flattened(spark):
    def changed(change):
        document = _document()
        change(document)
        return json.dumps(document)

    cases = {
        "": lambda d: None,
        "unknown extra": lambda d: d.update(extra=1),
        "bill_summary": lambda d: d.pop("bill_summary"),
        "anomalies.severity": lambda d: d["anomalies"][1].update(severity=5),
        "line_item.quantity": lambda d: d["anomalies"][0]["line_item"].update(quantity="1"),
        "unknown line_item.more": lambda d: d["anomalies"][0]["line_item"].update(more=None),
        "anomalies.anomaly_no": lambda d: d["anomalies"][1].update(anomaly_no=3),
        "dispute_letter.body": lambda d: d["dispute_letter"].pop("body"),
        "bill_summary.anomaly_count": lambda d: d["bill_summary"].update(anomaly_count=1.5),
    }
    rows = [(name, changed(change)) for name, change in cases.items()] + [("document", "[1]"), ("document", "{"), ("document", None)]
    documents = spark.createDataFrame(rows, "name string, document string")
    for r in check_documents(documents).collect():
        expected = [r.name] if r.name else []
        if r.name == "bill_summary":  # and so nothing of it is there
            assert r.violations[0] == "bill_summary" and all(v.startswith("bill_summary") for v in r.violations)
        else:
            assert r.violations == expected
    found = document_rows(documents).orderBy("anomaly_no").collect()
    assert [(r.name, r.anomaly_no, r.code, r.billed_amount, r.overcharge_ratio, r.anomaly_count) for r in found] == [
        ("", 1, "99213", 10.5, 2.0, 2), ("", 2, "99213", 10.5, 2.0, 2),
    ]
    clean = json.dumps({**_document(), "anomalies": [], "dispute_letter": None})
    empty = spark.createDataFrame([("x", clean)], "name string, document string")
    assert check_documents(empty).first().violations == [] and document_rows(empty).count() == 0


def test_documents_that_read_back_are_sound_and_parsed_once(spark):
    def written(change):
        document = _document()
        change(document)
        return json.dumps(document, separators=(",", ":"))

    def finding(n, **fields):
        return lambda d: d["anomalies"][n].update(fields)

    cases = {
        "": lambda d: None,
        "anomalies.explanation": finding(0, explanation=None),
        "anomalies.line_item": finding(1, line_item=None),
        "anomalies.anomaly_no": finding(1, anomaly_no=7),
        "anomalies.overcharge_ratio": finding(0, overcharge_ratio="NaN"),
        "anomalies.medicare_reference_price": finding(1, medicare_reference_price="-Infinity"),
        "anomalies": lambda d: d.update(anomalies=None),
        "dispute_letter.body": lambda d: d["dispute_letter"].update(body=None),
        "dispute_letter.anomaly_codes": lambda d: d["dispute_letter"].update(anomaly_codes=None),
        "bill_summary.anomaly_count": lambda d: d["bill_summary"].update(anomaly_count=None),
        "unknown bill_summary.x": lambda d: d["bill_summary"].update(x=None),
    }
    rows = [(name, written(change)) for name, change in cases.items()]
    whole = written(lambda d: None)
    rows += [("", json.dumps(_document(), indent=1)), ("document", whole[:-1]), ("document", whole.replace('"b"', '"b","body":"b"'))]
    rows.append(("anomalies.anomaly_no", whole.replace('"anomalies":[', '"anomalies":[null,')))
    documents = spark.createDataFrame(rows, "name string, document string")
    for r in check_documents(documents).collect():
        assert r.violations[:1] == ([r.name] if r.name else [])
    assert sorted((r.name, r.anomaly_no) for r in document_rows(documents).collect()) == [("", 1), ("", 1), ("", 2), ("", 2)]
    plan = document_rows(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_letters_bring_their_findings_to_the_documents(spark):
    rng = random.Random(5)
    kinds = ["price_overcharge", "unknown_code", "duplicate_charge", "unbundling"]
    rows = [
        (rng.randrange(9), n, rng.choice(["99213", " a1 ", None, ""]), rng.choice(["visit", None]), 1, rng.choice([10.5, None]), rng.choice(["01/02/2024", None]),
         rng.choice(kinds), rng.choice(["high", "medium", "low", "info", None]), 2.0, 3.5, rng.choice(["x", None]))
        for n in range(300)
    ]
    bare = spark.createDataFrame(
        rows,
        "bill_id long, line_no long, code string, description string, quantity long, billed_amount double, service_date string, "
        "anomaly_type string, severity string, medicare_reference_price double, overcharge_ratio double, related string",
    )
    findings = with_explanations(bare)
    lines = findings.select("bill_id", "billed_amount").unionByName(spark.createDataFrame([(99, 1.0)], "bill_id long, billed_amount double"))
    summary = bill_summary(findings, lines)
    plain, kept = (letters(findings, per_part=7, keep_findings=keep) for keep in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, kept.drop("anomalies").collect()))
    matched, brought = (to_documents(findings, summary, rows, per_part=7) for rows in (plain, kept))
    assert brought.count() > 40 and sorted(map(str, matched.collect())) == sorted(map(str, brought.collect()))
    # Numbered once, and not shuffled again to meet.
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (matched, brought)]
    assert [plan.count("row_number()") for plan in plans] == [2, 1]
    # Words follow from the other columns: they are made when the findings are numbered.
    late = letters(bare, per_part=7, keep_findings=True)
    assert sorted(map(str, to_documents(bare, summary, late, per_part=7).collect())) == sorted(map(str, brought.collect()))


def _frame(spark, key, vectors):
    rows = pd.DataFrame({key: [f"c{n:05d}" for n in range(len(vectors))], "embedding": list(vectors)})
    return spark.createDataFrame(rows, f"{key} string, embedding array<double>")


def test_probed_search_reaches_its_recall_with_few_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24)) * 3
    codes = centres[rng.integers(0, 40, 2_000)] + rng.normal(size=(2_000, 24))
    codes[:300] = codes[0]
    queries = centres[rng.integers(0, 40, 150)] + rng.normal(size=(150, 24))
    asked, known = _frame(spark, "query_id", np.vstack([queries, np.zeros((1, 24))])), _frame(spark, "code", codes)
    probed = search_probed(asked, known, k=5, target=0.95, block_rows=64)
    report = probed.report.first()
    true = {(r.query_id, r.code) for r in search_similar(asked, known, k=5).collect()}
    found = {(r.query_id, r.code) for r in probed.matches.collect()}
    assert len(true & found) >= 0.9 * len(true) and len(found) <= 5 * 150
    assert report.sample_recall >= 0.95 and report.compared_pairs < 0.35 * 150 * 2_000
    none = search_probed(asked, known.where("false"))
    assert none.matches.count() == 0 and none.report.first().compared_pairs == 0


def test_citations_are_whole_words_and_found_by_leaps(spark):
    rows = [
        (1, 1, "A12, xA12 A12x A12-A12 A1", ["A12", "A1", "A-1", "A"]),
        (2, 1, "-A A.B A. é1 xé1 AAA AA", ["-A", "A.", "é1", "AA"]),
        (3, 1, "word " * 40_000 + "Z9999", [f"Z{n}" for n in range(9_800, 10_000)]),
    ]
    letters = spark.createDataFrame(rows, "bill_id long, part_no int, body string, anomaly_codes array<string>")
    plain = F.concat(F.lit(r"\b\Q"), F.col("code"), F.lit(r"\E\b"))
    expected = letters.select("bill_id", "part_no", "body", F.explode("anomaly_codes").alias("code")).select(
        "bill_id", "part_no", "code", F.regexp_count("body", plain).cast("bigint"), F.regexp_instr("body", plain).cast("bigint")
    )

    def timed(df):
        start = time.perf_counter()
        return sorted(map(tuple, df.collect())), time.perf_counter() - start

    ours = letter_citations(letters)
    (found, first), (wanted, _) = timed(ours), timed(expected)
    assert found == wanted and {(r[2], r[3], r[4]) for r in found} >= {("A12", 3, 1), ("Z9999", 1, 200_001)}
    assert min(first, *(timed(ours)[1] for _ in range(2))) < 0.6 * min(timed(expected)[1] for _ in range(2))
