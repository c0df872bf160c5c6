import re

import pytest
from pyspark.sql import functions as F

from chargeaudit.functions.patterns import GUARDS, PROFILES, spark_regex
from chargeaudit.operators.redact import leak_gate, publish_redacted, redact, redaction_audit, with_gate
from chargeaudit.plans.oracle import STRICT_SSN_RANGES

MUST = [
    ("SSN: 123-45-6789", "SSN"),
    ("social security number 123 45 6789", "SSN"),
    ("id 123-45-6789 on file", "SSN"),
    ("Medicare ID: 1EG4-TE5-MK72", "MEDICARE_ID"),
    ("Member ID: ABC123456789", "MEMBER_ID"),
    ("Policy #: XYZ987654", "MEMBER_ID"),
    ("DOB: 01/15/1980", "DOB"),
    ("Date of Birth: January 15, 1980", "DOB"),
    ("Call (555) 123-4567 now", "PHONE"),
    ("Call 555.123.4567 now", "PHONE"),
    ("write to jane.doe@example.com today", "EMAIL"),
    ("card 4111 1111 1111 1111 used", "CARD_NUMBER"),
    ("from 192.168.10.1 today", "IP_ADDRESS"),
    ("Patient Name: John Smith", "NAME"),
    ("patient: MARY ANN JONES", "NAME"),
    ("lives at 123 Main Street", "ADDRESS"),
]
MUST_NOT = [
    "CPT code 99213 office visit",
    "Amount due: $450.00",
    "Date of service: 01/15/2025",
    "Provider: Dr. House, General Hospital",
    "Diagnosis: J45.909 asthma",
    "Total charges 1,234.56",
    "",
    "   \n\t ",
]


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def _by_hand(text, profile):
    """The patterns run one after the other in Python."""
    counts = {}
    if not text.strip():
        return ("" if profile == "strict" else text), counts
    for p in PROFILES[profile]:
        regex = re.compile(p.regex, re.IGNORECASE if p.ignore_case else 0)
        text, n = regex.subn(p.token.replace("$1", r"\1"), text)
        if n:
            counts[p.label] = counts.get(p.label, 0) + n
    return text, counts


def test_labels(spark):
    rows = redact(_texts(spark, [text for text, _ in MUST])).orderBy("id").collect()
    for row, (text, label) in zip(rows, MUST):
        assert row.audit == {label: 1}, text
        assert f"[{label}]" in row.redacted_text
        assert row.n_total == 1


def test_clean_texts_stay(spark):
    rows = redact(_texts(spark, MUST_NOT)).orderBy("id").collect()
    assert [row.redacted_text for row in rows] == MUST_NOT
    assert all(row.n_total == 0 and row.audit == {} for row in rows)


ODD = [
    "tel 555-123-4567, 555-123-4567 and 1.2.3.4",
    "é123-45-6789 and x123-45-6789é, 123-45-6789",
    "ſsn 123-45-6789",
    "SSN 123-45-6789",
    "٣٢١-٤٥-٦٧٨٩ digits of another script",
    "Patient\nBilling Statement\nPatient Name: Ann Lee\n70450 Head CT",
    "medicare covers this. Medicare no. 1EG4 TE5 MK72",
    "378282246310005 and 3782-822463-10005 and 4111111111111111",
    "first.last+tag@sub.example.co.uk; @nobody; a@b",
    "½123-45-6789 ²10.0.0.1",
    "MRN: AB-1234, policy number: 12-345678, 12345-6789, 03/04/1999, March 4, 1999",
    "6666-66-6666 666-12-3456 000-12-3456 900-12-3456 123-00-4567 123-45-0000 555 123 4567",
]


@pytest.mark.parametrize("profile", ["parity", "strict"])
def test_same_as_plain_regex(spark, profile):
    texts = [t for t, _ in MUST] + MUST_NOT + ODD + ["\n".join(ODD)]
    rows = redact(_texts(spark, texts), profile=profile).orderBy("id").collect()
    for row, text in zip(rows, texts):
        assert (row.redacted_text, row.audit) == _by_hand(text, profile), text


@pytest.mark.parametrize("profile", sorted(PROFILES))
def test_guards_lose_nothing(spark, profile):
    assert len(GUARDS[profile]) == len(PROFILES[profile])
    texts = _texts(spark, [t for t, _ in MUST] + MUST_NOT + ODD)
    patterns = PROFILES[profile][:3] if profile == "strict" else PROFILES[profile]
    plain = F.lit(False)
    for p in patterns:
        plain = plain | F.col("text").rlike(spark_regex(p.regex, p.ignore_case))
    assert with_gate(texts, "text", profile).where(F.col("is_safe") == plain).count() == 0


def test_safe_profile_mends_the_known_misses(spark):
    texts = [
        "PATIENT BILLING STATEMENT\nPatient Name: John Smith",
        "70450 Head ct scan",
        "Medicare covers that",
        "card 3782 822463 10005",
    ]
    rows = [r.redacted_text for r in redact(_texts(spark, texts), profile="safe").orderBy("id").collect()]
    assert rows[0] == "PATIENT BILLING STATEMENT\n[NAME]"
    assert rows[1:3] == texts[1:3]
    assert rows[3] == "card [CARD_NUMBER]"


def test_gate_and_publication(spark, tmp_path):
    df = _texts(spark, ["SSN: 123-45-6789", "all clear"])
    safe, held = leak_gate(df, "text")
    assert [r.id for r in safe.collect()] == [1]
    assert [r.id for r in held.collect()] == [0]
    held = publish_redacted(df, str(tmp_path / "out"))
    published = spark.read.parquet(str(tmp_path / "out"))
    assert held.count() == 0
    assert "text" not in published.columns
    assert {r.redacted_text for r in published.collect()} == {"[SSN]", "all clear"}


def test_audit_totals(spark):
    df = _texts(spark, ["a@b.com c@d.org", "a@b.com", "none"])
    totals = {r.label: (r.n_matches, r.n_texts) for r in redaction_audit(redact(df)).collect()}
    assert totals["EMAIL"] == (3, 2)
    assert totals["SSN"] == (0, 0)


def test_strict_numbers_and_their_ranges_agree():
    published, ranges = re.compile(PROFILES["strict"][0].regex), re.compile(STRICT_SSN_RANGES)
    for area in range(1000):
        for group in (0, 1, 9, 10, 50, 99):
            for serial in (0, 1, 10, 100, 1000, 9999):
                for sep in ("", "-", " "):
                    text = f"{area:03}{sep}{group:02}{sep}{serial:04}"
                    assert bool(published.search(text)) == bool(ranges.search(text)), text
