"""The registered queries: every operator over the driver's whole tables.

Results are flat: long texts appear as length and MD5, numbers of unlimited
precision are cut to four decimals, whole numbers are 64-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chargeaudit.functions.text import label, ratio_text, usd
from chargeaudit.functions.vectors import norm
from chargeaudit.operators import catalog as cat
from chargeaudit.operators import checks, densesearch, extract, lookup, report, rules, similarity, summary, textsearch
from chargeaudit.operators.redact import publish_redacted, redact, redaction_audit, with_gate
from chargeaudit.plans import tables as t
from chargeaudit.plans.audit import route_bills
from chargeaudit.session import ensure_checkpoint_dir, materialise
from chargeaudit.sources.files import classify_files, read_below_preamble, read_strings
from chargeaudit.sources.tables import readiness
from chargeaudit.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _ratio4(col: Column) -> Column:
    return F.floor(col * 10000.0 + 0.5).cast("double") / 10000.0


def _digest(col: str, name: str) -> list[Column]:
    return [F.length(col).cast("bigint").alias("n_chars"), F.md5(col).alias(name)]


def _flat(df: DataFrame) -> DataFrame:
    """Whole numbers as 64-bit, dates as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint").alias(field.name)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _findings(spark: SparkSession, sf_dir: str, worded: bool = True) -> DataFrame:
    return rules.detect_anomalies(
        t.charge_lines(spark, sf_dir),
        t.published_catalog(spark, sf_dir),
        t.bundling_pairs(spark, sf_dir),
        per_unit=True,
        worded=worded,
    )


def _bill_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bill_id"))


# --- catalog ---------------------------------------------------------------


@query
def clean_codes(spark, sf_dir):
    return t.clean_code_table(spark, sf_dir)


@query
def compute_rates(spark, sf_dir):
    return t.rate_table(spark, sf_dir)


@query
def catalog_build(spark, sf_dir):
    return t.catalog(spark, sf_dir)


@query
def catalog_stats(spark, sf_dir):
    return cat.catalog_stats(t.catalog(spark, sf_dir))


@query
def catalog_readiness(spark, sf_dir):
    return readiness(t.catalog(spark, sf_dir))


@query
def load_report(spark, sf_dir):
    return cat.load_report(
        {
            "codes": t.clean_code_table(spark, sf_dir),
            "rates": t.rate_table(spark, sf_dir),
            "catalog": t.catalog(spark, sf_dir),
        }
    )


@query
def catalog_upsert(spark, sf_dir):
    """Suppliers' codes get a price, customers are new codes."""
    columns = ["code", "short_description", "medicare_reference_price"]
    suppliers = t.table(spark, sf_dir, "supplier").select(
        t.supplier_code(F.col("s_suppkey")).alias("code"),
        F.col("s_name").alias("short_description"),
        F.col("s_acctbal").alias("medicare_reference_price"),
        F.col("s_suppkey").alias("row_no"),
    )
    customers = t.table(spark, sf_dir, "customer").select(
        t.lettered_code("C", F.col("c_custkey")).alias("code"),
        F.col("c_name").alias("short_description"),
        F.col("c_acctbal").alias("medicare_reference_price"),
        F.col("c_custkey").alias("row_no"),
    )
    new = cat.first_per_key(suppliers.unionByName(customers), ["code"], ["row_no"]).select(*columns)
    return cat.upsert(t.catalog(spark, sf_dir).select(*columns), new)


def _quoted(*names: str) -> Column:
    """One CSV record; nulls are empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for n in names])


def _write_csv(df: DataFrame, path: str, above: list[str]) -> None:
    """The columns as CSV files of quoted fields, each file with the lines ``above`` and a header."""
    top = "\n".join([*above, ",".join(df.columns)])

    def with_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [top]})
        yield from batches

    df.select(_quoted(*df.columns).alias("value")).mapInPandas(with_top, "value string").write.text(path)


@query
def catalog_from_files(spark, sf_dir):
    """``catalog_build`` from raw files: titles above the header, line breaks inside of fields."""
    folder = _stream_folder(spark)
    broken = F.concat(F.lit(" \n"), F.col("long_description"), F.lit(" \r\n\t"))
    _write_csv(t.raw_codes(spark, sf_dir).withColumn("long_description", broken), f"{folder}/codes", [])
    rates = t.raw_rates(spark, sf_dir).withColumn("mod", F.lit("a,\n\"b\"\n"))
    _write_csv(rates.select("hcpcs", "mod", "work_rvu", "fac_pe_rvu", "mp_rvu", "row_no"), f"{folder}/rates", ["Rates", "", "as of today"])
    codes = read_strings(spark, f"{folder}/codes")
    order = [F.col(name).cast("bigint").alias(name) for name in ("file_no", "row_no")]
    cleaned = cat.clean_codes(codes.select("hcpc", "long_description", "short_description", *order), ["file_no", "row_no"])
    raw = read_below_preamble(spark, f"{folder}/rates").withColumn("row_no", F.col("row_no").cast("bigint"))
    return cat.with_document(cat.build_catalog(cleaned, cat.compute_rates(raw, ["row_no"])))


@query
def stored_documents(spark, sf_dir):
    return cat.from_documents(t.catalog(spark, sf_dir).drop("long_description"))


# --- lookup ----------------------------------------------------------------


@query
def exact_lookup(spark, sf_dir):
    return lookup.lookup_codes(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir)).select(
        "bill_id", "line_no", "code", "found", "long_description", "medicare_reference_price", "has_price_data"
    )


@query
def unknown_codes(spark, sf_dir):
    return lookup.unknown_codes(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir))


@query
def lookup_coverage(spark, sf_dir):
    return lookup.lookup_coverage(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir))


# --- rules -----------------------------------------------------------------


@query
def overcharge_summary(spark, sf_dir):
    """Flagship: overcharged lines of every bill, by tier, with the excess."""
    findings = rules.price_overcharges(
        t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir), per_unit=True
    )
    return summary.overcharge_summary(findings)


def _price_columns(findings: DataFrame) -> DataFrame:
    return findings.select(
        "bill_id",
        "line_no",
        "code",
        "severity",
        "medicare_reference_price",
        _ratio4(F.col("overcharge_ratio")).alias("overcharge_ratio"),
    )


@query
def price_overcharge(spark, sf_dir):
    return _price_columns(
        rules.price_overcharges(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir), per_unit=True)
    )


@query
def price_overcharge_line(spark, sf_dir):
    return _price_columns(
        rules.price_overcharges(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir))
    )


@query
def unknown_code_lines(spark, sf_dir):
    return rules.unknown_code_lines(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir)).select(
        "bill_id", "line_no", "code", "anomaly_type", "severity"
    )


@query
def duplicate_charge(spark, sf_dir):
    return rules.duplicate_charges(t.patient_lines(spark, sf_dir), keys=("patient_id", "code")).select(
        "bill_id", "line_no", "code", "service_date", "severity", "related"
    )


@query
def neighbour_days(spark, sf_dir):
    return _flat(rules.neighbour_days(t.patient_lines(spark, sf_dir), keys=("patient_id", "code")))


@query
def unbundled_pairs(spark, sf_dir):
    return rules.unbundled_pairs(t.charge_lines(spark, sf_dir), t.bundling_pairs(spark, sf_dir))


@query
def unbundled_lines(spark, sf_dir):
    return rules.unbundled_lines(t.charge_lines(spark, sf_dir), t.bundling_pairs(spark, sf_dir)).select(
        "bill_id", "line_no", "code", "related"
    )


@query
def summary_bill_info(spark, sf_dir):
    return rules.summary_bill_lines(t.charge_lines(spark, sf_dir)).select(
        "bill_id", "line_no", "anomaly_type", "severity"
    )


@query
def detect_anomalies(spark, sf_dir):
    numbered = rules.number_anomalies(_findings(spark, sf_dir), _bill_sizes(spark, sf_dir))
    return _flat(
        numbered.withColumn("overcharge_ratio", _ratio4(F.col("overcharge_ratio"))).drop(
            "severity_rank", "type_rank"
        )
    )


@query
def all_findings(spark, sf_dir):
    """Findings of all five kinds on monthly statements, the similarity rules by words included."""
    lines = materialise(t.statement_lines(spark, sf_dir))
    catalog = t.published_catalog(spark, sf_dir)
    facts = textsearch.text_facts(lines, catalog, t.TEXT_MARGIN, t.TEXT_BAR)
    findings = rules.detect_anomalies(
        lines, catalog, t.bundling_pairs(spark, sf_dir), per_unit=True, fits=facts.fits, close=facts.close
    )
    return _flat(
        findings.withColumn("overcharge_ratio", _ratio4(F.col("overcharge_ratio"))).drop("explanation", "suggested_action")
    )


# --- summaries and reports -------------------------------------------------


@query
def bill_summary(spark, sf_dir):
    return summary.bill_summary(_findings(spark, sf_dir), t.charge_lines(spark, sf_dir))


@query
def dominant_type(spark, sf_dir):
    return summary.dominant_type(_findings(spark, sf_dir))


@query
def subject_line(spark, sf_dir):
    return summary.subject_lines(_findings(spark, sf_dir)).select("bill_id", "subject_line")


@query
def anomaly_codes(spark, sf_dir):
    return _flat(summary.anomaly_codes(_findings(spark, sf_dir), _bill_sizes(spark, sf_dir)))


@query
def anomaly_labels(spark, sf_dir):
    numbered = rules.number_anomalies(_findings(spark, sf_dir), _bill_sizes(spark, sf_dir))
    return _flat(
        numbered.select(
            "bill_id",
            "anomaly_no",
            label(F.col("anomaly_type")).alias("type_label"),
            label(F.col("severity")).alias("severity_label"),
            usd(F.col("billed_amount")).alias("billed_text"),
            ratio_text(F.col("overcharge_ratio")).alias("ratio_text"),
        )
    )


@query
def findings_brief(spark, sf_dir):
    findings = materialise(_findings(spark, sf_dir))
    totals = summary.bill_summary(findings, t.charge_lines(spark, sf_dir))
    briefs = report.findings_brief(findings, totals, sizes=_bill_sizes(spark, sf_dir))
    return _flat(briefs.select("bill_id", "part_no", *_digest("brief", "brief_md5")))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = materialise(_findings(spark, sf_dir, worded=False))
    return report.letters(findings, sizes=_bill_sizes(spark, sf_dir))


@query
def letter_body(spark, sf_dir):
    return _flat(
        _letters(spark, sf_dir).select("bill_id", "part_no", "subject_line", *_digest("body", "body_md5"))
    )


@query
def letter_citations(spark, sf_dir):
    return _flat(report.letter_citations(_letters(spark, sf_dir)))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = materialise(_findings(spark, sf_dir, worded=False))
    sizes = _bill_sizes(spark, sf_dir)
    return report.to_documents(
        findings,
        summary.bill_summary(findings, t.charge_lines(spark, sf_dir)),
        report.letters(findings, sizes=sizes, keep_findings=True),
        sizes=sizes,
    )


@query
def response_documents(spark, sf_dir):
    return _flat(_documents(spark, sf_dir))


def _stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as packed JSON, one a line, and read back."""
    folder = _stream_folder(spark)
    keyed = _documents(spark, sf_dir)
    keyed.write.json(f"{folder}/documents", compression="gzip")
    return spark.read.schema(keyed.schema).json(f"{folder}/documents")


@query
def response_rows(spark, sf_dir):
    """The findings out of the stored documents."""
    rows = report.document_rows(_stored_documents(spark, sf_dir))
    return _flat(
        rows.withColumn("overcharge_ratio", _ratio4(F.col("overcharge_ratio")))
        .withColumn("words_md5", F.md5(F.concat("explanation", "suggested_action")))
        .drop("explanation", "suggested_action")
    )


@query
def response_checks(spark, sf_dir):
    """Stored documents by what breaks their schema."""
    checked = report.check_documents(_stored_documents(spark, sf_dir))
    return checked.groupBy(F.array_join("violations", "; ").alias("violations")).agg(F.count("*").alias("n_documents"))


# --- text ------------------------------------------------------------------

_TEXT_KEY = ("source", "text_id", "turn")


@query
def redact_text(spark, sf_dir):
    return redact(t.texts(spark, sf_dir)).select(
        *_TEXT_KEY, "n_total", *_digest("redacted_text", "text_md5")
    )


@query
def redact_text_strict(spark, sf_dir):
    return redact(t.texts(spark, sf_dir), profile="strict").select(
        *_TEXT_KEY, "n_total", *_digest("redacted_text", "text_md5")
    )


@query
def redact_audit(spark, sf_dir):
    return redaction_audit(redact(t.texts(spark, sf_dir)))


@query
def form_texts(spark, sf_dir):
    return redact(t.intake_forms(spark, sf_dir)).select("text_id", "n_total", *_digest("redacted_text", "text_md5"))


@query
def form_audit(spark, sf_dir):
    return redaction_audit(redact(t.intake_forms(spark, sf_dir)))


@query
def form_audit_strict(spark, sf_dir):
    return redaction_audit(redact(t.intake_forms(spark, sf_dir), profile="strict"), "strict")


@query
def bill_routes(spark, sf_dir):
    """How far every upload comes, and what reaches the next step."""
    routed = route_bills(t.uploaded_bills(spark, sf_dir))
    return _flat(routed.select("bill_id", "file_type", "char_count", "n_redactions", "status", F.md5("redacted_text").alias("text_md5")))


@query
def gated_bills(spark, sf_dir):
    """The same for texts that come as redacted: raw ones don't pass."""
    bills = t.uploaded_bills(spark, sf_dir).drop("n_bytes")
    sent = redact(bills).withColumn("text", F.when(F.col("bill_id") % 3 == 0, F.col("text")).otherwise(F.col("redacted_text")))
    routed = route_bills(sent.select("bill_id", "text", "file_type"), redacted=True)
    return _flat(routed.select("bill_id", "char_count", "n_redactions", "status", F.md5("redacted_text").alias("text_md5")))


@query
def published_texts(spark, sf_dir):
    """What is written for others to read, and what is held back."""
    folder = _stream_folder(spark)
    forms = t.intake_forms(spark, sf_dir).unionByName(t.texts(spark, sf_dir).where("source = 'documents'"))
    held = publish_redacted(forms, f"{folder}/published")
    published = spark.read.parquet(f"{folder}/published")
    rows = [
        df.select(F.lit(name).alias("sink"), "source", "text_id", "n_total", F.md5("redacted_text").alias("text_md5"))
        for name, df in (("published", published), ("held", held))
    ]
    return _flat(rows[0].unionByName(rows[1]))


@query
def leak_gate(spark, sf_dir):
    raw = with_gate(t.texts(spark, sf_dir), "text").withColumnRenamed("is_safe", "raw_is_safe")
    return with_gate(redact(raw), "redacted_text").select(
        *_TEXT_KEY, "raw_is_safe", F.col("is_safe").alias("redacted_is_safe")
    )


@query
def candidate_codes(spark, sf_dir):
    lines = t.charge_lines(spark, sf_dir).withColumn("text", t.line_text())
    return _flat(extract.candidate_codes_of_pages(lines, ["line_no"]))


@query
def first_codes(spark, sf_dir):
    """The first three codes of every bill."""
    lines = t.charge_lines(spark, sf_dir).withColumn("text", t.line_text())
    return _flat(extract.candidate_codes_of_pages(lines, ["line_no"], limit=3))


def _bill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.bill_texts(t.charge_lines(spark, sf_dir), ["line_no"], t.line_text())


@query
def review_context(spark, sf_dir):
    bills = _bill_texts(spark, sf_dir).select(
        "bill_id",
        "part_no",
        "redacted_text",
        F.format_string("order-%d.pdf", F.col("bill_id")).alias("original_filename"),
        F.lit("pdf").alias("file_type"),
    )
    keyed = bills.withColumn("key", F.struct("bill_id", "part_no"))
    codes = extract.candidate_codes(keyed, key="key").select("key.*", "code", "position")
    found = lookup.lookup_codes(codes, t.published_catalog(spark, sf_dir), how="inner")
    contexts = report.review_context(bills, found, keys=("bill_id", "part_no"))
    return _flat(contexts.select("bill_id", "part_no", "n_codes", *_digest("context", "context_md5")))


@query
def assemble_pages(spark, sf_dir):
    documents = extract.assemble_pages(t.bill_pages(spark, sf_dir))
    return _flat(
        documents.select("bill_id", "part_no", "n_pages", F.md5("text").alias("text_md5"), "status")
    )


@query
def short_text_filter(spark, sf_dir):
    return extract.with_text_status(t.texts(spark, sf_dir), "text").select(
        *_TEXT_KEY, "meaningful_chars", "text_status"
    )


# --- similarity ------------------------------------------------------------


@query
def knn_search(spark, sf_dir):
    vectors = t.table(spark, sf_dir, "embeddings")
    known = vectors.select(t.part_code(F.col("vec_id")).alias("code"), "embedding")
    return _flat(similarity.search_similar(vectors, known, query_key="vec_id"))


@query
def knn_probed(spark, sf_dir):
    """The approximate index on all vectors: probes, compared pairs, and the recall of ``knn_search``'s rows."""
    vectors = t.table(spark, sf_dir, "embeddings")
    known = vectors.select(t.part_code(F.col("vec_id")).alias("code"), "embedding")
    probed = densesearch.search_probed(vectors, known, query_key="vec_id")
    exact = similarity.search_similar(vectors, known, query_key="vec_id").select("query_id", "code")
    hits = exact.join(probed.matches.select("query_id", "code", F.lit(1).alias("hit")), ["query_id", "code"], "left")
    recall = hits.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    sizes = vectors.agg(F.count("*").alias("n_vectors"))
    return probed.report.join(recall).join(sizes).select(
        "n_vectors", "n_cells", "probes", "compared_pairs", "n_true", "n_found"
    )


@query
def search_result_text(spark, sf_dir):
    vectors = t.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.format_string("vector %d", F.col("vec_id")).alias("query"),
        "embedding",
    )
    known = t.vector_catalog(spark, sf_dir)
    matches = similarity.with_records(similarity.search_similar(vectors, known), known)
    shown = report.format_matches(vectors, matches)
    return _flat(shown.select("query_id", "n_results", F.md5("result_text").alias("text_md5")))


@query
def upcoding(spark, sf_dir):
    return similarity.upcoded_lines(t.vector_lines(spark, sf_dir), t.vector_catalog(spark, sf_dir)).select(
        "bill_id", "line_no", "code", "anomaly_type", "severity", "medicare_reference_price", "related"
    )


def _coded_vector_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines with the codes of the charge lines, whole catalog, best matches of what it doesn't hold.

    The supplier stands for the wording used. The vector of a wording is the
    stored one read backwards: no catalog entry has the very same.
    """
    items = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bill_id"),
        t.line_number().alias("line_no"),
        t.charge_code().alias("code"),
        F.concat(F.lit("service "), F.col("l_suppkey").cast("string")).alias("description"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("billed_amount"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("service_date"),
    )
    vectors = t.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("service "), F.col("vec_id").cast("string")).alias("description"),
        F.reverse("embedding").alias("embedding"),
    )
    catalog = t.published_catalog(spark, sf_dir)
    asked = vectors.join(similarity.unresolved_descriptions(items, catalog), "description")
    known = t.with_vectors(spark, sf_dir, catalog)
    best = similarity.search_similar(asked, known, k=1, query_key="description").select(
        F.col("query_id").alias("description"), "code", "similarity_score"
    )
    return items, catalog, best


@query
def resolve_lines(spark, sf_dir):
    return similarity.resolve_lines(*_coded_vector_lines(spark, sf_dir)).select(
        "bill_id", "line_no", "matched_code", "match_kind", "similarity_score"
    )


@query
def uncoded_lines(spark, sf_dir):
    lines, _, best = _coded_vector_lines(spark, sf_dir)
    return rules.uncoded_lines(lines, best, min_score=t.UNCODED_BAR).select(
        "bill_id", "line_no", "anomaly_type", "severity"
    )


@query
def embed_text(spark, sf_dir):
    embedded = similarity.embed_text(t.published_catalog(spark, sf_dir), "document")
    return embedded.select(
        "code",
        F.size("embedding").cast("bigint").alias("n_dims"),
        F.round(norm(F.col("embedding")), 4).alias("length"),
    )


@query
def embedder_hook(spark, sf_dir):
    """Vectors from an embedder of the caller's: how often each vowel occurs."""

    def vowels(texts: list[str]) -> np.ndarray:
        return np.array([[text.lower().count(letter) for letter in "aeiou"] for text in texts], dtype="float32")

    embedded = similarity.embed_text(t.published_catalog(spark, sf_dir), "document", embedder=vowels)
    return embedded.select("code", *[F.col("embedding")[i].cast("double").alias(f"n_{v}") for i, v in enumerate("aeiou")])


@query
def word_weights(spark, sf_dir):
    """Sparse vectors of the catalog's search documents."""
    weights = textsearch.word_weights(t.published_catalog(spark, sf_dir))
    return weights.select("code", "word", F.round("weight", 6).alias("weight"))


@query
def description_match(spark, sf_dir):
    """Every charged description matched to the catalog by its words."""
    matched = textsearch.best_matches(t.charge_lines(spark, sf_dir), t.published_catalog(spark, sf_dir))
    return matched.select("description", "code", "similarity_score")


@query
def search_text(spark, sf_dir):
    """The five best codes for the wordings of parts and for customers' names; some are blank."""
    found = textsearch.search_text(t.wordings(spark, sf_dir), t.published_catalog(spark, sf_dir))
    return _flat(found.select("query_key", "status", "code", "similarity_score", "rank"))


@query
def search_text_cost(spark, sf_dir):
    """How many pairs of texts and codes the search compares."""
    return textsearch.search_cost(t.wordings(spark, sf_dir), t.published_catalog(spark, sf_dir))


# --- records, files, events ------------------------------------------------


@query
def record_violations(spark, sf_dir):
    records = t.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity").cast("bigint") - 2).alias("quantity"),
        (F.col("l_extendedprice") - 5000).alias("billed_amount"),
        F.when(F.col("l_tax") >= 0.01, F.col("l_returnflag")).alias("description"),
        F.when(F.col("l_returnflag") == "A", "high")
        .when(F.col("l_returnflag") == "N", "low")
        .otherwise("urgent")
        .alias("severity"),
    )
    severity = next(check for check in checks.FINDING_CHECKS if check[0].startswith("severity"))
    checked = checks.with_violations(records, (*checks.LINE_CHECKS, severity))
    return checked.groupBy(F.array_join("violations", "; ").alias("violations")).agg(
        F.count("*").alias("n_records")
    )


def _by_violation(df: DataFrame, name: str, tests: tuple) -> DataFrame:
    checked = checks.with_violations(df, tests)
    return checked.groupBy(F.lit(name).alias("record"), F.array_join("violations", "; ").alias("violations")).agg(
        F.count("*").alias("n_records")
    )


@query
def typed_violations(spark, sf_dir):
    """Bills, catalog records, findings and summaries by the checks they fail."""
    orders = t.table(spark, sf_dir, "orders")
    bills = orders.select(
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderpriority")).alias("redacted_text"),
        F.when(F.col("o_orderstatus") == "F", "pdf").when(F.col("o_orderstatus") == "O", "image").otherwise("gif").alias("file_type"),
        (F.col("o_custkey") - 20).alias("char_count"),
    )
    records = t.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 8 != 0, F.col("c_name")).alias("code"),
        F.col("c_acctbal").alias("medicare_reference_price"),
        (F.col("c_nationkey") - 3).alias("total_rvu"),
        ((F.col("c_nationkey") - 2) / 20).alias("similarity_score"),
    )
    findings = orders.select(
        F.col("o_orderpriority").alias("description"),
        (F.col("o_custkey") % 5).alias("quantity"),
        (F.col("o_totalprice") - 20000).alias("billed_amount"),
        F.when(F.col("o_custkey") % 3 == 0, "upcoding").otherwise("other").alias("anomaly_type"),
        F.when(F.col("o_custkey") % 4 == 0, "info").otherwise("none").alias("severity"),
        F.when(F.col("o_custkey") % 7 != 0, F.lit("e")).alias("explanation"),
        F.lit("a").alias("suggested_action"),
        (F.col("o_totalprice") - 9000).alias("medicare_reference_price"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit(-1.0)).alias("overcharge_ratio"),
    )
    totals = orders.groupBy("o_custkey").agg(
        (F.count("*") - 9).alias("total_line_items"),
        (F.sum("o_totalprice") - 200000).alias("total_billed_amount"),
        F.count_if(F.col("o_orderstatus") == "F").alias("anomaly_count"),
        (F.count_if(F.col("o_orderstatus") == "F") - 3).alias("high_severity_count"),
        F.lit(0).alias("medium_severity_count"),
        F.lit(None).cast("double").alias("potential_overcharge_total"),
    )
    parts = [
        _by_violation(bills, "bill", checks.BILL_CHECKS),
        _by_violation(records, "record", checks.RECORD_CHECKS),
        _by_violation(findings, "finding", checks.FINDING_CHECKS),
        _by_violation(totals, "summary", checks.SUMMARY_CHECKS),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report of two findings per line; some fields and reports broken."""
    quote = F.when(F.col("l_returnflag") == "N", "").otherwise('"')
    report_text = F.concat(
        F.lit('{"total_line_items": '),
        F.col("l_quantity").cast("bigint").cast("string"),
        F.lit(', "anomalies": [{"code": '),
        quote,
        (F.lit(10000) + F.col("l_suppkey")).cast("string"),
        quote,
        F.lit(', "description": "item '),
        F.col("l_partkey").cast("string"),
        F.lit('", "quantity": '),
        (F.col("l_quantity").cast("bigint") - 2).cast("string"),
        F.lit(', "billed_amount": '),
        F.when(F.col("l_tax") < 0.02, "null").otherwise(F.floor("l_extendedprice").cast("string")),
        F.lit(', "anomaly_type": "unknown_code", "severity": "'),
        F.when(F.col("l_linestatus") == "F", "high").otherwise("urgent"),
        F.lit('", "explanation": "e", "suggested_action": "a"}, {"description": "other '),
        F.col("l_suppkey").cast("string"),
        F.lit('", "anomaly_type": "upcoding", "severity": "low", "explanation": "e"'),
        F.when(F.col("l_discount") < 0.05, ', "suggested_action": "a"').otherwise(""),
        F.lit("}"),
        F.when(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz"), "").otherwise("]}"),
    )
    return t.table(spark, sf_dir, "lineitem").select(
        F.struct(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line_no")).alias("key"),
        report_text.alias("report"),
    )


@query
def parse_findings(spark, sf_dir):
    parsed = checks.parse_findings(_reports(spark, sf_dir), key="key")
    return _flat(
        parsed.select(
            "key.*", "item_no", "code", "description", "quantity", "billed_amount", "severity"
        )
    )


@query
def finding_stats(spark, sf_dir):
    stats = checks.finding_stats(_reports(spark, sf_dir), key="key")
    return stats.agg(
        *[F.sum(name).alias(name) for name in ("total_line_items", "n_reported", "n_valid", "n_skipped")]
    )


@query
def throttle_audit(spark, sf_dir):
    """More than 5 events of a user in a day."""
    events = t.table(spark, sf_dir, "events")
    over = jobs.throttle_audit(events, limit=5, window="1 day")
    return over.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def duplicate_windows(spark, sf_dir):
    """Batch form of the streaming duplicate check, by patient and brand."""
    lines = t.patient_lines(spark, sf_dir).withColumn("ts", F.to_timestamp("service_date", "MM/dd/yyyy"))
    return _flat(jobs.stream_duplicates(lines, keys=("patient_id", "code")))


@query
def classify_table_files(spark, sf_dir):
    """The table files taken as uploads: none of them is a bill."""
    return classify_files(spark, f"{sf_dir}/*.parquet").select(
        "original_filename", "n_bytes", "file_type", "status"
    )


def _stream_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files: a pattern may name both, a plain path only a folder."""
    schema = t.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


@query
def stream_redact(spark, sf_dir):
    folder = _stream_folder(spark)
    started = jobs.stream_redact(
        _stream(spark, sf_dir, "documents").select("doc_id", "text"),
        f"{folder}/safe",
        f"{folder}/held",
        f"{folder}/checkpoint",
        profile="parity",
    )
    started.awaitTermination()
    safe = spark.read.parquet(f"{folder}/safe")
    return safe.select("doc_id", "n_total", *_digest("redacted_text", "text_md5"))


def _sinks(spark: SparkSession, sf_dir: str, gate_profile: str) -> str:
    """Folder with the three sinks of the redaction of all forms."""
    folder = _stream_folder(spark)
    jobs.stream_redact(
        t.forms_of(_stream(spark, sf_dir, "customer")),
        f"{folder}/safe",
        f"{folder}/held",
        f"{folder}/checkpoint",
        profile="parity",
        gate_profile=gate_profile,
        counts_path=f"{folder}/counts",
    ).awaitTermination()
    return folder


@query
def stream_redact_sinks(spark, sf_dir):
    """Both sinks of the redaction, behind the strict gate."""
    folder = _sinks(spark, sf_dir, "strict")
    sinks = [
        jobs.committed(spark, f"{folder}/{name}", f"{folder}/counts").select(F.lit(name).alias("sink"), "text_id", "n_total")
        for name in ("safe", "held")
    ]
    return _flat(sinks[0].unionByName(sinks[1]))


@query
def stream_redact_counts(spark, sf_dir):
    return jobs.label_counts(spark, f"{_sinks(spark, sf_dir, 'parity')}/counts", "parity")


def _arrive(
    rows: DataFrame,
    folder: str,
    beat: dict[str, Column],
    start: Callable[[DataFrame], StreamingQuery],
    slots: int = 3,
    lag_days: int = 2,
) -> None:
    """Let ``rows(ts, ...)`` arrive in a few batches, up to ``lag_days`` days late, each taken in by a run of its own.

    ``start`` starts the job on the stream; every run goes on from the checkpoint of the one
    before. The last batch is a heartbeat: one row far ahead in time, so that the watermark
    passes all others.
    """
    spark = rows.sparkSession
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(lag_days + 1))
    rows = materialise(rows.withColumn("_arrival", F.unix_seconds(F.date_trunc("day", "ts")) + late * 86_400))
    first, last = (value or 0 for value in rows.agg(F.min("_arrival"), F.max("_arrival")).first())
    step = -(-(last + 1 - first) // slots)
    schema = rows.drop("_arrival").schema
    ahead = F.timestamp_seconds(F.lit(last + 400 * 86_400))
    columns = {f.name: F.lit(None) for f in schema.fields} | beat | {"ts": ahead}
    beats = spark.range(1).select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    slot_of = F.floor((F.col("_arrival") - first) / step)
    for batch in [*[rows.where(slot_of == slot).drop("_arrival") for slot in range(slots)], beats]:
        batch.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in")).awaitTermination()


@query
def stream_throttle(spark, sf_dir):
    """``throttle_audit`` on a stream of events out of order."""
    folder = _stream_folder(spark)
    events = t.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))

    def start(stream: DataFrame) -> StreamingQuery:
        over = jobs.throttle_audit(stream, limit=5, window="1 day", watermark="3 days")
        return jobs.write_windows(over, f"{folder}/out", f"{folder}/checkpoint")

    _arrive(events, folder, {}, start)
    found = spark.read.parquet(f"{folder}/out")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def stream_duplicate_charge(spark, sf_dir):
    """``duplicate_charge`` on a stream of lines out of order."""
    folder = _stream_folder(spark)
    lines = t.patient_lines(spark, sf_dir).withColumn("ts", F.to_timestamp("service_date", "MM/dd/yyyy"))
    shards = jobs.shards_for(t.table(spark, sf_dir, "lineitem").count())
    beat = {"patient_id": F.lit(-1), "code": F.lit(""), "bill_id": F.lit(-1), "line_no": F.lit(0)}

    def start(stream: DataFrame) -> StreamingQuery:
        found = jobs.stream_duplicate_charges(stream, ("patient_id", "code"), watermark="3 days", shards=shards)
        return jobs.write_windows(found, f"{folder}/out", f"{folder}/checkpoint")

    with jobs.rocksdb_state(spark):
        _arrive(lines, folder, beat, start)
    return spark.read.parquet(f"{folder}/out").select(
        "bill_id", "line_no", "code", "service_date", "severity", "related"
    )


@query
def stream_prices(spark, sf_dir):
    folder = _stream_folder(spark)
    lines = t.charge_lines_of(_stream(spark, sf_dir, "lineitem"), t.table(spark, sf_dir, "part"))
    jobs.stream_prices(
        lines, t.published_catalog(spark, sf_dir), f"{folder}/findings", f"{folder}/checkpoint", per_unit=True
    ).awaitTermination()
    return _price_columns(spark.read.parquet(f"{folder}/findings"))
