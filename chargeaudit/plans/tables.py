"""The driver's tables in the roles of the audit: lists, catalog, bills, lines.

Every function reads whole tables. The odd cases (unknown codes, missing
amounts, uncoded lines, broken numbers) follow from the rows' own values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.operators.catalog import (
    build_catalog,
    clean_codes,
    compute_rates,
    with_document,
)
from chargeaudit.session import materialise, spread


# Tables of a few rows at any scale; all others grow, and what is made of their rows is dealt over all cores.
_FIXED = ("nation", "region")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if name in _FIXED else spread(rows)


# Similarity from which a line without a code counts as known; scores lie on both sides.
UNCODED_BAR = 0.35

# Score from which a description counts as found in the catalog, and how much better a cheaper
# code has to fit; texts differ from documents by the code, so scores stay between 0.5 and 0.65.
TEXT_BAR = 0.565
TEXT_MARGIN = 0.05

# Numbers of four signs in base 36 that begin with a letter: A000 to ZZZZ.
LETTERED = 26 * 36**3


def _lettered(number: Column, signs: int = 4) -> Column:
    return F.conv((number + 10 * 36 ** (signs - 1)).cast("string"), 10, 36)


def lettered_code(letter: str, key: Column, longest: int = 8) -> Column:
    """A letter and four digits; from key 10,000 on a letter and four base-36 signs, the first a letter.

    From key 1,223,056 on there are five such signs, from 44,893,072 on six, up to ``longest``.
    Different keys have different codes; a key beyond the range is an error.
    """
    code, first = F.when(key < 10_000, F.concat(F.lit(letter), F.lpad(key.cast("string"), 4, "0"))), 10_000
    for signs in range(4, longest + 1):
        last = first + 26 * 36 ** (signs - 1)
        code, first = code.when(key < last, F.concat(F.lit(letter), _lettered(key - first, signs))), last
    return code.otherwise(F.raise_error(F.lit("key beyond the range of its codes")))


def part_code(key: Column) -> Column:
    """Code of a part: five digits; from key 100,000 on a digit, a letter and three base-36 signs."""
    rest = key - 100_000
    more = F.when(
        rest < 10 * LETTERED,
        F.concat(F.floor(rest / LETTERED).cast("string"), _lettered(rest % LETTERED)),
    ).otherwise(F.raise_error(F.lit("key beyond the range of its codes")))
    return F.when(key < 100_000, F.lpad(key.cast("string"), 5, "0")).otherwise(more)


def supplier_code(key: Column) -> Column:
    """Second code family; the catalog takes codes of five signs only, so there are no longer ones."""
    return lettered_code("J", key, longest=4)


def part_description() -> Column:
    return F.concat_ws(" ", F.col("p_name"), F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string"))


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code list as delivered: padded and lower-case codes, repeats, misfits.

    Parts come twice, the second time with an outdated text; suppliers have a
    short text only; most nation names are no codes at all.
    """
    part = table(spark, sf_dir, "part")
    parts = part.select(
        F.concat(F.lit("  "), part_code(F.col("p_partkey")), F.lit("\t")).alias("hcpc"),
        part_description().alias("long_description"),
        F.concat(F.lit(" "), F.col("p_name")).alias("short_description"),
        F.lit(1).alias("file_no"),
        F.col("p_partkey").alias("row_no"),
    )
    outdated = part.select(
        part_code(F.col("p_partkey")).alias("hcpc"),
        F.lit("outdated").alias("long_description"),
        F.col("p_brand").alias("short_description"),
        F.lit(2).alias("file_no"),
        F.col("p_partkey").alias("row_no"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lower(supplier_code(F.col("s_suppkey"))).alias("hcpc"),
        F.lit(None).cast("string").alias("long_description"),
        F.col("s_name").alias("short_description"),
        F.lit(1).alias("file_no"),
        F.col("s_suppkey").alias("row_no"),
    )
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("hcpc"),
        F.lit("").alias("long_description"),
        F.lit(None).cast("string").alias("short_description"),
        F.lit(3).alias("file_no"),
        F.col("n_nationkey").cast("bigint").alias("row_no"),
    )
    return parts.unionByName(outdated).unionByName(suppliers).unionByName(nations)


def raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate file as delivered: three value units as text, some of them no numbers.

    Suppliers' codes have no rate. Regions have a rate but no description.
    """
    unit = F.col("p_retailprice") / F.lit(32.74)
    parts = table(spark, sf_dir, "part").select(
        F.concat(part_code(F.col("p_partkey")), F.lit(" ")).alias("hcpcs"),
        (unit * F.lit(0.5)).cast("string").alias("work_rvu"),
        F.when(F.col("p_size") > 45, F.lit("NA"))
        .otherwise((unit * F.lit(0.3)).cast("string"))
        .alias("fac_pe_rvu"),
        F.when(F.col("p_size") < 5, F.lit(None))
        .otherwise((unit * F.lit(0.2)).cast("string"))
        .alias("mp_rvu"),
        F.col("p_partkey").alias("row_no"),
    )
    regions = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r000"), F.col("r_regionkey").cast("string")).alias("hcpcs"),
        F.lit("1.25").alias("work_rvu"),
        F.lit("0.5").alias("fac_pe_rvu"),
        F.col("r_name").alias("mp_rvu"),
        F.col("r_regionkey").cast("bigint").alias("row_no"),
    )
    return parts.unionByName(regions)


def clean_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_codes(raw_codes(spark, sf_dir), ["file_no", "row_no"])


def rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_rates(raw_rates(spark, sf_dir), ["row_no"])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_document(build_catalog(clean_code_table(spark, sf_dir), rate_table(spark, sf_dir)))


def published_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written once, as the audit jobs read it."""
    return materialise(catalog(spark, sf_dir))


def charge_code() -> Column:
    """Code on a charge line: none, an unknown one, a supplier's or a part's."""
    return (
        F.when(F.col("l_discount") >= 0.1, F.lit(None))
        .when(F.col("l_tax") >= 0.08, lettered_code("X", F.col("l_partkey")))
        .when(F.col("l_returnflag") == "R", supplier_code(F.col("l_suppkey")))
        .otherwise(part_code(F.col("l_partkey")))
    )


def line_number() -> Column:
    """Ordered, not dense: the line number, then the part, then the supplier."""
    return (
        F.col("l_linenumber").cast("bigint") * 10_000_000_000_000_000
        + F.col("l_partkey") * 10_000_000
        + F.col("l_suppkey")
    )


def charge_lines_of(items: DataFrame, part: DataFrame) -> DataFrame:
    parts = part.select("p_partkey", part_description().alias("description"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("bill_id"),
        line_number().alias("line_no"),
        charge_code().alias("code"),
        "description",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).alias("billed_amount"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("service_date"),
    )


def charge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines out of ``lineitem``: bill = order, description = part."""
    return charge_lines_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def patient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines coded by brand, with the patient (customer) they belong to."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", part_description().alias("description"))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("patient_id"),
            F.col("l_orderkey").alias("bill_id"),
            line_number().alias("line_no"),
            F.upper(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("B"))).alias("code"),
            "description",
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("l_extendedprice").alias("billed_amount"),
            F.date_format("l_shipdate", "MM/dd/yyyy").alias("service_date"),
        )
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines of monthly statements, one bill for each patient, on which all five kinds of findings occur.

    The service is described as the part; the code billed is one of the first thousand parts',
    so many descriptions fit other codes better.
    """
    billed = (F.col("l_partkey") % 1000 + 1).alias("l_partkey")
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", part_description().alias("description"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    named = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    others = [F.col(name) for name in items.columns if name != "l_partkey"]
    return named.select(*others, billed, "description", "o_custkey").select(
        F.col("o_custkey").alias("bill_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        charge_code().alias("code"),
        "description",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).alias("billed_amount"),
        F.date_format(F.date_trunc("month", "l_shipdate"), "MM/dd/yyyy").alias("service_date"),
    )


def bundling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundling table: every part contains the part with the next key."""
    return table(spark, sf_dir, "part").select(
        part_code(F.col("p_partkey")).alias("code"),
        part_code(F.col("p_partkey") + 1).alias("component_code"),
    )


def line_text() -> Column:
    """One charge line the way it is printed on a bill."""
    amount = F.coalesce(F.concat(F.lit("$"), F.col("billed_amount").cast("decimal(12,2)").cast("string")), F.lit("n/a"))
    return F.concat_ws(" ", "service_date", F.lower("code"), "description", amount)


def bill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scanned documents: one turn is one page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("bill_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        "text",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of documents, pages and conversations."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("text_id"), F.lit(0).cast("bigint").alias("turn"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("text_id"), F.lit(0).cast("bigint").alias("turn"), F.col("html").alias("text")
    )
    talks = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("text_id"), "turn", "text"
    )
    return documents.unionByName(pages).unionByName(talks)


def wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to search for: parts in other words, small parts without any, and customers' names."""
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("query_key"),
        F.when(F.col("p_size") < 3, F.lit(" \t"))
        .otherwise(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lit("no."), F.col("p_size").cast("string")))
        .alias("text"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("query_key"), F.col("c_name").alias("text")
    )
    return parts.unionByName(customers)


# Words that forms are filled in with, picked by key.
GIVEN_NAMES = ("Ada", "Boris", "Carla", "Dmitri", "Elena", "Farid", "Greta")
FAMILY_NAMES = ("Abbott", "Brandt", "Castillo", "Dubois", "Eklund")
STREETS = ("Oak", "Linden", "Harbour", "Mill")


def _chosen(words: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(word) for word in words]), (key % len(words) + 1).cast("int"))


def intake_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms_of(table(spark, sf_dir, "customer"))


def forms_of(customers: DataFrame) -> DataFrame:
    """One form for each customer with labelled personal data of every kind, some fields left out."""
    key = F.col("c_custkey")
    digits = lambda factor, width: F.lpad(((key * factor + 17) % 10**width).cast("string"), width, "0")
    name = F.concat_ws(" ", _chosen(GIVEN_NAMES, key), _chosen(FAMILY_NAMES, key))
    lines = [
        F.concat(F.lit("Patient Name: "), name),
        F.when(key % 2 == 0, F.concat(F.lit("SSN: "), digits(7, 3), F.lit("-"), digits(11, 2), F.lit("-"), digits(13, 4))),
        F.when(key % 3 == 0, F.concat(F.lit("id "), digits(19, 3), F.lit("-"), digits(23, 2), F.lit("-"), digits(29, 4))),
        F.when(key % 2 == 1, F.concat(F.lit("Medicare ID: 1EG4-TE5-MK"), digits(31, 2))),
        F.concat(F.lit("Member ID: ZX"), digits(37, 7)),
        F.when(key % 5 != 0, F.concat(F.lit("DOB: 0"), (key % 9 + 1).cast("string"), F.lit("/1"), (key % 9).cast("string"), F.lit("/19"), digits(41, 2))),
        F.concat((key % 9000 + 10).cast("string"), F.lit(" "), _chosen(STREETS, key), F.lit(" Street, Apt "), (key % 40).cast("string")),
        F.concat(F.lit("Phone ("), digits(43, 3), F.lit(") "), digits(47, 3), F.lit("-"), digits(53, 4)),
        F.concat(F.lit("Mail c"), key.cast("string"), F.lit("@clinic.example")),
        F.when(key % 4 == 0, F.concat(F.lit("Card 4"), digits(59, 3), F.lit(" "), digits(61, 4), F.lit(" "), digits(67, 4), F.lit(" "), digits(71, 4))),
        F.when(key % 7 == 0, F.concat(F.lit("From 10."), (key % 256).cast("string"), F.lit(".0.1"))),
        F.when(key % 6 == 0, F.concat(F.lit("Ref "), digits(73, 10))),
        F.lit("Balance due on 01/15/2025 for 99213"),
    ]
    return customers.select(
        F.lit("forms").alias("source"), key.alias("text_id"), F.lit(0).cast("bigint").alias("turn"), F.concat_ws("\n", *lines).alias("text")
    )


def uploaded_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms as uploads; some are blank, short, too large or of the wrong type."""
    key = F.col("text_id")
    text = F.when(key % 17 == 0, F.lit(" \n")).when(key % 19 == 0, F.lit("Mail x@y.example")).otherwise(F.col("text"))
    return intake_forms(spark, sf_dir).select(
        key.alias("bill_id"),
        text.alias("text"),
        F.when(key % 11 == 0, "gif").when(key % 2 == 0, "image").otherwise("pdf").alias("file_type"),
        F.when(key % 13 == 0, F.lit(10 * 1024 * 1024 + 1)).otherwise(F.lit(10 * 1024 * 1024)).cast("bigint").alias("n_bytes"),
    )


def with_vectors(spark: SparkSession, sf_dir: str, codes: DataFrame) -> DataFrame:
    """Catalog records with a vector each: parts and suppliers share the stored ones in turn by key."""
    vectors = table(spark, sf_dir, "embeddings")
    keyed = (
        table(spark, sf_dir, "part")
        .select(part_code(F.col("p_partkey")).alias("code"), F.col("p_partkey").alias("_key"))
        .unionByName(
            table(spark, sf_dir, "supplier").select(supplier_code(F.col("s_suppkey")).alias("code"), F.col("s_suppkey").alias("_key"))
        )
        .withColumn("vec_id", F.pmod("_key", F.lit(vectors.count())))
        .drop("_key")
    )
    return codes.join(keyed, "code").join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def vector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published catalog's parts and suppliers with their vectors."""
    return with_vectors(spark, sf_dir, published_catalog(spark, sf_dir))


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines with the vector of their text.

    The supplier stands for the wording used: equal suppliers, equal texts.
    """
    items = table(spark, sf_dir, "lineitem")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("text_id"), "embedding")
    return items.select(
        F.col("l_orderkey").alias("bill_id"),
        line_number().alias("line_no"),
        part_code(F.col("l_partkey")).alias("code"),
        F.concat(F.lit("service "), F.col("l_suppkey").cast("string")).alias("description"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("billed_amount"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("service_date"),
        F.col("l_suppkey").alias("text_id"),
    ).join(vectors, "text_id")
