"""Raw files: strings with normalised headers, preambles, uploads."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import join_ordered, normalise_header
from chargeaudit.operators.catalog import resolve_columns
from chargeaudit.operators.numbering import top_per_key
from chargeaudit.session import broadcast_if_small, materialise


def numbered_names(names: Sequence[str]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        count = seen.get(name, 0)
        out.append(f"{name}.{count}" if count else name)
        seen[name] = count + 1
    return out


def read_strings(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """CSV with a header in every file, all columns as text, header names normalised.

    With ``order``, ``row_id`` tells the order of the rows of a file.
    """
    lines = numbered_lines(spark, path, "UTF-8")
    tops = {row.file: row for row in _leading(lines, 1)}
    rows = _parsed(lines, {file: (row.line, row.value) for file, row in tops.items()}, path)
    return rows if order else rows.drop("row_id")


def read_below_preamble(
    spark: SparkSession,
    path: str,
    markers: Sequence[str] = ("HCPCS", "MOD"),
    scan: int = c.PREAMBLE_SCAN_LINES,
    fallback: int = c.PREAMBLE_FALLBACK_LINE,
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """CSV files whose header follows some title lines, all columns as text.

    The header of a file is the first of its ``scan`` lines that holds all ``markers``, else,
    with a warning, line ``fallback`` counted from 0. Only those lines reach the driver; the
    rows are split and parsed by Spark. ``row_id`` keeps the order of the rows of a file.
    """
    lines = numbered_lines(spark, path, encoding)
    wanted = [marker.upper() for marker in markers]
    tops: dict[str, list] = {}
    for row in _leading(lines, scan):
        tops.setdefault(row.file, []).append(row)
    headers = {}
    for file, rows in tops.items():
        named = [row for row in rows if all(marker in row.value.upper() for marker in wanted)]
        if not named:
            if len(rows) <= fallback:
                raise ValueError(f"no header found in {file}")
            warnings.warn(f"no header with {', '.join(markers)} in {file}: line {fallback} is taken", stacklevel=2)
        row = named[0] if named else rows[fallback]
        headers[file] = (row.line, row.value)
    return _parsed(lines, headers, path)


def numbered_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, line, value): the lines of all files; ``line`` grows inside a block of a file."""
    # Without a line break of its own choice the reader would take line breaks in quotes apart.
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.decode(F.col("value").cast("binary"), encoding).alias("value"),
    )
    # Written once: the numbers of the lines depend on how a scan deals its files out.
    return materialise(lines)


def _leading(lines: DataFrame, count: int) -> list:
    """The first ``count`` lines of every file, in order: a few rows for each file."""
    first = lines.where("block = 0").withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))
    return top_per_key(first, ["file"], ["line"], count, "_n").orderBy("file", "line").collect()


def whole_records(lines: DataFrame) -> DataFrame:
    """(file, row_id, value): records out of lines, though quoted line breaks run through them.

    A line is inside of quotes if the quotes before it are odd in number. Each block of a file
    counts its quotes, the sums over the blocks before give where a block starts, and inside a
    block the lines are counted on; so the file is read in blocks like any other. Only lines
    that hold a part of a record are brought together. A quote that never closes is an error.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    counted = lines.withColumn("quotes", quotes)
    blocks = Window.partitionBy("file").orderBy("block")
    ahead = blocks.rowsBetween(Window.unboundedPreceding, -1)
    before = counted.groupBy("file", "block").agg(F.sum("quotes").alias("sum")).select(
        "file",
        "block",
        F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("before"),
        (F.sum("sum").over(Window.partitionBy("file")) % 2).alias("open"),
    )
    before = materialise(before)  # one row for each block of a file
    broken = before.where("open = 1").select("file").first()
    if broken is not None:
        raise ValueError(f"a quote never closes in {broken.file}")
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(broadcast_if_small(before.drop("open")), ["file", "block"]).withColumn(
        "after", F.col("before") + F.sum("quotes").over(inside)
    )
    row_id = F.struct("block", "line")
    starts = (F.col("after") - F.col("quotes")) % 2 == 0
    parts = placed.select(
        "file",
        "block",
        "line",
        row_id.alias("row_id"),
        "value",
        (starts & (F.col("after") % 2 == 0)).alias("whole"),
        F.max(F.when(starts, row_id)).over(inside).alias("start"),
    )
    parts = materialise(parts)
    whole = parts.where("whole").select("file", "row_id", "value")
    # A part belongs to the last record that started before it, maybe some blocks back.
    carried = materialise(
        parts.groupBy("file", "block")
        .agg(F.max("start").alias("last"))
        .select("file", "block", F.max("last").over(ahead).alias("carried"))
    )
    joined = (
        parts.where("not whole")
        .join(broadcast_if_small(carried), ["file", "block"])
        .groupBy("file", F.coalesce("start", "carried").alias("record"))
        .agg(join_ordered(F.col("row_id"), F.col("value"), "\n").alias("value"))
        .select("file", F.col("record").alias("row_id"), "value")
    )
    return whole.unionByName(joined)


def _parsed(lines: DataFrame, headers: dict[str, tuple[int, str]], path: str) -> DataFrame:
    """Rows below the header of each file as text columns, with ``row_id``.

    Files with the same header are parsed together; a column that some files lack is null there.
    """
    if not headers:
        raise ValueError(f"no header found in {path}")
    spark = lines.sparkSession
    below = spark.createDataFrame([(file, line) for file, (line, _) in headers.items()], "file string, _header long")
    kept = lines.join(F.broadcast(below), "file").where((F.col("block") > 0) | (F.col("line") > F.col("_header")))
    records = whole_records(kept.drop("_header")).withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))
    records = records.where(F.trim("value") != "")
    files: dict[str, list[str]] = {}
    for file, (_, header) in headers.items():
        files.setdefault(header, []).append(file)
    tables = []
    for header, own in files.items():
        names = numbered_names([normalise_header(name) for name in next(csv.reader([header]))])
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        mine = records if len(files) == 1 else records.where(F.col("file").isin(own))
        cells = F.from_csv("value", fields, {"mode": "PERMISSIVE", "escape": '"', "multiLine": "true"}).alias("cells")
        tables.append(
            mine.select("row_id", cells).select("row_id", *[F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)])
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_codes(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """Code list: code, long and short description as text."""
    raw = read_strings(spark, path, order)
    columns = resolve_columns(raw, c.CODE_LIST_COLUMNS)
    return raw.select(*(["row_id"] if order else []), *[value.alias(name) for name, value in columns.items()])


def file_kind(content: Column) -> Column:
    """PDF, JPEG or PNG by the leading bytes, else null."""
    # Leading bytes of the accepted file types.
    lead = F.hex(F.substring(content, 1, 8))
    return (
        F.when(lead.startswith("255044462D"), "application/pdf")
        .when(lead.startswith("FFD8FF"), "image/jpeg")
        .when(lead.startswith("89504E470D0A1A0A"), "image/png")
    )


def classify_files(spark: SparkSession, path: str, max_mb: int = c.MAX_UPLOAD_MB) -> DataFrame:
    """Every file with its size, type and route: ok, file_too_large or invalid_file_type.

    Size is checked first. The limit itself is still accepted.
    """
    limit = max_mb * 1024 * 1024
    files = spark.read.format("binaryFile").load(path)
    # The content of files beyond the limit is never read.
    large = files.where(F.col("length") > limit).select(
        "path", "length", F.lit(None).cast("string").alias("mime_type")
    )
    small = files.where(F.col("length") <= limit).select(
        "path", "length", file_kind(F.col("content")).alias("mime_type")
    )
    kind = F.col("mime_type")
    return large.unionByName(small).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        F.col("length").alias("n_bytes"),
        "mime_type",
        F.when(kind == "application/pdf", "pdf").when(kind.isNotNull(), "image").alias("file_type"),
        F.when(F.col("length") > limit, "file_too_large")
        .when(kind.isNull(), "invalid_file_type")
        .otherwise("ok")
        .alias("status"),
    )


def matching_files(files: DataFrame, name_pattern: str, path_col: str = "path") -> DataFrame:
    """Files whose whole base name fits the pattern; suspicious paths are refused."""
    path = F.col(path_col)
    base = F.element_at(F.split(path, "/"), -1)
    suspicious = path.contains("..") | path.startswith("/")
    return files.where(base.rlike(f"(?i)^(?:{name_pattern})$")).withColumn("is_suspicious", suspicious)
