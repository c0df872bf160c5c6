"""Text, number and label columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chargeaudit import constants as c

# All Unicode white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def ws_trim(col: Column) -> Column:
    """Strip all leading and trailing white space, not only blanks."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    """No character but white space; true for null."""
    return ~F.coalesce(col.rlike(NOT_SPACE), F.lit(False))


def normalise_code(col: Column) -> Column:
    """Trimmed upper-case code; null when nothing is left."""
    return F.nullif(F.upper(ws_trim(col)), F.lit(""))


def normalise_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def parse_number(col: Column) -> Column:
    """Text as a double, null when it is not a number."""
    ok = col.rlike(_NUMBER) | col.rlike(_INFINITY)
    return F.when(ok, F.trim(col).try_cast("double"))


def to_number(col: Column) -> Column:
    """Text as a double, 0 when it is missing or not a number."""
    return F.coalesce(parse_number(col), F.lit(0.0))


def round_even(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the way array libraries do it."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def _exact_steps(value: Column, digits: int, ties: str) -> Column:
    """``value`` times ``10**digits`` rounded to a whole number as if no digit were ever lost.

    A double is a binary fraction; scaling it can lose what decides a tie (2.675 is a little
    less than it reads). So the product's own error is computed from the two halves of the
    double, and a product that reads as a tie is settled by the error's sign; true ties go to
    the even number, or away from zero.
    """
    scale = float(10**digits)
    x = value.cast("double")
    product = x * scale
    below = F.floor(product).cast("double")
    carried = x * 134217729.0
    high = carried - (carried - x)
    error = (high * scale - product) + (x - high) * scale
    even = F.rint(product) if ties == "even" else F.when(product < 0, below).otherwise(below + 1)
    settled = F.when(error > 0, below + 1).when(error < 0, below).otherwise(even)
    # Larger products are whole numbers or halves already, exact below 4.5e13 for two digits.
    tie = (F.abs(product) < 4.5e15) & (product - below == 0.5)
    return F.when(tie, settled).otherwise(F.rint(product))


def round_exact(col: Column, digits: int) -> Column:
    """Nearest double to the exact value rounded once, half to even: the way languages round."""
    return _exact_steps(col, digits, "even") / float(10**digits)


def fixed(col: Column, digits: int, ties: str = "even") -> Column:
    """Plain fixed-point text of the exact value, rounded once; null for null."""
    steps = _exact_steps(col, digits, ties).cast("decimal(38,0)")
    return (steps * F.lit(10**-digits).cast(f"decimal({digits + 1},{digits})")).cast(f"decimal(38,{digits})").cast("string")


def usd(col: Column) -> Column:
    """Money as shown to people: sign, dollar, thousands, ties away from zero; N/A for null."""
    cents = F.regexp_replace(fixed(F.abs(col), 2, "away"), r"(\d)(?=(\d{3})+\.)", "$1,")
    text = F.concat(F.when(col < 0, "-").otherwise(""), F.lit("$"), cents)
    return F.coalesce(text, F.lit("N/A"))


def ratio_text(col: Column) -> Column:
    """``4.1×`` style text, only for ratios above 1."""
    return F.when(col > 1, F.concat(fixed(col, 1), F.lit("× Medicare rate")))


def pick(col: Column, table: dict[str, object], default: object = None) -> Column:
    """Look a value up in a small fixed table."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def label(col: Column) -> Column:
    """Display label of an anomaly type or a severity."""
    return F.coalesce(pick(col, {**c.TYPE_LABELS, **c.SEVERITY_LABELS}), col)


def severity_rank(col: Column) -> Column:
    return pick(col, {name: rank for rank, name in enumerate(c.SEVERITIES)}).cast("int")


def type_rank(col: Column) -> Column:
    return pick(col, {name: rank for rank, name in enumerate(c.ANOMALY_TYPES)}).cast("int")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def parse_service_date(col: Column) -> Column:
    """Date of a service-date string; null when no known format fits.

    The usual ten-character form is put in ISO order and cast, which is cheaper
    than a pattern; the patterns see only what is left.
    """

    def usual(text: Column) -> Column:
        us_form = (F.length(text) == 10) & F.substring(text, 3, 1).isin("/", "-")
        iso = F.when(
            us_form,
            F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2)),
        )
        return iso.try_cast("date")

    def parse(text: Column) -> Column:
        patterns = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "M/d/yy")
        return F.coalesce(usual(text), *[F.try_to_date(text, p) for p in patterns])

    # ``bind`` is interpreted, so it sees only what isn't in the usual form as it stands: with white
    # space around it, no ten characters make such a date.
    return F.coalesce(usual(col), bind(ws_trim(col), parse))


def split_document(col: Column) -> Column:
    """Description part of a search document, empty when there is none."""
    at = F.instr(col, ": ")
    return F.when(at > 0, F.substring(col, at + 2, F.length(col))).otherwise("")


def join_ordered(position: Column, text: Column, separator: str) -> Column:
    """Aggregate: the texts of a (bounded) group joined in ``position`` order."""
    rows = F.sort_array(F.collect_list(F.struct(position.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda row: row["text"]), separator)
