r"""Redaction pattern tables and their translation to Spark's regex dialect.

The tables are written in the dialect they were published in, where ``\b``,
``\d``, ``\s`` and ``\w`` cover all of Unicode. Spark's engine reads these as
ASCII, so ``spark_regex`` spells the classes out.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Pattern(NamedTuple):
    label: str
    regex: str
    token: str
    ignore_case: bool = False


class Guard(NamedTuple):
    """What a text must hold for a pattern to match: a word, or a shape.

    Guards are cheap and let most texts skip the pattern itself. ``words`` are
    lower-case; one of them is enough.
    """

    words: tuple[str, ...] = ()
    shape: str = ""


# Labels, patterns, tokens and their order decide the results.
PARITY = (
    Pattern("SSN", r"\b(?:ssn|social\s+security(?:\s+number)?)\s*[:\-#]?\s*\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN]", True),
    Pattern("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    Pattern("MEDICARE_ID", r"\b(?:medicare|medicaid)\s*(?:id|number|#|no\.?)?\s*[:\-]?\s*[A-Z0-9]{1,4}[-\s]?[A-Z0-9]{2,3}[-\s]?[A-Z0-9]{2,4}\b", "[MEDICARE_ID]", True),
    Pattern("MEMBER_ID", r"\b(?:member\s*id|policy\s*(?:id|number|#)|subscriber\s*id|group\s*(?:id|number|#)|insurance\s*id)\s*[:\-#]?\s*[A-Z0-9]{6,20}\b", "[MEMBER_ID]", True),
    Pattern("DOB", r"\b(?:dob|date\s+of\s+birth|birth\s*date)\s*[:\-]?\s*(?:\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b", "[DOB]", True),
    Pattern("PHONE", r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}", "[PHONE]"),
    Pattern("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    Pattern("CARD_NUMBER", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}(?:[-\s]?\d{1,3})?\b", "[CARD_NUMBER]"),
    Pattern("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
    Pattern("NAME", r"\b(?:patient\s*(?:name)?|member\s*name|insured\s*name|subscriber\s*name|guarantor\s*name|responsible\s*party)\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", "[NAME]", True),
    Pattern("ADDRESS", r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,4}(?:street|st|avenue|ave|boulevard|blvd|road|rd|drive|dr|lane|ln|court|ct|place|pl|way|circle|cir)(?:\s*,\s*(?:apt|suite|ste|unit|#)\s*[\w]+)?\b", "[ADDRESS]", True),
)

# The stricter published profile. The last entry keeps its label
# ($1) and hides the value only.
STRICT = (
    Pattern("SSN", r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b", "[SSN]"),
    Pattern("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    Pattern("PHONE", r"\b(?:\+1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", "[PHONE]"),
    Pattern("DATE", r"\b(?:0?[1-9]|1[0-2])[\/\-](?:0?[1-9]|[12]\d|3[01])[\/\-](?:19|20)\d{2}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:0?[1-9]|[12]\d|3[01]),?\s+(?:19|20)\d{2}\b", "[DATE]", True),
    Pattern("INSURANCE_ID", r"(?:member\s*(?:id|#|number)|policy\s*(?:id|#|number)|insurance\s*(?:id|#|number)|subscriber\s*(?:id|#))\s*:?\s*(?:[A-Z0-9\-]{6,20})", "[INSURANCE_ID]", True),
    Pattern("MRN", r"(?:mrn|medical\s*record\s*(?:number|#|no))\s*:?\s*(?:[A-Z0-9\-]{4,20})", "[MRN]", True),
    Pattern("ZIP+4", r"\b\d{5}-\d{4}\b", "[ZIP+4]"),
    Pattern("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "[CREDIT_CARD]"),
    Pattern("NAME", r"((?:patient|guarantor|subscriber|insured|member|responsible\s*party)\s*(?:name)?\s*:?\s*)[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", "$1[NAME]", True),
)

# Parity with its known misses and over-redactions mended: name words keep
# their capitals and stay on one line, an address keeps its capitals, a
# Medicare number holds a digit, and 15-digit cards are found.
_MENDED = {
    "MEDICARE_ID": r"\b(?i:medicare|medicaid)\s*(?i:id|number|#|no\.?)?\s*[:\-]?\s*(?=[A-Za-z\-\s]{0,9}\d)[A-Za-z0-9]{1,4}[-\s]?[A-Za-z0-9]{2,3}[-\s]?[A-Za-z0-9]{2,4}\b",
    "CARD_NUMBER": r"\b(?:3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}|(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}(?:[-\s]?\d{1,3})?)\b",
    "NAME": r"\b(?i:patient[ \t]*(?:name)?|member[ \t]*name|insured[ \t]*name|subscriber[ \t]*name|guarantor[ \t]*name|responsible[ \t]*party)[ \t]*[:\-]?[ \t]*(?:[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3})\b",
    "ADDRESS": r"\b\d{1,5}[ \t]+(?:[A-Z][a-z]+[ \t]+){1,4}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way|Circle|Cir)(?:[ \t]*,[ \t]*(?i:apt|suite|ste|unit|#)[ \t]*[\w]+)?\b",
}
SAFE = tuple(
    Pattern(p.label, _MENDED[p.label], p.token, False) if p.label in _MENDED else p for p in PARITY
)

PROFILES = {"parity": PARITY, "safe": SAFE, "strict": STRICT}

# One guard per pattern, in pattern order.
_PARITY_GUARDS = (
    Guard(words=("ssn", "social")),
    Guard(shape=r"\d-\d{2}-\d"),
    Guard(words=("medicare", "medicaid")),
    Guard(words=("member", "policy", "subscriber", "group", "insurance")),
    Guard(words=("dob", "birth")),
    Guard(shape=r"\d{3}[-.\s]\d{4}"),
    Guard(words=("@",)),
    Guard(shape=r"\d{4}[-\s]?\d{4}"),
    Guard(shape=r"\d\.\d{1,3}\.\d"),
    Guard(words=("patient", "member", "insured", "subscriber", "guarantor", "responsible")),
    Guard(shape=r"\d\s+\p{L}"),
)
_STRICT_GUARDS = (
    Guard(shape=r"\d{3}[-\s]?\d{2}[-\s]?\d{4}"),
    Guard(words=("@",)),
    Guard(shape=r"\d{3}[\s\-.]?\d{4}"),
    Guard(shape=r"(?:19|20)\d{2}"),
    Guard(words=("member", "policy", "insurance", "subscriber")),
    Guard(words=("mrn", "medical")),
    Guard(shape=r"\d-\d{4}"),
    Guard(shape=r"\d{13}"),
    Guard(words=("patient", "guarantor", "subscriber", "insured", "member", "responsible")),
)
GUARDS = {"parity": _PARITY_GUARDS, "safe": _PARITY_GUARDS, "strict": _STRICT_GUARDS}

# Letters outside a-z that count as one of them when case is ignored.
CASE_EXTRAS = ("\u017f", "\u212a", "\u0131", "\u0130")

_CLASSES = {
    "d": r"\p{Nd}",
    "s": r"\s\x1c-\x1f\x85\p{Z}",
    "w": r"\p{L}\p{N}_",
}
_WORD = f"[{_CLASSES['w']}]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _boundary(before: str, after: str) -> str:
    """The shortest test for a word boundary between two stretches of a regex.

    A boundary that opens an alternative and is followed by a letter or digit
    needs a look back only; one that closes an alternative (all of them end in
    a word character) needs a look ahead only.
    """
    if after == "" or after.startswith("|"):
        return f"(?!{_WORD})"
    opens = before == "" or before.endswith("|")
    if opens and re.match(r"\(*(?:\?:)?\(*(?:\\d|[A-Za-z0-9])", after):
        return f"(?<!{_WORD})"
    return _BOUNDARY


def spark_regex(regex: str, ignore_case: bool = False) -> str:
    """``regex`` with its shorthand classes spelled out for all of Unicode."""
    out: list[str] = []
    in_class = False
    at = 0
    while at < len(regex):
        char = regex[at]
        if char == "\\":
            name = regex[at + 1]
            if name == "b" and not in_class:
                out.append(_boundary(regex[:at], regex[at + 2 :]))
            elif name in _CLASSES:
                body = _CLASSES[name]
                out.append(body if in_class else f"[{body}]")
            else:
                out.append(char + name)
            at += 2
            continue
        if char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        out.append(char)
        at += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)
