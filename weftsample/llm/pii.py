"""Personal data by anchors: an automaton finds cues, local parsers find the boundaries."""

from __future__ import annotations

import re
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, table, whole_text

#: The kinds of the base, in their order, and those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

#: Cues that announce an account number.
ACCOUNT_CUES = ("IBAN", "Iban", "iban")

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)

# Runs of one set of signs; the parsers decide what a run holds.
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMERIC = re.compile(r"[0-9. -]+")
_DIALLED = re.compile(r"[ ().0-9-]+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ADDRESS = re.compile(r"[^\s<>\"'`]+")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8})(?![A-Z0-9])")


def _automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    anchors.add_word("@", "at")
    anchors.add_word("://", "scheme")
    for digit in "0123456789":
        anchors.add_word(digit, "digit")
        anchors.add_word("+" + digit, "plus")
    for cue in ACCOUNT_CUES:
        anchors.add_word(cue, "account")
    anchors.make_automaton()
    return anchors


_ANCHORS = _automaton()


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` in code points, by kind and then start.

    Base kinds are the leftmost non-overlapping matches of their patterns, kind
    by kind; a match that fails its test is dropped, and its signs stay used.
    Added: ``url``, an address with a user before its host, and ``account``, an
    IBAN with right check digits after its cue.
    """
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_end = numeric_end = 0
    for last, anchor in _ANCHORS.iter(text):
        if anchor == "digit":
            if last >= numeric_end:
                numeric_end = _numbers(text, last, found)
        elif anchor == "at":
            span = _email(text, last, email_end)
            if span:
                found["email"].append(span)
                email_end = span[1]
        elif anchor == "plus":
            span = _phone(text, last - 1)
            if span:
                found["phone"].append(span)
        elif anchor == "scheme":
            span = _personal_address(text, last - 2)
            if span:
                found["url"].append(span)
        else:
            span = _account(text, last + 1)
            if span:
                found["account"].append(span)
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """From an at-sign: left over the local part, right over two labels or more."""
    start = at
    while start > floor and _LOCAL_END.match(text, start - 1):
        start -= 1
    label = _LABEL.match(text, at + 1)
    if start == at or not label:
        return None
    end = first = label.end()
    while text.startswith(".", end) and (label := _LABEL.match(text, end + 1)):
        end = label.end()
    return (start, end) if end > first else None


def _numbers(text: str, start: int, found: dict) -> int:
    """Addresses and cards in a run of digits, dots, spaces and hyphens; returns its end."""
    run = _NUMERIC.match(text, start)
    groups = [m.span() for m in _DIGITS.finditer(text, start, run.end())]
    gaps = [text[a[1] : b[0]] for a, b in zip(groups, groups[1:], strict=False)]
    at = 0
    while at + 3 < len(groups):
        if gaps[at : at + 3] != [".", ".", "."]:
            at += 1
            continue
        quad = groups[at : at + 4]
        if all(_at_most_255(text[a:b]) for a, b in quad):
            found["ip"].append((quad[0][0], quad[3][1]))
        at += 4
    at = 0
    while at < len(groups):
        to = at
        while to < len(gaps) and gaps[to] in (" ", "-"):
            to += 1
        digits = sum(b - a for a, b in groups[at : to + 1])
        if 16 <= digits <= 19 and _luhn("".join(text[a:b] for a, b in groups[at : to + 1])):
            found["card"].append((groups[at][0], groups[to][1]))
        at = to + 1
    return run.end()


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    """From a plus sign and a digit: to the last digit of the run, one sign or more between."""
    run = _DIALLED.match(text, plus + 2)
    if not run:
        return None
    end = run.end()
    while end > plus + 3 and not "0" <= text[end - 1] <= "9":
        end -= 1
    if end <= plus + 3:
        return None
    # A 16th digit decides, however long the run is.
    digits = sum(1 for _ in islice(_DIGIT.finditer(text, plus, end), 16))
    return (plus, end) if 8 <= digits <= 15 else None


def _personal_address(text: str, colon: int) -> tuple[int, int] | None:
    """From ``://``: an address whose part before the path names a user."""
    start = colon
    while start > 0 and text[start - 1] in _SCHEME and colon - start < 16:
        start -= 1
    run = _ADDRESS.match(text, colon + 3)
    if start == colon or not run:
        return None
    host = re.split(r"[/?#]", run.group(), maxsplit=1)[0]
    user, at, rest = host.rpartition("@")
    if not (user and at and _LABEL.match(rest)):
        return None
    return start, colon + 3 + len(run.group().rstrip(".,;:!?)]}"))


def _account(text: str, after: int) -> tuple[int, int] | None:
    """After a cue: an IBAN of 15 to 34 signs with the right remainder."""
    number = _IBAN.match(text, after)
    if not number:
        return None
    signs = number.group(1).replace(" ", "")
    turned = "".join(str(int(c, 36)) for c in signs[4:] + signs[:4])
    return number.span(1) if 15 <= len(signs) <= 34 and int(turned) % 97 == 1 else None


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with each span replaced by its kind in angle brackets.

    Of overlapping spans the first, and of those the longest, names the mask;
    all of them are hidden.
    """
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.ArrayType(SPAN))
def _spans(texts: pd.Series) -> pd.Series:
    names = ("kind", "start", "end")
    return texts.map(lambda t: [dict(zip(names, s, strict=True)) for s in find_spans(t)])


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: masked(t, find_spans(t)))


def personal_spans(text_col: str = "text") -> Column:
    """Spans of each whole text; a null or empty text has none."""
    return _spans(whole_text(text_col))


def mask_personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked; rows, columns, null and empty texts stay."""
    text = F.when(column(text_col).isNotNull(), _masked(whole_text(text_col)))
    fields = [
        text.alias(c) if c == text_col else column(c) for c in docs.columns
    ]
    return docs.select(*fields)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", personal_spans().alias("found"))
    joined = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    kinds = ", ".join(f"'{k}'" for k in BASE_KINDS)
    base = joined.format(f"filter(found, s -> s.kind IN ({kinds}))")
    counts = [
        F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
        for k in BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(base).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format("found")).alias("spans"),
    )
