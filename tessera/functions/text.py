"""Text rules as Column expressions; Unicode normal forms as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def grounded(value: Column, query: Column) -> Column:
    """value occurs in query, whatever the white space; empty values do not."""
    v = without_space(value)
    return (F.length(v) > 0) & without_space(query).contains(v)


def visible_chars(text: Column) -> Column:
    return F.length(without_space(text))


def clean_lines(text: Column) -> Column:
    """Line ends as \\n, no control characters but tab and \\n, no blanks at line ends."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(t, "(?m)[ \t]+$", "")


def title_of(text: Column, n: int = 40) -> Column:
    return F.substring(F.trim(text), 1, n)


def safe_value(text: Column, pattern: str = r"^[A-Za-z0-9_.:/ -]{0,80}\z") -> Column:
    return F.when(text.rlike(pattern), text).otherwise("[redacted]")


def groups_hit(answer: Column, groups: Column) -> Column:
    """Each group of alternatives (array<array<string>>) has a member in answer."""
    return F.forall(groups, lambda g: F.exists(g, lambda w: answer.contains(w)))


def leaks(raw: Column, secret: str) -> Column:
    """secret stands in raw, as it is or URL-encoded."""
    return raw.contains(secret) | F.coalesce(F.try_url_decode(raw).contains(secret), F.lit(False))


# What a block of context says of its text.
TITLE, PLACE, HEADING, CONTENT, NOWHERE, IN_SECTIONS = "공고: ", "위치: ", "문단 제목: ", "내용:", "위치 정보 없음", "HWPX "


def numbered_context(blocks: Column) -> Column:
    """E1..En blocks of an ordered array of (title, place, headings, text), an empty line between; what is missing is a dash."""

    def block(x: Column, k: Column) -> Column:
        title = F.when(F.length(x["title"]) > 0, x["title"]).otherwise("-")
        heading = F.when(F.size(x["headings"]) > 0, F.array_join(x["headings"], " > ")).otherwise("-")
        return F.concat_ws("\n", F.concat(F.lit("[E"), (k + 1).cast("string"), F.lit("]")), F.concat(F.lit(TITLE), title), F.concat(F.lit(PLACE), x["place"]), F.concat(F.lit(HEADING), heading), F.lit(CONTENT), x["text"])

    return F.array_join(F.transform(blocks, block), "\n\n")


def location(pages: Column, sections: Column) -> Column:
    """Where a text stands: its pages, else the sections of its provenance, each once and in order."""
    named = F.array_join(F.array_sort(F.array_distinct(F.filter(sections, lambda s: F.length(s) > 0))), ", ")
    listed = F.concat(F.lit("p."), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "))
    return F.when(F.size(pages) > 0, listed).when(F.length(named) > 0, F.concat(F.lit(IN_SECTIONS), named)).otherwise(NOWHERE)


# Kinds of critical tokens, first come first served, with the expressions that must match.
CRITICAL = (
    ("date", r"\d{4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*일?|\d{1,2}\s*[./]\s*\d{1,2}\s*\.?\s*\([월화수목금토일]\)"),
    ("period", r"\d+(?:\.\d+)?\s*(?:개월|년간|주간|일간|시간|년|주)"),
    ("amount", r"\d[\d,]*(?:\.\d+)?\s*(?:조|억|천만|백만|만|천)?\s*원"),
    ("percent", r"\d+(?:\.\d+)?\s*(?:%|％|퍼센트)"),
    ("number", r"\d[\d,]*(?:\.\d+)?"),
)


def found_tokens(text: str | None) -> list[tuple[str, str]]:
    """(kind, token without white space) in NFKC text. What overlaps a token of an earlier kind is skipped whole."""
    plain, taken, out = unicodedata.normalize("NFKC", text or ""), [], []
    if not any(map(str.isdigit, plain)):
        return out
    for kind, pattern in CRITICAL:
        held = [m for m in re.finditer(pattern, plain) if not any(m.start() < end and start < m.end() for start, end in taken)]
        taken += [m.span() for m in held]
        out += [(kind, re.sub(r"\s+", "", m.group())) for m in held]
    return out


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("token", StringType())])))
def critical_tokens(texts: pd.Series) -> pd.Series:
    """array<struct<kind, token>>. Positions decide what is skipped, which regular expression functions do not return."""
    return texts.map(lambda t: [{"kind": k, "token": x} for k, x in found_tokens(t)])
