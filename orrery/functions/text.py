"""Scalar text operators."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MENTION = r"인공\s*지능|(?<![A-Za-z])AI(?![A-Za-z])|A\.I\.?"
SHORT_LAWS = {
    "인공지능 발전과 신뢰 기반 조성 등에 관한 기본법": "AI 기본법",
    "인공지능산업 육성 및 신뢰 확보에 관한 법률": "AI 산업육성법",
    "인공지능 산업 육성 및 신뢰 확보에 관한 법률": "AI 산업육성법",
    "정보통신망 이용촉진 및 정보보호 등에 관한 법률": "정통망법",
    "개인정보 보호법": "개인정보보호법",
    "전자상거래 등에서의 소비자보호에 관한 법률": "전자상거래소비자보호법",
    "공공데이터의 제공 및 이용 활성화에 관한 법률": "공공데이터법",
    "식품 등의 표시ㆍ광고에 관한 법률": "식품표시광고법",
    "분산에너지 활성화 특별법": "분산에너지특별법",
    "초·중등교육법": "초중등교육법",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def mapped(c: Column, values: dict[str, str]) -> Column:
    """Through a literal map; unknown values stay as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), c)


def base_law(title: Column) -> Column:
    """A bill's law: the words for amendment and enactment taken off, the ending made that of a law, spaces collapsed."""
    t = F.replace(F.replace(F.replace(title, F.lit(" 일부개정법률안"), F.lit("")), F.lit(" 전부개정법률안"), F.lit("")), F.lit(" 제정안"), F.lit(""))
    t = F.regexp_replace(F.replace(t, F.lit("법률안"), F.lit("법")), r"법안\z", "법")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def short_law(law: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SHORT_LAWS.items() for x in kv]), law), F.substring(law, 1, 20))


def mentions(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MENTION))


def title_has_keyword(c: Column) -> Column:
    return c.rlike(r"(?i)\bAI\b|artificial intelligence|\bA\.I\.|인공지능")


def prompt_text(title: Column, body: Column, limit: int) -> Column:
    return F.concat(F.lit("법안명: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(body, F.lit("")), 1, limit))


def reason_section(text: Column) -> Column:
    """What stands behind the heading of the reasons, to the end; empty without the heading."""
    return F.trim(F.regexp_extract(text, r"(?s)제\s*안\s*이\s*유(?:\s*및\s*주\s*요\s*내\s*용)?\s*(.+)\z", 1))


def digest16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def id_to_file(bill_id: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(bill_id, r"\.", ""), r"\s+", "_")


def file_to_id(name: Column) -> Column:
    """`HR_12.txt`, `S_3.txt`, `HJRes_4.txt` as `H.R. 12`, `S. 3`, `H.J.Res. 4`."""
    n = F.regexp_extract(name, r"_(\d+)\.[A-Za-z]+\z", 1)
    kind = F.regexp_extract(name, r"^(?:.*/)?([A-Za-z]+)_", 1)
    spelled = mapped(kind, {"HR": "H.R.", "S": "S.", "HJRes": "H.J.Res.", "SJRes": "S.J.Res.", "HRes": "H.Res.", "SRes": "S.Res."})
    return F.concat_ws(" ", spelled, n)


def strip_markup(c: Column) -> Column:
    """Text of HTML: scripts, styles and tags out, block ends as newlines, the five basic entities, spaces collapsed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[^\S\n]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All HTML entities, in batches; `strip_markup` alone covers the usual ones inside the JVM."""
    return s.map(html.unescape, na_action="ignore")
