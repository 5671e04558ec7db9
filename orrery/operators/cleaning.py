"""Rule-based cleaning of news rows: sanitizing, relevance, window dedup, and measures of both."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the cleaning rules.
FOOTER = "(AI ?앵커|AI가 대체 못 하는)"
LITERALS = ("(AI학습 포함)", "(AI 학습 포함)")
KEYWORDS = ("인공지능", "인공 지능")
ACRONYMS = (r"(?i)(^|[^A-Za-z0-9])AI([^A-Za-z0-9]|$)", r"(?i)(^|[^A-Za-z0-9])A\.I\.?([^A-Za-z0-9]|$)")
HOMONYMS = ("조류인플루엔자", "조류 인플루엔자")
AD = "사이버대학"
AD_GROUPS = (("문의", "입학처"), ("모집요강", "원서접수", "접수마감"), ("장학금", "등록금"))
STUB = "[사진기사]"
FOREIGN_LENGTH, FOREIGN_SHARE = 200, 0.95


def sanitized(content: Column) -> Column:
    """Lines with a footer phrase emptied (their newline stays), fixed phrases removed.

    Written line by line behind a test of the whole text: one pattern with any text on both sides of the phrase takes a
    time quadratic in the length of a line."""
    lines = F.array_join(F.transform(F.split(content, "\n"), lambda x: F.when(x.rlike(FOOTER), "").otherwise(x)), "\n")
    out = F.when(content.rlike(FOOTER), lines).otherwise(content)
    for x in LITERALS:
        out = F.when(content.contains(x), F.replace(out, F.lit(x), F.lit(""))).otherwise(out)
    return out


def has_any(words, *cols: Column) -> Column:
    """Whether any of the words stands in any of the columns, whatever the case; null where SQL's OR gives null."""
    out = None
    for w in words:
        for c in cols:
            x = c.ilike(f"%{w}%")
            out = x if out is None else out | x
    return out


@dataclass(frozen=True)
class Rule:
    """A named predicate over (title, raw content, sanitized content); `keep` rules must hold, the others must not."""

    name: str
    keep: bool
    build: object

    def column(self, t: Column, r: Column, s: Column) -> Column:
        c = self.build(t, r, s)
        return c if self.keep else ~c


def _keyword(t, r, s):
    out = has_any(KEYWORDS, s, t)
    for p in ACRONYMS:
        out = out | s.rlike(p) | t.rlike(p)
    return out


def _foreign(t, r, s):
    # The division is guarded by the length test; Spark evaluates it for short rows too, so it must not divide by zero.
    share = F.try_divide(F.length(F.regexp_replace(r, "[가-힣]", "")).cast("double"), F.length(r).cast("double"))
    return (F.length(r) > FOREIGN_LENGTH) & (share > FOREIGN_SHARE)


def _homonym(t, r, s):
    return has_any(HOMONYMS, r, t) & ~has_any(KEYWORDS, r, t)


def _groups(t, r, s):
    out = None
    for g in AD_GROUPS:
        out = has_any(g, r) if out is None else out & has_any(g, r)
    return out


RULES = (
    Rule("keyword", True, _keyword),
    Rule("foreign", False, _foreign),
    Rule("homonym", False, _homonym),
    Rule("ad", False, lambda t, r, s: has_any((AD,), r, t)),
    Rule("ad_groups", False, _groups),
    Rule("stub", False, lambda t, r, s: F.regexp_replace(r, r"\s+", "") == STUB),
)


def relevant(title: Column, raw: Column, clean: Column, rules=RULES) -> Column:
    """All rules together, in three-valued logic: rows for which a rule is null don't pass."""
    out = F.lit(True)
    for rule in rules:
        out = out & rule.column(title, raw, clean)
    return out


def dedup(news: DataFrame) -> DataFrame:
    """One row per provider and whitespace-free content: the earliest published, undated last, then rows with a byline, with
    a link, and the smaller id."""
    w = Window.partitionBy("provider", F.md5(F.regexp_replace("content", r"\s+", ""))).orderBy(
        F.col("published_at").asc_nulls_last(), F.col("byline").isNull(), F.col("provider_link_page").isNull(), F.col("news_id").asc_nulls_last()
    )
    return news.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean(news: DataFrame, rules=RULES) -> DataFrame:
    """The whole pipeline: sanitized content, relevant rows, one row per copy."""
    s = news.withColumn("_clean", sanitized(F.col("content")))
    s = s.where(relevant(F.col("title"), F.col("content"), F.col("_clean"), rules))
    return dedup(s.drop("content").withColumnRenamed("_clean", "content"))


def rule_counts(news: DataFrame, rules=RULES) -> DataFrame:
    """Per provider: rows, rows that each rule lets pass, and rows that pass all."""
    t, r, s = F.col("title"), F.col("content"), sanitized(F.col("content"))
    passed = [F.count_if(x.column(t, r, s)).alias(f"{x.name}_ok") for x in rules]
    return news.groupBy("provider").agg(F.count("*").alias("n"), *passed, F.count_if(relevant(t, r, s, rules)).alias("all_ok"))


def changed_rows(news: DataFrame) -> DataFrame:
    """Per provider: rows, and rows that sanitizing changes."""
    return news.groupBy("provider").agg(F.count("*").alias("n_total"), F.count_if(F.col("content") != sanitized(F.col("content"))).alias("n_changed"))


def ruleset_version(day: str, rules=RULES) -> str:
    """A name of the rule set: day, and digests of what sanitizes and of what filters."""
    short = lambda s: hashlib.md5(s.encode()).hexdigest()[:8]
    fixed = repr((KEYWORDS, ACRONYMS, HOMONYMS, AD, AD_GROUPS, STUB, FOREIGN_LENGTH, FOREIGN_SHARE))
    return f"{day}-{short(FOOTER + repr(LITERALS))}-{short(fixed + ','.join(r.name for r in rules))}"


def count_drift(got: dict[str, int], expected: dict[str, int], tolerance: float = 0.01) -> list[str]:
    """Names whose count is missing or off by more than the tolerance."""
    return [k for k, n in expected.items() if abs(got.get(k, 0) - n) > tolerance * n]
