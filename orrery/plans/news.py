"""Registered queries on cleaning and on news statistics."""

from pyspark.sql import functions as F

from orrery.operators import cleaning as C
from orrery.operators import relational as R
from orrery.operators import stats as S
from orrery.session import table

PROVIDERS = ["누리샘일보", "가온담매일", "다솔결경제", "Saebom Daily"]


def _news(spark, d):
    return table(spark, d, "news_articles")


def c1_sanitize(spark, d):
    n = _news(spark, d)
    return n.select("news_id", "ingested_at", F.md5(C.sanitized(F.col("content"))).alias("digest"))


def c9_relevant(spark, d):
    n = _news(spark, d).withColumn("s", C.sanitized(F.col("content")))
    return n.where(C.relevant(F.col("title"), F.col("content"), F.col("s"))).select("news_id", "ingested_at")


def c10_dedup(spark, d):
    return C.dedup(_news(spark, d)).select("provider", "news_id")


def c_pipeline(spark, d):
    return C.clean(_news(spark, d)).select("provider", "news_id", F.length("content").alias("n_chars"))


def c11_changed(spark, d):
    return C.changed_rows(_news(spark, d))


def c13_rule_counts(spark, d):
    return C.rule_counts(_news(spark, d))


def g1_by_provider(spark, d):
    return _news(spark, d).groupBy("provider").agg(F.count("*").alias("n"))


def g2_duplicates(spark, d):
    return _news(spark, d).agg(F.count("news_id").alias("n"), F.count_distinct("news_id").alias("ids"), (F.count("news_id") - F.count_distinct("news_id")).alias("again"))


def g3_range(spark, d):
    return _news(spark, d).groupBy("provider").agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"))


def g5_nulls(spark, d):
    return _news(spark, d).agg(F.count_if(F.col("byline").isNull()).alias("no_byline"), F.count_if(F.col("published_at").isNull()).alias("no_date"), F.count_if(F.col("content").isNull() | (F.col("content") == "")).alias("no_content"))


def g6_keyword_trend(spark, d):
    return S.keyword_trend(_news(spark, d), "published_at", "content", {"kw_ai": "인공지능", "kw_budget": "예산", "kw_chip": "반도체", "kw_privacy": "개인정보"})


def g7_provider_month(spark, d):
    return _news(spark, d).where("published_at is not null").groupBy("provider", S.month(F.col("published_at")).alias("month")).agg(F.count("*").alias("n"))


def g7_provider_year(spark, d):
    return _news(spark, d).where("published_at is not null").groupBy("provider", F.year("published_at").alias("year")).agg(F.count("*").alias("n"))


def g8_filled_months(spark, d):
    return S.filled_months(_news(spark, d), "published_at")


def w2_moving_mean(spark, d):
    return S.filled_months(_news(spark, d), "published_at").withColumn("mean", S.trailing_mean("n", "month", 12)).withColumn("full_mean", S.trailing_mean("n", "month", 6, full_only=True))


def w4_cumulative(spark, d):
    return S.filled_months(_news(spark, d), "published_at").withColumn("running", S.running_sum("n", "month"))


def g9_matrix(spark, d):
    n = _news(spark, d).where("published_at is not null").withColumn("year", F.year("published_at"))
    m = S.matrix(n, "year", "provider", PROVIDERS)
    return m.select("year", *[F.col(f"`{p}`").alias(f"p{i}") for i, p in enumerate(PROVIDERS)])


def g11_event_window(spark, d):
    return S.event_window(_news(spark, d), "published_at", "provider", "2021-06-15", 6)


def g11_event_overall(spark, d):
    return S.event_window(_news(spark, d), "published_at", None, "2021-06-15", 6)


def g15_annualised(spark, d):
    n = _news(spark, d).where("published_at is not null").groupBy("provider").agg(F.count("*").alias("n"), F.datediff(F.max("published_at"), F.min("published_at")).alias("days"))
    return n.select("provider", S.annualised(F.col("n"), F.col("days")).alias("per_year"))


def k2_first_wins(spark, d):
    n = _news(spark, d).select("news_id", "title", "ingested_at")
    old = n.where("ingested_at < timestamp '2021-01-01'")
    old = R.keep_first(old, ["news_id"], F.col("ingested_at").asc())
    return R.insert_or_ignore(old, n.where("ingested_at >= timestamp '2021-01-01'"), ["news_id"], "ingested_at").select("news_id", "ingested_at")


def k3_last_wins(spark, d):
    n = _news(spark, d).select("news_id", "title", "ingested_at")
    old = R.keep_first(n.where("ingested_at < timestamp '2021-01-01'"), ["news_id"], F.col("ingested_at").asc())
    return R.insert_or_replace(old, n.where("ingested_at >= timestamp '2021-01-01'"), ["news_id"], "ingested_at").select("news_id", "ingested_at")



QUERIES = {f.__name__: f for f in (c1_sanitize, c9_relevant, c10_dedup, c_pipeline, c11_changed, c13_rule_counts, g1_by_provider, g2_duplicates, g3_range, g5_nulls, g6_keyword_trend, g7_provider_month, g7_provider_year, g8_filled_months, w2_moving_mean, w4_cumulative, g9_matrix, g11_event_window, g11_event_overall, g15_annualised, k2_first_wins, k3_last_wins)}

_S = "replace(replace(regexp_replace(content, '[^\\n]*(AI ?앵커|AI가 대체 못 하는)[^\\n]*', '', 'g'), '(AI학습 포함)', ''), '(AI 학습 포함)', '')"
_AI = [r"(?i)(^|[^A-Za-z0-9])AI([^A-Za-z0-9]|$)", r"(?i)(^|[^A-Za-z0-9])A\.I\.?([^A-Za-z0-9]|$)"]


def _any(words, *cols):
    return "(" + " OR ".join(f"{c} ILIKE '%{w}%'" for w in words for c in cols) + ")"


_RULES = {
    "keyword": "(" + _any(C.KEYWORDS, "s", "title") + "".join(f" OR regexp_matches({c}, '{p}')" for p in _AI for c in ("s", "title")) + ")",
    "foreign": "NOT (length(content) > 200 AND CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[가-힣]', '', 'g'))::DOUBLE / length(content) END > 0.95)",
    "homonym": "NOT (" + _any(C.HOMONYMS, "content", "title") + " AND NOT " + _any(C.KEYWORDS, "content", "title") + ")",
    "ad": "NOT " + _any((C.AD,), "content", "title"),
    "ad_groups": "NOT (" + " AND ".join(_any(g, "content") for g in C.AD_GROUPS) + ")",
    "stub": "NOT (regexp_replace(content, '\\s+', '', 'g') = '[사진기사]')",
}
_ALL = " AND ".join(f"({x})" for x in _RULES.values())
_BASE = f"WITH b AS (SELECT *, {_S} AS s FROM news_articles)"
_RANK = "row_number() OVER (PARTITION BY provider, md5(regexp_replace(content, '\\s+', '', 'g')) ORDER BY published_at ASC NULLS LAST, byline IS NULL, provider_link_page IS NULL, news_id ASC NULLS LAST)"
_RANK_S = _RANK.replace("content", "s")
_MONTHS = """WITH c AS (SELECT date_trunc('month', published_at)::DATE AS m, count(*) AS n FROM news_articles WHERE published_at IS NOT NULL GROUP BY 1),
e AS (SELECT unnest(generate_series((SELECT min(m) FROM c)::TIMESTAMP, (SELECT max(m) FROM c)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m),
f AS (SELECT strftime(e.m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (m))"""


def _event(by):
    key, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH r AS (SELECT {key} strftime(published_at, '%Y-%m') AS ym FROM news_articles WHERE published_at >= DATE '2021-06-15' - INTERVAL 6 MONTH AND published_at < DATE '2021-06-15' + INTERVAL 6 MONTH),
a AS (SELECT {key} count(*) FILTER (ym < '2021-06') AS n_before, count(*) FILTER (ym >= '2021-06') AS n_after, count(DISTINCT ym) FILTER (ym < '2021-06') AS months_before, count(DISTINCT ym) FILTER (ym >= '2021-06') AS months_after FROM r {group}),
m AS (SELECT *, CASE WHEN months_before > 0 THEN n_before / months_before ELSE 0.0::DOUBLE END AS avg_before, CASE WHEN months_after > 0 THEN n_after / months_after ELSE 0.0::DOUBLE END AS avg_after FROM a)
SELECT *, CASE WHEN avg_before <> 0 THEN (avg_after - avg_before) * 100.0 / avg_before ELSE 'nan'::DOUBLE END AS pct FROM m"""


SQL = {
    "c1_sanitize": f"SELECT news_id, ingested_at, md5({_S}) AS digest FROM news_articles",
    "c9_relevant": f"{_BASE} SELECT news_id, ingested_at FROM b WHERE {_ALL}",
    "c10_dedup": f"SELECT provider, news_id FROM news_articles QUALIFY {_RANK} = 1",
    "c_pipeline": f"{_BASE}, k AS (SELECT * FROM b WHERE {_ALL}) SELECT provider, news_id, length(s) AS n_chars FROM k QUALIFY {_RANK_S} = 1",
    "c11_changed": f"SELECT provider, count(*) AS n_total, count(*) FILTER (content <> {_S}) AS n_changed FROM news_articles GROUP BY 1",
    "c13_rule_counts": f"{_BASE} SELECT provider, count(*) AS n, " + ", ".join(f"count(*) FILTER ({x}) AS {k}_ok" for k, x in _RULES.items()) + f", count(*) FILTER ({_ALL}) AS all_ok FROM b GROUP BY 1",
    "g1_by_provider": "SELECT provider, count(*) AS n FROM news_articles GROUP BY 1",
    "g2_duplicates": "SELECT count(news_id) AS n, count(DISTINCT news_id) AS ids, count(news_id) - count(DISTINCT news_id) AS again FROM news_articles",
    "g3_range": "SELECT provider, min(published_at) AS first, max(published_at) AS last FROM news_articles GROUP BY 1",
    "g5_nulls": "SELECT count(*) FILTER (byline IS NULL) AS no_byline, count(*) FILTER (published_at IS NULL) AS no_date, count(*) FILTER (content IS NULL OR content = '') AS no_content FROM news_articles",
    "g6_keyword_trend": "SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS n, " + ", ".join(f"count(*) FILTER (content ILIKE '%{w}%') AS {k}" for k, w in (("kw_ai", "인공지능"), ("kw_budget", "예산"), ("kw_chip", "반도체"), ("kw_privacy", "개인정보"))) + " FROM news_articles WHERE published_at IS NOT NULL GROUP BY 1",
    "g7_provider_month": "SELECT provider, strftime(published_at, '%Y-%m') AS month, count(*) AS n FROM news_articles WHERE published_at IS NOT NULL GROUP BY 1, 2",
    "g7_provider_year": "SELECT provider, year(published_at)::INT AS year, count(*) AS n FROM news_articles WHERE published_at IS NOT NULL GROUP BY 1, 2",
    "g8_filled_months": f"{_MONTHS} SELECT month, n FROM f",
    "w2_moving_mean": f"{_MONTHS} SELECT month, n, avg(n) OVER (ORDER BY month ROWS 11 PRECEDING) AS mean, CASE WHEN count(*) OVER (ORDER BY month ROWS 5 PRECEDING) = 6 THEN avg(n) OVER (ORDER BY month ROWS 5 PRECEDING) END AS full_mean FROM f",
    "w4_cumulative": f"{_MONTHS} SELECT month, n, (sum(n) OVER (ORDER BY month))::BIGINT AS running FROM f",
    "g9_matrix": "SELECT year(published_at)::INT AS year, " + ", ".join(f"count(*) FILTER (provider = '{p}') AS p{i}" for i, p in enumerate(PROVIDERS)) + " FROM news_articles WHERE published_at IS NOT NULL AND provider IN (" + ", ".join(f"'{p}'" for p in PROVIDERS) + ") GROUP BY 1",
    "g11_event_window": _event("provider"),
    "g11_event_overall": _event(""),
    "g15_annualised": "SELECT provider, CASE WHEN max(published_at)::DATE > min(published_at)::DATE THEN round(count(*) * 365.0::DOUBLE / (max(published_at)::DATE - min(published_at)::DATE))::BIGINT END AS per_year FROM news_articles WHERE published_at IS NOT NULL GROUP BY 1",
    "k2_first_wins": "SELECT news_id, ingested_at FROM news_articles WHERE ingested_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY ingested_at) = 1",
    "k3_last_wins": "SELECT news_id, ingested_at FROM (SELECT *, max(ingested_at) OVER (PARTITION BY news_id) >= TIMESTAMP '2021-01-01' AS late FROM news_articles WHERE ingested_at IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY CASE WHEN late THEN -epoch_us(ingested_at) ELSE epoch_us(ingested_at) END) = 1",
}
