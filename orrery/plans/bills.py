"""Registered queries on bills, votes, members and labels."""

from pyspark.sql import functions as F

from orrery.functions import age as A
from orrery.functions import text as X
from orrery.functions.dates import loose_date
from orrery.operators import relational as R
from orrery.operators import stats as S
from orrery.session import null_safe_key, table


def _t(spark, d, name):
    return table(spark, d, name)


def _bills(spark, d):
    """One row per bill: the record fetched last."""
    return R.keep_first(_t(spark, d, "v_bill").where("bill_id is not null"), ["bill_id"], F.col("fetched_at").desc_nulls_last(), F.col("bill_no").asc_nulls_last(), F.col("bill_name").asc_nulls_last())


def _labels(spark, d):
    return _t(spark, d, "bill_classifications").withColumn("attr", F.lower(F.trim("primary_attr")))


def p1_views(spark, d):
    return _t(spark, d, "v_bill").select("bill_id", F.col("age").cast("string").alias("age_text"), loose_date(F.col("propose_date")).alias("proposed"), F.coalesce("committee", F.lit("")).alias("committee"))


def view_vote_days(spark, d):
    return _t(spark, d, "v_vote").groupBy(loose_date(F.col("vote_date")).alias("day")).agg(F.count("*").alias("n"))


def vote_summary(spark, d):
    """Per bill: voters and conditional sums, one pass."""
    v = _t(spark, d, "v_vote").where("bill_id is not null")
    return v.groupBy(null_safe_key(F.col("bill_id")).alias("bill_id")).agg(
        F.count("*").alias("vote_total"), F.count_if(F.col("vote_result") == "찬성").alias("yes_count"), F.count_if(F.col("vote_result") == "반대").alias("no_count"), F.count_if(F.col("vote_result") == "기권").alias("abstain_count"), F.count_distinct("mona_cd").alias("member_total")
    )


def keep_latest_bill(spark, d):
    return _bills(spark, d).select("bill_id", "fetched_at")


def j1_votes_members(spark, d):
    v = _t(spark, d, "v_vote").select("mona_cd", "vote_result")
    return v.join(_t(spark, d, "v_member").select("mona_cd", "gender"), "mona_cd").groupBy("gender", "vote_result").agg(F.count("*").alias("n"))


def j2_residual(spark, d):
    b, c = _bills(spark, d).select(null_safe_key(F.col("bill_id")).alias("k"), "age"), _labels(spark, d)
    return c.join(b, (null_safe_key(c["bill_id"]) == b["k"]) & (b["age"] >= 21) & c["source"].startswith("kr_")).groupBy("age", "attr").agg(F.count("*").alias("n"))


def j3_text_of_bills(spark, d):
    t = _t(spark, d, "bill_text").groupBy(null_safe_key(F.col("bill_id")).alias("bill_id")).agg(F.max(F.length("full_text")).alias("n_chars"))
    return _bills(spark, d).select(null_safe_key(F.col("bill_id")).alias("bill_id"), "bill_name").join(t, "bill_id", "left")


def j4_todo(spark, d):
    """Bills without a label of the newest prompt version."""
    c = _labels(spark, d)
    newest = R.latest_version(c, "prompt_version", "classified_at").select("prompt_version")
    done = c.join(F.broadcast(newest), "prompt_version").select(null_safe_key(F.col("bill_id")).alias("bill_id")).where("bill_id is not null")
    return R.todo(_bills(spark, d).select(null_safe_key(F.col("bill_id")).alias("bill_id")), done, ["bill_id"])


def g12_latest_version(spark, d):
    return R.latest_version(_labels(spark, d), "prompt_version", "classified_at")


def j5_semi(spark, d):
    return R.keep_known(_t(spark, d, "bill_text").select(null_safe_key(F.col("bill_id")).alias("bill_id")).distinct(), _bills(spark, d).select(null_safe_key(F.col("bill_id")).alias("bill_id")), "bill_id")


def j6_computed_key(spark, d):
    b = _bills(spark, d).select(F.concat(F.lit("kr:"), null_safe_key(F.col("bill_id"))).alias("k"), "committee")
    c = _labels(spark, d).where(F.col("source").startswith("kr_")).select(F.concat(F.lit("kr:"), null_safe_key(F.col("bill_id"))).alias("k"), "attr")
    return b.join(c, "k").groupBy("committee", "attr").agg(F.count("*").alias("n"))


def j8_defaults(spark, d):
    m = _t(spark, d, "v_member").select(F.col("mona_cd").alias("lead_mona_cd"), "party")
    return _bills(spark, d).join(m, "lead_mona_cd", "left").select("bill_id", F.coalesce("party", F.lit("미상")).alias("party"))


def j9_parties(spark, d):
    return R.names_to_members(_bills(spark, d), _t(spark, d, "v_member")).groupBy("bill_id").agg(F.count("*").alias("n_names"), F.count("party").alias("n_known"), F.count_distinct("party").alias("n_parties"))


def j11_reconcile(spark, d):
    return R.reconcile(_t(spark, d, "bill_text").select(null_safe_key(F.col("bill_id")).alias("bill_id")), _t(spark, d, "v_bill").select(null_safe_key(F.col("bill_id")).alias("bill_id")), "bill_id")


def j14_bill_view(spark, d):
    k = null_safe_key(F.col("bill_id")).alias("bill_id")
    t = _t(spark, d, "bill_text").groupBy(k).agg(F.max(F.length("reason_and_content")).alias("reason_chars"))
    c = _labels(spark, d).where(F.col("source").startswith("kr_") & F.col("bill_id").isNotNull()).withColumn("k", null_safe_key(F.col("bill_id")))
    c = c.groupBy("k").agg(F.max(F.struct("classified_at", "prompt_version", "attr")).alias("m")).select(F.col("k").alias("bill_id"), F.col("m.attr").alias("attr"))
    return _bills(spark, d).select(k, "age").join(t, "bill_id", "left").join(c, "bill_id", "left")


def p9_where_dict(spark, d):
    return _t(spark, d, "chunks").where(R.where_dict({"$and": [{"source": "bill"}, {"age": {"$in": [20, 21]}}], "embed_config_ver": {"$eq": "e0-64"}})).select("chunk_id")


def p11_party_chain(spark, d):
    b = _bills(spark, d).select("bill_id", "lead_mona_cd").where("lead_mona_cd is not null")
    return R.fallback(b, "lead_mona_cd", "party", (_t(spark, d, "v_member"), "mona_cd", "party"), (_t(spark, d, "v_vote"), "mona_cd", "party")).select("bill_id", "party")


def k1_replace_tasks(spark, d):
    v = _t(spark, d, "v_bill").select("bill_id", F.col("age").cast("string").alias("task"), "fetched_at")
    fresh = v.where("task = '22'").withColumn("bill_id", F.concat(F.lit("new_"), "bill_id"))
    return R.replace_tasks(v, fresh, "task").groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("bill_id").startswith("new_")).alias("n_new"))


def _doc_rows(spark, d):
    return R.keep_first(_t(spark, d, "document_text").where("doc_id is not null"), ["doc_id", "source"], F.col("fetched_at").asc_nulls_last(), F.col("status").asc_nulls_last(), F.length("full_text").asc_nulls_last())


def k5_conditional_upsert(spark, d):
    """Error rows keep the text that is there; other columns take the new value where it isn't null."""
    old = _doc_rows(spark, d).select("doc_id", "source", "status", "title", F.length("full_text").alias("chars"))
    new = old.select("doc_id", "source", F.when(F.length("title") % 2 == 0, "error").otherwise("ok").alias("status"), F.when(F.length("title") % 3 == 0, F.lit("neu")).alias("title"), F.lit(7).alias("chars"))
    text = F.when(F.col("new_status") == "ok", F.coalesce("new_chars", "old_chars")).otherwise(F.col("old_chars"))
    return R.upsert(old, new, ["doc_id", "source"], {"title": R.coalesce_new("title"), "chars": text})


def w6_keep_latest(spark, d):
    b = _bills(spark, d).withColumn("first_name", F.trim(F.substring_index("proposer", ",", 1)))
    return R.keep_latest(b, ["bill_name", "first_name"], "propose_date", "bill_id").select("bill_id")


def g10_share(spark, d):
    return S.share_without(_labels(spark, d), [], "attr")


def g10_share_by_source(spark, d):
    return S.share_without(_labels(spark, d), ["source"], "attr")


def g13_coverage(spark, d):
    total = _bills(spark, d).agg(F.count("*").alias("total"))
    done = _bills(spark, d).select(null_safe_key(F.col("bill_id")).alias("bill_id")).join(_labels(spark, d).select(null_safe_key(F.col("bill_id")).alias("bill_id")), "bill_id", "left_semi").agg(F.count("*").alias("done"))
    return total.crossJoin(done).withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("done"), F.col("total")), F.lit(0.0)))


def g16_top_laws(spark, d):
    b = _bills(spark, d).select(X.short_law(X.base_law(F.col("bill_name"))).alias("law"))
    return S.top_by_count(b, "law", 10)


def g17_gaps(spark, d):
    c = _labels(spark, d)
    return S.gaps(c.where(F.col("source").startswith("kr_")), c.where(~F.col("source").startswith("kr_")), "attr")


def g24_agreement(spark, d):
    c = _labels(spark, d).withColumn("second", F.lower(F.trim("secondary_attr")))
    return S.agreement(c, "attr", "second")


def g25_leaders(spark, d):
    return S.top_by_count(_t(spark, d, "v_vote"), "name", 20)


def g25_committees(spark, d):
    return S.top_by_count(_bills(spark, d), "committee", 10)


def g27_values(spark, d):
    return _t(spark, d, "chunks").groupBy("source", "embed_config_ver").agg(F.count("*").alias("n"))


def a1_terms(spark, d):
    m = _t(spark, d, "v_member").select("mona_cd", F.explode(F.split("terms_list", ",")).alias("term"))
    return m.select("mona_cd", A.term_label(F.col("term")).alias("age")).where("age is not null")


def a4_term_of_date(spark, d):
    return _bills(spark, d).select("bill_id", A.term_of_date(F.col("propose_date")).alias("term"))


def a6_clean_columns(spark, d):
    return _t(spark, d, "bill_classifications").select(X.blank_to_null(F.col("bill_id")).alias("bill_id"), X.blank_to_null(F.col("title")).alias("title"))


def a14_base_law(spark, d):
    return _bills(spark, d).select("bill_id", X.base_law(F.col("bill_name")).alias("law"), X.short_law(X.base_law(F.col("bill_name"))).alias("short"))


def a17_title_keyword(spark, d):
    return _t(spark, d, "news_articles").where(X.title_has_keyword(F.col("title"))).select("news_id", "ingested_at")


QUERIES = {f.__name__: f for f in (
    p1_views, view_vote_days, vote_summary, keep_latest_bill, j1_votes_members, j2_residual, j3_text_of_bills, j4_todo, g12_latest_version, j5_semi, j6_computed_key, j8_defaults, j9_parties, j11_reconcile, j14_bill_view, p9_where_dict, p11_party_chain,
    k1_replace_tasks, k5_conditional_upsert, w6_keep_latest, g10_share, g10_share_by_source, g13_coverage, g16_top_laws, g17_gaps, g24_agreement, g25_leaders, g25_committees, g27_values, a1_terms, a4_term_of_date, a6_clean_columns, a14_base_law, a17_title_keyword,
)}
# Names that begin with pN_ are kept for the training-data problems.
QUERIES = {{"p1_views": "v_bill_typed", "p9_where_dict": "where_dict", "p11_party_chain": "party_fallback"}.get(k, k): f for k, f in QUERIES.items()}

K = r"upper(trim(bill_id, E' \t\n\r'))"


def _day(c):
    return rf"""coalesce(try_strptime(nullif(regexp_extract(trim({c}), '^(\d{{8}})(?:\D|$)', 1), ''), '%Y%m%d')::DATE, try_strptime(nullif(regexp_replace(regexp_extract(trim({c}), '^\d{{4}}\s*(?:[-./]|년)\s*\d{{1,2}}\s*(?:[-./]|월)\s*\d{{1,2}}'), '[^0-9]+', '-', 'g'), ''), '%Y-%m-%d')::DATE)"""


_BILLS = "bills AS (SELECT * FROM v_bill WHERE bill_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY fetched_at DESC NULLS LAST, bill_no NULLS LAST, bill_name NULLS LAST) = 1)"
_LABELS = "labels AS (SELECT *, lower(trim(primary_attr)) AS attr FROM bill_classifications)"
_LAW = r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(bill_name, ' 일부개정법률안', ''), ' 전부개정법률안', ''), ' 제정안', ''), '법률안', '법'), '법안$', '법'), '\s+', ' ', 'g'))"
_SHORT = "CASE " + " ".join(f"WHEN law = '{k}' THEN '{v}'" for k, v in X.SHORT_LAWS.items()) + " WHEN true THEN substr(law, 1, 20) END"
_TERM = "(SELECT count(*) FROM (VALUES " + ", ".join(f"(DATE '{y}-05-30')" for y in A.TERM_YEARS) + ") t(s) WHERE s <= pday)"
_SHARE = "share AS (SELECT {by} attr, count(*) AS n FROM src WHERE attr IS NOT NULL GROUP BY ALL), out AS (SELECT *, CASE WHEN attr <> 'none' THEN 100.0 * n / nullif(sum(n) FILTER (attr <> 'none') OVER ({over}), 0) ELSE 0 END::DOUBLE AS pct FROM share)"
_NAMED = "CASE " + " ".join(f"WHEN t = '{k}' THEN {v}" for k, v in A.NAMED.items())

SQL = {
    "v_bill_typed": f"SELECT bill_id, age::VARCHAR AS age_text, {_day('propose_date')} AS proposed, coalesce(committee, '') AS committee FROM v_bill",
    "view_vote_days": f"SELECT {_day('vote_date')} AS day, count(*) AS n FROM v_vote GROUP BY 1",
    "vote_summary": f"SELECT {K} AS bill_id, count(*) AS vote_total, count(*) FILTER (vote_result = '찬성') AS yes_count, count(*) FILTER (vote_result = '반대') AS no_count, count(*) FILTER (vote_result = '기권') AS abstain_count, count(DISTINCT mona_cd) AS member_total FROM v_vote WHERE bill_id IS NOT NULL GROUP BY 1",
    "keep_latest_bill": f"WITH {_BILLS} SELECT bill_id, fetched_at FROM bills",
    "j1_votes_members": "SELECT m.gender, vote_result, count(*) AS n FROM v_vote JOIN v_member m USING (mona_cd) GROUP BY 1, 2",
    "j2_residual": f"WITH {_BILLS}, {_LABELS} SELECT b.age, attr, count(*) AS n FROM labels c JOIN bills b ON {K.replace('bill_id', 'c.bill_id')} = {K.replace('bill_id', 'b.bill_id')} AND b.age >= 21 AND c.source LIKE 'kr\\_%' ESCAPE '\\' GROUP BY 1, 2",
    "j3_text_of_bills": f"WITH {_BILLS}, t AS (SELECT {K} AS k, max(length(full_text)) AS n_chars FROM bill_text GROUP BY 1) SELECT {K} AS bill_id, bill_name, n_chars FROM bills LEFT JOIN t ON {K} = k",
    "j4_todo": f"WITH {_BILLS}, {_LABELS} SELECT {K} AS bill_id FROM bills b WHERE NOT EXISTS (SELECT 1 FROM labels c WHERE {K.replace('bill_id', 'c.bill_id')} = {K.replace('bill_id', 'b.bill_id')} AND c.prompt_version = (SELECT prompt_version FROM labels WHERE prompt_version IS NOT NULL GROUP BY 1 ORDER BY max(classified_at) DESC NULLS LAST, prompt_version DESC LIMIT 1))",
    "g12_latest_version": f"WITH {_LABELS} SELECT prompt_version, max(classified_at) AS classified_at FROM labels WHERE prompt_version IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 DESC LIMIT 1",
    "j5_semi": f"SELECT DISTINCT {K} AS bill_id FROM bill_text WHERE {K} IN (SELECT {K} FROM v_bill WHERE bill_id IS NOT NULL)",
    "j6_computed_key": f"WITH {_BILLS}, {_LABELS} SELECT committee, attr, count(*) AS n FROM (SELECT 'kr:' || {K} AS k, committee FROM bills) JOIN (SELECT 'kr:' || {K} AS k, attr FROM labels WHERE source LIKE 'kr\\_%' ESCAPE '\\') USING (k) GROUP BY 1, 2",
    "j8_defaults": f"WITH {_BILLS} SELECT bill_id, coalesce(m.party, '미상') AS party FROM bills LEFT JOIN v_member m ON lead_mona_cd = m.mona_cd",
    "j9_parties": f"WITH {_BILLS}, one AS (SELECT name, min(struct_pack(mona_cd, party)) AS m FROM v_member WHERE name IS NOT NULL GROUP BY 1), x AS (SELECT bill_id, trim(unnest(string_split(co_proposers, ','))) AS name FROM bills) SELECT bill_id, count(*) AS n_names, count(m.party) AS n_known, count(DISTINCT m.party) AS n_parties FROM x LEFT JOIN one USING (name) WHERE name <> '' GROUP BY 1",
    "j11_reconcile": f"WITH a AS (SELECT DISTINCT {K} AS bill_id FROM bill_text WHERE bill_id IS NOT NULL), b AS (SELECT DISTINCT {K} AS bill_id FROM v_bill WHERE bill_id IS NOT NULL) SELECT bill_id, 'missing' AS side FROM a ANTI JOIN b USING (bill_id) UNION ALL SELECT bill_id, 'orphan' FROM b ANTI JOIN a USING (bill_id)",
    "j14_bill_view": f"WITH {_BILLS}, {_LABELS}, t AS (SELECT {K} AS k, max(length(reason_and_content)) AS reason_chars FROM bill_text GROUP BY 1), c AS (SELECT {K} AS k, attr FROM labels WHERE source LIKE 'kr\\_%' ESCAPE '\\' AND bill_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY classified_at DESC NULLS LAST, prompt_version DESC NULLS LAST, attr DESC NULLS LAST) = 1) SELECT {K} AS bill_id, age, reason_chars, attr FROM bills LEFT JOIN t ON {K} = t.k LEFT JOIN c ON {K} = c.k",
    "where_dict": "SELECT chunk_id FROM chunks WHERE source = 'bill' AND age IN (20, 21) AND embed_config_ver = 'e0-64'",
    "party_fallback": f"WITH {_BILLS}, m AS (SELECT mona_cd, min(party) AS p FROM v_member WHERE party <> '' GROUP BY 1), v AS (SELECT mona_cd, min(party) AS p FROM v_vote WHERE party <> '' GROUP BY 1) SELECT bill_id, coalesce(m.p, v.p) AS party FROM bills LEFT JOIN m ON lead_mona_cd = m.mona_cd LEFT JOIN v ON lead_mona_cd = v.mona_cd WHERE lead_mona_cd IS NOT NULL",
    "k1_replace_tasks": "SELECT age::VARCHAR AS task, count(*) AS n, count(*) FILTER (age = 22) AS n_new FROM v_bill WHERE age IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*), 0 FROM v_bill WHERE age IS NULL HAVING count(*) > 0",
    "k5_conditional_upsert": "WITH o AS (SELECT doc_id, source, title, length(full_text) AS c FROM document_text WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY fetched_at NULLS LAST, status NULLS LAST, length(full_text) NULLS LAST) = 1) SELECT doc_id, source, CASE WHEN length(title) % 2 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN length(title) % 3 = 0 THEN 'neu' ELSE title END AS title, CASE WHEN length(title) % 2 = 0 THEN c ELSE 7 END AS chars FROM o",
    "w6_keep_latest": f"WITH {_BILLS} SELECT bill_id FROM bills QUALIFY row_number() OVER (PARTITION BY bill_name, trim(string_split(proposer, ',')[1]) ORDER BY propose_date DESC NULLS LAST, bill_id) = 1",
    "g10_share": f"WITH {_LABELS}, src AS (SELECT * FROM labels), " + _SHARE.format(by="", over="") + " SELECT attr, n, pct FROM out",
    "g10_share_by_source": f"WITH {_LABELS}, src AS (SELECT * FROM labels), " + _SHARE.format(by="source,", over="PARTITION BY source") + " SELECT source, attr, n, pct FROM out",
    "g13_coverage": f"WITH {_BILLS} SELECT count(*) AS total, count(*) FILTER ({K} IN (SELECT {K.replace('bill_id', 'c.bill_id')} FROM bill_classifications c WHERE c.bill_id IS NOT NULL)) AS done, coalesce(100.0::DOUBLE * done / nullif(total, 0), 0) AS pct FROM bills",
    "g16_top_laws": f"WITH {_BILLS}, l AS (SELECT {_LAW} AS law FROM bills) SELECT {_SHORT} AS law, count(*) AS n FROM l WHERE law IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g17_gaps": f"WITH {_LABELS}, x AS (SELECT attr, source LIKE 'kr\\_%' ESCAPE '\\' AS kr FROM labels WHERE attr IS NOT NULL AND attr <> 'none'), s AS (SELECT attr, coalesce(100.0::DOUBLE * count(*) FILTER (kr) / (SELECT count(*) FROM x WHERE kr), 0) AS pct_a, coalesce(100.0::DOUBLE * count(*) FILTER (NOT kr) / (SELECT count(*) FROM x WHERE NOT kr), 0) AS pct_b FROM x GROUP BY 1) SELECT attr, pct_a, pct_b, pct_a - pct_b AS gap FROM s",
    "g24_agreement": f"WITH {_LABELS}, x AS (SELECT attr, lower(trim(secondary_attr)) AS second, count(*) AS n FROM labels WHERE attr IS NOT NULL AND secondary_attr IS NOT NULL GROUP BY 1, 2) SELECT attr, second, n, sum(CASE WHEN attr = second THEN n ELSE 0 END) OVER () / sum(n) OVER ()::DOUBLE AS rate FROM x",
    "g25_leaders": "SELECT name, count(*) AS n FROM v_vote WHERE name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "g25_committees": f"WITH {_BILLS} SELECT committee, count(*) AS n FROM bills WHERE committee IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g27_values": "SELECT source, embed_config_ver, count(*) AS n FROM chunks GROUP BY 1, 2",
    "a1_terms": "WITH x AS (SELECT mona_cd, trim(unnest(string_split(terms_list, ','))) AS t FROM v_member), y AS (SELECT mona_cd, " + _NAMED + r" ELSE coalesce(try_cast(nullif(regexp_extract(t, '^제(\d+)대$', 1), '') AS INT), try_cast(nullif(regexp_extract(t, '^(\d+)대(?:\s*국회)?$', 1), '') AS INT)) END AS age FROM x) SELECT mona_cd, age FROM y WHERE age IS NOT NULL",
    "a4_term_of_date": f"WITH {_BILLS}, x AS (SELECT bill_id, try_strptime(CASE WHEN regexp_matches(trim(propose_date), '^\\d{{4}}$') THEN trim(propose_date) || '0630' ELSE substr(regexp_replace(propose_date, '\\D', '', 'g'), 1, 8) END, '%Y%m%d')::DATE AS pday FROM bills) SELECT bill_id, CASE WHEN pday >= DATE '1948-05-30' THEN {_TERM}::INT END AS term FROM x",
    "a6_clean_columns": "SELECT nullif(trim(bill_id), '') AS bill_id, nullif(trim(title), '') AS title FROM bill_classifications",
    "a14_base_law": f"WITH {_BILLS}, l AS (SELECT bill_id, {_LAW} AS law FROM bills) SELECT bill_id, law, {_SHORT} AS short FROM l",
    "a17_title_keyword": r"SELECT news_id, ingested_at FROM news_articles WHERE regexp_matches(title, '(?i)\bAI\b|artificial intelligence|\bA\.I\.|인공지능')",
}
