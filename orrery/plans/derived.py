"""Registered queries on labels, shares, topics, stored indexes, audits and readers."""

from pyspark.sql import functions as F

from orrery.functions import age as A
from orrery.functions import text as X
from orrery.functions.dates import loose_date
from orrery.operators import audit as Q
from orrery.operators import chunking as H
from orrery.operators import labels as L
from orrery.operators import relational as R
from orrery.operators import retrieval as V
from orrery.operators import stats as S
from orrery.operators import topics as M
from orrery.plans.bills import _BILLS, _LABELS, K, _bills, _day, _labels
from orrery.plans.corpus import _CENT, _COS
from orrery.plans.surface import TABLES, views
from orrery.plans import sqltool
from orrery.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LADDER = {3: ["인공지능"], 2: ["데이터", "알고리즘"], 1: ["(^|[^a-z0-9])ai([^a-z0-9]|$)"]}


@query(r"""
WITH t AS (SELECT news_id, ingested_at, lower(concat_ws(chr(10), title, category, hilight)) AS s FROM news_articles)
SELECT news_id, ingested_at, CASE WHEN contains(s, '인공지능') THEN 3 WHEN contains(s, '데이터') OR contains(s, '알고리즘') THEN 2
  WHEN regexp_matches(s, '(^|[^a-z0-9])ai([^a-z0-9]|$)') THEN 1 ELSE 0 END AS level FROM t
""")
def a9_ladder(spark, d):
    """The strongest kind of mention in any of several fields."""
    return table(spark, d, "news_articles").select("news_id", "ingested_at", L.highest_level(F.array("title", "category", "hilight"), LADDER).alias("level"))


@query(f"""
WITH {_BILLS} SELECT bill_id, CASE WHEN starts_with(bill_no, '21') THEN 'old' WHEN starts_with(bill_no, '22') THEN 'new' ELSE 'other' END AS kind,
  strftime({_day('propose_date')}, '%Y-%m') AS month FROM bills
""")
def a11_kind_month(spark, d):
    b = _bills(spark, d)
    return b.select("bill_id", L.by_prefix(F.coalesce("bill_no", F.lit("")), {"21": "old", "22": "new"}, "other").alias("kind"), F.date_format(loose_date(F.col("propose_date")), "yyyy-MM").alias("month"))


@query(f"""
WITH {_BILLS}, m AS (SELECT mona_cd, min(party) AS party FROM v_member WHERE mona_cd IS NOT NULL GROUP BY 1),
one AS (SELECT name, min(struct_pack(mona_cd, party)) AS m FROM v_member WHERE name IS NOT NULL GROUP BY 1),
rows_ AS (
  SELECT bill_id, coalesce(nullif(m.party, ''), '미상') AS p, true AS first FROM bills LEFT JOIN m ON lead_mona_cd = m.mona_cd
  UNION ALL SELECT bill_id, coalesce(nullif(one.m.party, ''), '미상'), false
  FROM (SELECT bill_id, trim(unnest(string_split(co_proposers, ','))) AS name FROM bills) LEFT JOIN one USING (name) WHERE name <> ''),
n AS (SELECT bill_id, p, count(*) AS n, bool_or(first) AS first FROM rows_ GROUP BY 1, 2)
SELECT bill_id, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (first AND p <> '미상'), 0)::BIGINT AS lead_count,
  string_agg(p || ':' || n, ',' ORDER BY p) AS parties, round(lead_count / total, 4)::DOUBLE AS lead_share FROM n GROUP BY 1
""")
def a13_party_shares(spark, d):
    b, m = _bills(spark, d), table(spark, d, "v_member")
    one = m.where("mona_cd is not null").groupBy(F.col("mona_cd").alias("lead_mona_cd")).agg(F.min("party").alias("party"))
    s = L.party_shares(b.select("bill_id", "lead_mona_cd").join(one, "lead_mona_cd", "left"), R.names_to_members(b, m), "bill_id", "party", "미상")
    return s.withColumn("parties", F.array_join(F.transform(F.map_entries("parties"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


def _length_label(text):
    if len(text) % 7 == 0:
        raise ValueError("no label")
    return "long" if len(text) > 20 else "short"


_ROUND = f"""
WITH keyed AS (SELECT DISTINCT {K} AS id, title FROM bill_classifications WHERE bill_id IS NOT NULL),
one AS (SELECT id, min(title) AS title FROM keyed GROUP BY 1),
done AS (SELECT id, 'v1' AS version, 'kept' AS label, NULL::VARCHAR AS error FROM one WHERE length(id) % 2 = 1 AND id <> ''
  UNION ALL SELECT id, 'v1', NULL, 'earlier' FROM one WHERE length(id) % 2 = 0 UNION ALL SELECT id, 'v0', 'old', NULL FROM one),
asked AS (SELECT id, 'v1' AS version, CASE WHEN title IS NULL OR length(title) % 7 = 0 THEN NULL WHEN length(title) > 20 THEN 'long' ELSE 'short' END AS label,
  CASE WHEN title IS NULL THEN 'no text' WHEN length(title) % 7 = 0 THEN 'ValueError: no label' END AS error
  FROM one WHERE id NOT IN (SELECT id FROM done WHERE version = 'v1' AND error IS NULL))
SELECT * FROM asked UNION ALL SELECT * FROM done WHERE (id, version) NOT IN (SELECT id, version FROM asked)
"""


@query(_ROUND)
def m2_label_round(spark, d):
    """A labelling round with a provider, over rows that are done, failed before, or labelled in another version."""
    k = F.upper(F.trim(F.regexp_replace("bill_id", r"^\s+|\s+$", ""))).alias("id")
    one = table(spark, d, "bill_classifications").where("bill_id is not null").groupBy(k).agg(F.min("title").alias("title"))
    odd = F.length("id") % 2 == 1
    null = F.lit(None).cast("string")
    v1 = one.select("id", F.lit("v1").alias("version"), F.when(odd & (F.col("id") != ""), "kept").alias("label"), F.when(~odd, "earlier").alias("error"))
    done = v1.unionByName(one.select("id", F.lit("v0").alias("version"), F.lit("old").alias("label"), null.alias("error")))
    return L.label_round(one, done, "id", "title", "v1", _length_label)


@query("SELECT source, sum(text_length)::BIGINT AS total, count(*) AS n FROM document_text GROUP BY 1")
def g4_progress(spark, d):
    return table(spark, d, "document_text").groupBy("source").agg(F.sum("text_length").alias("total"), F.count("*").alias("n"))


@query(f"""
WITH {_BILLS}, {_LABELS}, x AS (SELECT b.committee, l.attr FROM bills b JOIN labels l ON {K.replace('bill_id', 'b.bill_id')} = {K.replace('bill_id', 'l.bill_id')} AND b.committee IS NOT NULL),
top AS (SELECT committee, count(*) AS total FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
seen AS (SELECT attr, row_number() OVER (ORDER BY count(*) DESC, attr) AS r FROM labels WHERE attr IS NOT NULL GROUP BY 1)
SELECT committee, total, count(*) FILTER (attr = (SELECT attr FROM seen WHERE r = 1)) AS a1, count(*) FILTER (attr = (SELECT attr FROM seen WHERE r = 2)) AS a2,
  count(*) FILTER (attr = (SELECT attr FROM seen WHERE r = 3)) AS a3 FROM x JOIN top USING (committee) GROUP BY 1, 2
""")
def g16_top_matrix(spark, d):
    """The ten committees with most labelled bills against the three most frequent attributes."""
    k = F.upper(F.trim(F.regexp_replace("bill_id", r"^\s+|\s+$", ""))).alias("k")
    x = _bills(spark, d).where("committee is not null").select(k, "committee").join(_labels(spark, d).select(k, "attr"), "k")
    attrs = [r["attr"] for r in S.top_by_count(_labels(spark, d), "attr", 3).collect()]
    return S.top_matrix(x, "committee", "attr", 10, attrs).select("committee", "total", *[F.col(f"`{a}`").alias(f"a{i}") for i, a in enumerate(attrs, 1)])


@query(f"""
WITH {_LABELS}, x AS (SELECT source, attr, source LIKE 'kr\\_%' ESCAPE '\\' AS base FROM labels WHERE attr IS NOT NULL AND source IS NOT NULL),
s AS (SELECT source, attr, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM x y WHERE NOT y.base AND y.attr <> 'none' AND y.source = x.source) AS pct FROM x WHERE NOT base AND attr <> 'none' GROUP BY 1, 2),
r AS (SELECT attr, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM x WHERE base AND attr <> 'none') AS pct FROM x WHERE base AND attr <> 'none' GROUP BY 1),
g AS (SELECT DISTINCT source FROM x WHERE NOT base), a AS (SELECT attr FROM s UNION SELECT attr FROM r)
SELECT a.attr, round(avg(abs(coalesce(s.pct, 0) - coalesce(r.pct, 0))), 9) AS mean_gap, count(*) AS groups
FROM a CROSS JOIN g LEFT JOIN s ON s.attr = a.attr AND s.source = g.source LEFT JOIN r ON r.attr = a.attr GROUP BY 1
""")
def g17_gap_order(spark, d):
    return S.gap_order(_labels(spark, d).where("source is not null"), "source", "attr", F.col("source").startswith("kr_")).withColumn("mean_gap", F.round("mean_gap", 9)).orderBy(F.desc("mean_gap"), "attr")


@query()
def g19_storage(spark, d):
    return Q.storage_fingerprint(spark, f"{d}/v_bill.parquet").select("files", "bytes")


def _topics(spark, d):
    e = table(spark, d, "embeddings").where("label is not null").groupBy("label").agg(F.count("*").alias("count"))
    return e.select(F.lit("x").alias("attr"), F.col("label").alias("topic_id"), (F.col("label") % 3).alias("group_id"), F.when(F.col("label") == 4, "four").alias("group_label"), F.concat(F.lit("t"), "label").alias("label"), "count")


_TOPICS = "t AS (SELECT label AS topic_id, label % 3 AS group_id, CASE WHEN label = 4 THEN 'four' END AS group_label, 't' || label AS label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY embeddings.label)"


@query(f"""
WITH {_TOPICS}, o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, topic_id) AS r FROM t)
SELECT group_id, CASE WHEN count(*) > 1 THEN coalesce(max(group_label), max(label) FILTER (r = 1)) ELSE max(label) END AS label, sum(n)::BIGINT AS total,
  string_agg(topic_id::VARCHAR, ',' ORDER BY r) AS members FROM o GROUP BY 1
""")
def g22_topic_stats(spark, d):
    return S.topic_stats(_topics(spark, d)).select("group_id", "label", "total", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""
WITH {_BILLS}, s AS (SELECT committee, list(length(bill_name)::DOUBLE ORDER BY bill_id) AS v FROM bills WHERE committee IS NOT NULL AND bill_name IS NOT NULL GROUP BY 1),
e AS (SELECT committee, len(v) AS n, list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a) * 10 AS mid, CASE WHEN len(v) >= 50 THEN 0.2 WHEN len(v) >= 20 THEN 0.35 ELSE 0.5 END AS m FROM s)
SELECT committee, round(CASE WHEN n >= 5 THEN mid * (1 - m) END, 6)::DOUBLE AS low, round(CASE WHEN n >= 5 THEN mid * (1 + m) END, 6)::DOUBLE AS high FROM e
""")
def g26_eta(spark, d):
    b = _bills(spark, d).where("committee is not null and bill_name is not null")
    v = b.groupBy("committee").agg(F.array_sort(F.collect_list(F.struct("bill_id", F.length("bill_name").cast("double").alias("x")))).alias("v"))
    v = v.select("committee", S.eta(F.transform("v", lambda s: s["x"]), F.lit(10)).alias("e"))
    return v.select("committee", F.round("e.low", 6).alias("low"), F.round("e.high", 6).alias("high"))


@query("SELECT doc_id FROM documents WHERE (CASE WHEN n_chars % 3 = 0 THEN true WHEN n_chars % 3 = 1 THEN false END) IS NOT FALSE")
def flag_keep(spark, d):
    flag = F.when(F.col("n_chars") % 3 == 0, True).when(F.col("n_chars") % 3 == 1, False)
    return table(spark, d, "documents").withColumn("flag", flag).where(R.keep_flag("flag")).select("doc_id")


@query("SELECT doc_id, n_chars, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm FROM documents JOIN (SELECT vec_id, min(embedding) AS embedding FROM embeddings GROUP BY 1) ON doc_id = vec_id")
def j10_gather(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.gather(table(spark, d, "documents").select("doc_id", "n_chars"), v, "doc_id").select("doc_id", "n_chars", F.round(V.norm(F.col("vector")), 9).alias("norm"))


@query("SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 2.0 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6)::DOUBLE AS x FROM embeddings")
def k9_vectors(spark, d):
    """New vectors replace old ones, but for those of another length."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    twice = F.transform("vector", lambda x: x * 2)
    new = e.where("vec_id % 3 < 2").withColumn("vector", F.when(F.col("vec_id") % 3 == 0, twice).otherwise(F.slice(twice, 1, 5)))
    return R.upsert_vectors(e, new, "vec_id", 64).select("vec_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x"))


@query("""
SELECT CASE WHEN regexp_matches(vote_date, '^\\d{1,9}$') THEN vote_date::INT::VARCHAR END AS value, count(vote_date) AS before, count(*) AS after FROM v_vote GROUP BY 1
""")
def k15_cast_report(spark, d):
    return Q.cast_report(table(spark, d, "v_vote"), "vote_date", "int")


@query(f"SELECT mona_cd, name, vote_result, {_day('vote_date')} AS vote_day, age FROM v_vote")
def view_votes(spark, d):
    v = R.renamed(table(spark, d, "v_vote"), {c: (c, "string") for c in ("mona_cd", "name", "vote_result", "vote_date")} | {"age": ("age", "int")}, "votes")
    return v.select("mona_cd", "name", "vote_result", loose_date(F.col("vote_date")).alias("vote_day"), "age")


@query("SELECT mona_cd AS code, name AS member_name, try_cast(regexp_extract(reelect, '\\d+') AS INT) AS times FROM v_member")
def view_members(spark, d):
    m = table(spark, d, "v_member").withColumn("times", F.nullif(F.regexp_extract("reelect", r"\d+", 0), F.lit("")))
    return R.renamed(m, {"code": ("mona_cd", "string"), "member_name": ("name", "string"), "times": ("times", "int")}, "members")


@query("SELECT mona_cd, party FROM v_member WHERE name = (SELECT min(name) FROM v_member)")
def r12_member_lookup(spark, d):
    """A member by name: chunks first, the member table for those the chunks don't have."""
    m = table(spark, d, "v_member")
    name = m.agg(F.min("name")).first()[0]
    got = V.Search(table(spark, d, "chunks"), bm25=None).member(name, m)
    return got.select("mona_cd").distinct().join(m.select("mona_cd", "party"), "mona_cd").select("mona_cd", "party")


@query("""
SELECT DISTINCT chunk_id, coalesce(source, '?') AS source, coalesce(nullif(bill_id, ''), nullif(doc_id, ''), nullif(conf_id, ''), nullif(mona_cd, ''), '') AS ref,
  array_to_string(list_filter([CASE WHEN bill_name <> '' THEN 'bill_name=' || bill_name END, CASE WHEN speaker <> '' THEN 'speaker=' || speaker END, CASE WHEN name <> '' THEN 'name=' || name END,
    CASE WHEN party <> '' THEN 'party=' || party END, CASE WHEN age IS NOT NULL THEN 'age=' || age END, CASE WHEN committee <> '' THEN 'committee=' || committee END], lambda x: x IS NOT NULL), ' | ') AS notes,
  md5(substr(coalesce(text, ''), 1, 400)) AS digest FROM chunks
""")
def r14_formatted(spark, d):
    return _formatted_rows(table(spark, d, "chunks"))


def _formatted_rows(c):
    keyed = c.withColumn("text", F.concat(F.coalesce("chunk_id", F.lit("")), F.lit("\x01"), F.substring(F.coalesce("text", F.lit("")), 1, V.SHOWN_TEXT)))
    f = V.formatted(keyed, shown=V.SHOWN_TEXT + 100)
    return f.select(F.nullif(F.substring_index("text", "\x01", 1), F.lit("")).alias("chunk_id"), "source", "ref", "notes", F.md5(F.substring_index("text", "\x01", -1)).alias("digest")).distinct()


def _ann(spark, d):
    digest = Q.storage_fingerprint(spark, f"{d}/embeddings.parquet").first()["digest"]
    return V.AnnIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", f"{V.shared_folder(spark)}/ann-{digest}")


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query()
def r2_ann(spark, d):
    """Every row with id % 50 = 0 against a stored index, 16 cells a query."""
    return _ann(spark, d).search_batch(_asked(spark, d)).select("query", F.col("key").alias("vec_id"), F.round("score", 9).alias("score"))


@query(f"WITH s AS (SELECT query, vec_id, {_COS} AS score FROM (SELECT q.vec_id AS query, e.vec_id, e.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) SELECT query, vec_id, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.score DESC, vec_id) <= 30")
def r2_ann_all_cells(spark, d):
    """The same with all cells, which is exact."""
    ix = _ann(spark, d)
    return ix.search_batch(_asked(spark, d), probes=len(ix.centroids)).select("query", F.col("key").alias("vec_id"), F.round("score", 9).alias("score"))


_WORDS = r"(\p{L}{2,})"


@query(r"""
WITH g AS (SELECT lower(trim(lang)) AS lang, lower(unnest(regexp_extract_all(text, '\p{L}{2,}'))) AS term FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
t AS (SELECT lang, term, count(*) AS tf FROM g GROUP BY 1, 2), z AS (SELECT lang, sum(tf) AS size FROM t GROUP BY 1), a AS (SELECT term, sum(tf) AS al FROM t GROUP BY 1),
s AS (SELECT lang, term, tf / size::DOUBLE * ln(1 + (SELECT avg(size) FROM z) / al::DOUBLE) AS score FROM t JOIN z USING (lang) JOIN a USING (term))
SELECT lang, term, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, term) <= 10
""")
def m6_cluster_terms(spark, d):
    docs = table(spark, d, "documents").where("text is not null and lang is not null").withColumn("lang", F.lower(F.trim("lang")))
    return M.ctfidf(docs, "lang", F.transform(F.regexp_extract_all("text", F.lit(_WORDS)), lambda x: F.lower(x))).select("lang", "term", F.round("score", 9).alias("score"))


@query()
def m6_topics(spark, d):
    t = M.density_topics(table(spark, d, "embeddings"), "vec_id", "embedding", 12, 8)
    return t.groupBy("topic").agg(F.count("*").alias("n"))


@query("""
SELECT label, n, greatest(8, ceil(0.6 * sqrt(n)))::INT AS root, greatest(8, ceil(3 * pow(n, 1 / 3.0::DOUBLE)))::INT AS cube, greatest(8, ceil(10 * log10(greatest(n, 10))))::INT AS log, greatest(8, floor(n / 20))::INT AS linear
FROM (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1)
""")
def m7_cluster_sizes(spark, d):
    n = table(spark, d, "embeddings").where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    size = lambda rule, factor, name: M.min_cluster_size(F.col("n"), rule, factor).alias(name)
    return n.select("label", "n", size("sqrt", 0.6, "root"), size("cbrt", 3, "cube"), size("log", 10, "log"), size("linear", 20, "linear"))


@query(f"""
WITH RECURSIVE {_CENT}, s AS (SELECT x.label AS a, y.label AS b, sum(x.m * y.m) / (sqrt(sum(x.m * x.m)) * sqrt(sum(y.m * y.m))) AS sim FROM cells x JOIN cells y ON x.i = y.i AND x.label % 2 = 0 AND y.label % 2 = 1 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY sim DESC, a, b) AS r FROM s WHERE sim >= -1),
pick AS (SELECT r, [a] AS ua, [b] AS ub, a, b, sim FROM o WHERE r = 1
  UNION ALL SELECT * FROM (SELECT o.r, list_append(ua, o.a), list_append(ub, o.b), o.a, o.b, o.sim FROM pick p JOIN o ON o.r > p.r AND NOT list_contains(ua, o.a) AND NOT list_contains(ub, o.b) ORDER BY o.r LIMIT 1))
SELECT a, b, round(sim, 8) AS similarity FROM pick
""")
def m9_alignment(spark, d):
    c = M.centroids(table(spark, d, "embeddings"), "label", "embedding")
    rows = [(a, b, float(s)) for a, b, s in M.aligned(c, "label", F.col("label") % 2 == 0, -1.0)]
    return spark.createDataFrame(rows, "a int, b int, s double").select("a", "b", F.round("s", 8).alias("similarity"))


@query(f"WITH {_TOPICS} SELECT topic_id, CASE WHEN topic_id = 5 THEN 'five' WHEN topic_id = 2 THEN 'two' ELSE label END AS label, n AS count FROM t WHERE topic_id <> 3")
def m11_curated(spark, d):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    kept, _ = M.curate_all(_topics(spark, d), make([("x", 3), ("x", 3)], "attr string, topic_id int"), make([("x", 5, "cinq"), ("x", 2, "two")], "attr string, topic_id int, label string"), make([("x", 5, "label", "five")], "attr string, topic_id int, field string, value string"))
    return kept.select("topic_id", "label", "count")


@query("SELECT label % 3 AS g, doc_id AS article_id, source AS title FROM embeddings JOIN documents ON doc_id = vec_id WHERE label IS NOT NULL GROUP BY ALL")
def m12_topic_articles(spark, d):
    a = table(spark, d, "embeddings").where("label is not null").select(F.lit("x").alias("attr"), F.col("label").alias("topic_id"), F.col("vec_id").alias("article_id"))
    topics = a.groupBy((F.col("topic_id") % 3).alias("label")).agg(F.collect_set(F.concat(F.lit("x:"), "topic_id")).alias("keys"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("title"))
    return M.topic_articles(topics, a, docs).select(F.col("label").alias("g"), "article_id", "title")


@query("VALUES ('grown', 'rows_added'), ('shrunk', 'rows_removed'), ('changed', 'content_changed'), ('recast', 'schema_changed'), ('gone', 'dropped'), ('fresh', 'created')")
def d2_diff(spark, d):
    m = table(spark, d, "v_member")
    first = Q.snapshot({"same": m, "grown": m, "shrunk": m, "changed": m, "recast": m, "gone": m})
    other = m.withColumn("name", F.reverse("name"))
    second = Q.snapshot({"same": m.orderBy(F.desc("mona_cd")), "grown": m.unionByName(m.limit(1)), "shrunk": m.where(F.col("mona_cd") != m.agg(F.min("mona_cd")).first()[0]), "changed": other, "recast": m.withColumnRenamed("party", "p"), "fresh": m})
    return spark.createDataFrame(Q.diff(first, second), "col0 string, col1 string")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) <= 3")
def d5_kept_versions(spark, d):
    return Q.kept_versions(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 3).select("user_id", "event_id")


@query("""
SELECT * FROM (SELECT 'chunks' AS tab, 'age is null' AS rule, count(*) FILTER (age IS NULL) AS n FROM chunks
UNION ALL SELECT 'chunks', 'dae_num is a bare number', count(*) FILTER (regexp_matches(dae_num, '^\\s*\\d+\\s*$')) FROM chunks
UNION ALL SELECT 'v_vote', 'vote_date is no whole number', count(*) FILTER (vote_date IS NOT NULL AND NOT regexp_matches(vote_date, '^\\d{1,9}$')) FROM v_vote) WHERE n > 0
""")
def d6_violations(spark, d):
    t = {n: table(spark, d, n) for n in ("chunks", "v_vote")}
    return Q.violations(t, {"v_vote": "vote_date"}, {"chunks": ["age"]}, {"chunks": ["dae_num"]}).withColumnRenamed("table", "tab")


@query(f"WITH {_BILLS} SELECT bill_id, CASE WHEN n BETWEEN 100001 AND 100099 THEN n - 100000 END AS age FROM (SELECT bill_id, try_cast('1000' || right(bill_no, 2) AS INT) AS n FROM bills)")
def a2_unit_codes(spark, d):
    return _bills(spark, d).select("bill_id", A.unit_code(F.concat(F.lit("1000"), F.expr("right(bill_no, 2)"))).alias("age"))


@query(f"WITH {_BILLS} SELECT bill_id, age AS term, try_cast(bill_no AS DOUBLE)::BIGINT AS no FROM bills")
def a5_derived_age(spark, d):
    """The term out of a task key that names it, and a loose number."""
    key = F.concat(F.lit("bills__AGE_"), F.col("age").cast("string"), F.lit("__YEAR_2024"))
    return _bills(spark, d).select("bill_id", A.derived_age("param:AGE", {}, key).alias("term"), F.trim("bill_no").try_cast("double").cast("long").alias("no"))


@query(r"SELECT DISTINCT bill_id, md5(trim(regexp_extract(full_text, '(?s)제\s*안\s*이\s*유(?:\s*및\s*주\s*요\s*내\s*용)?\s*(.+)\z', 1), E' ')) AS digest FROM bill_text WHERE full_text IS NOT NULL")
def a8_reasons(spark, d):
    return table(spark, d, "bill_text").where("full_text is not null").select("bill_id", F.md5(X.reason_section(F.col("full_text"))).alias("digest")).distinct()


@query(r"SELECT DISTINCT bill_id, regexp_replace(replace(bill_id, '.', ''), '\s+', '_', 'g') AS file FROM bill_classifications")
def a16_file_names(spark, d):
    return table(spark, d, "bill_classifications").select("bill_id", X.id_to_file(F.col("bill_id")).alias("file")).distinct()


@query("""
WITH t AS (SELECT DISTINCT c.bill_id, title, b.body FROM bill_classifications c LEFT JOIN (SELECT bill_id, max(coalesce(nullif(reason_and_content, ''), full_text)) AS body FROM bill_text GROUP BY 1) b USING (bill_id))
SELECT bill_id, title, md5('법안명: ' || coalesce(title, '') || E'\\n\\n' || substr(coalesce(body, ''), 1, 2000)) AS prompt FROM t
""")
def a18_prompt(spark, d):
    t = table(spark, d, "bill_text").groupBy("bill_id").agg(F.max(F.coalesce(F.nullif("reason_and_content", F.lit("")), "full_text")).alias("body"))
    c = table(spark, d, "bill_classifications").select("bill_id", "title").distinct().join(t, "bill_id", "left")
    return c.select("bill_id", "title", F.md5(X.prompt_text(F.col("title"), F.col("body"), 2000)).alias("prompt"))


@query(r"""
WITH b AS (SELECT bill_id, max(bill_name) AS name FROM v_bill WHERE bill_id IS NOT NULL GROUP BY 1),
t AS (SELECT DISTINCT t.bill_id, coalesce(b.name, '') || ' ' || coalesce(nullif(reason_and_content, ''), full_text) AS body FROM bill_text t LEFT JOIN b USING (bill_id)),
n AS (SELECT bill_id, (len(regexp_extract_all(body, '인공\s*지능')) + len(list_filter(regexp_extract_all(body, '[A-Za-z]+'), lambda x: x = 'AI')) + len(regexp_extract_all(body, 'A\.I\.?')))::INT AS n FROM t)
SELECT DISTINCT bill_id, n FROM n WHERE n >= 3
""")
def a19_candidates(spark, d):
    """Bills whose name and text mention the subject three times or more."""
    b = table(spark, d, "v_bill").where("bill_id is not null").groupBy("bill_id").agg(F.max("bill_name").alias("name"))
    t = table(spark, d, "bill_text").join(b, "bill_id", "left")
    body = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce(F.nullif("reason_and_content", F.lit("")), "full_text"))
    return t.select("bill_id", X.mentions(body).cast("int").alias("n")).where("n >= 3").distinct()


@query("SELECT age, bill_id, length(full_text) AS n FROM bill_text WHERE bill_id IS NOT NULL AND full_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY age ORDER BY length(full_text) DESC, bill_id) = 1")
def w7_keep_longest(spark, d):
    t = table(spark, d, "bill_text").where("bill_id is not null and full_text is not null")
    return R.keep_longest(t.select("age", "bill_id", "full_text"), ["age"], "full_text", "bill_id").select("age", "bill_id", F.length("full_text").alias("n"))


@query("""
WITH e AS (SELECT chunk_id, CASE WHEN chunk_idx % 4 = 1 THEN vector[1:10] ELSE vector END AS vector FROM chunks WHERE chunk_idx % 4 < 3
  UNION ALL SELECT 'x' || chunk_id, vector FROM chunks WHERE chunk_idx = 0),
v AS (SELECT *, len(vector) = 64 AS dim, len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AS fin FROM e)
SELECT count(chunk_id) - count(DISTINCT chunk_id) AS duplicates, count(*) FILTER (vector IS NOT NULL AND NOT dim) AS wrong_dim, count(*) FILTER (dim AND NOT fin) AS not_finite,
  (SELECT count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.chunk_id = c.chunk_id AND e.vector IS NOT NULL)) AS missing,
  (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = e.chunk_id)) AS orphans FROM v
""")
def d8_ingest_report(spark, d):
    """Chunks against embeddings of which some are missing, some too short, and some of no chunk."""
    c = table(spark, d, "chunks")
    e = c.where("chunk_idx % 4 < 3").select("chunk_id", F.when(F.col("chunk_idx") % 4 == 1, F.slice("vector", 1, 10)).otherwise(F.col("vector")).alias("vector"))
    e = e.unionByName(c.where("chunk_idx = 0").select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), "vector"))
    return Q.ingest_report(c, e, 64).select("duplicates", "wrong_dim", "not_finite", "missing", "orphans")


@query(r"""
WITH tok AS (SELECT CASE WHEN source = 'document' THEN CASE WHEN doc_source = 'minutes_committee' THEN 'doc_minutes_committee_' || ((strpos('0123456789abcdef', lower(substr(chunk_id, 1, 1))) - 1) % 4) ELSE 'doc_' || doc_source END ELSE source END AS sub_id,
  chunk_id AS id, lower(unnest(list_concat(regexp_extract_all(text, '[\p{L}\p{N}]+'), regexp_extract_all(text, '[A-Za-z0-9_/.\-]+')))) AS token FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)
SELECT sub_id, count(DISTINCT id) AS docs, count(DISTINCT token) AS tokens, count(DISTINCT (id, token)) AS postings FROM tok GROUP BY 1
""")
def r4_sub_corpora(spark, d):
    """The stored index of the chunks, by sub-corpus."""
    digest = Q.storage_fingerprint(spark, f"{d}/chunks.parquet").first()["digest"]
    sub = V.sub_corpus(F.col("source"), F.col("doc_source"), F.col("chunk_id"))
    ix = V.Bm25Index.build(table(spark, d, "chunks"), "chunk_id", "text", sub, f"{V.shared_folder(spark)}/bm25-{digest}")
    return ix.postings.groupBy("sub_id").agg(F.count_distinct("id").alias("docs"), F.count_distinct("token").alias("tokens"), F.count("*").alias("postings"))


@query("SELECT doc_source, speaker, count(*) AS n, count(DISTINCT chunk_id) AS ids FROM chunks WHERE length(text) > 50 AND source = 'document' GROUP BY ALL")
def h6_filtered(spark, d):
    return table(spark, d, "chunks").where((F.length("text") > 50) & (F.col("source") == "document")).groupBy("doc_source", "speaker").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"))


@query("SELECT DISTINCT substr(sha256('sp:' || conf_id || ':' || speech_idx || ':0:' || substr(text, 1, 80)), 1, 16) AS chunk_id, conf_id, 0 AS chunk_idx FROM (SELECT chunk_id AS conf_id, coalesce(chunk_idx, 0) AS speech_idx, text FROM chunks WHERE chunk_id IS NOT NULL AND length(text) > 5 AND length(text) <= 1500)")
def h3_speech_chunks(spark, d):
    s = table(spark, d, "chunks").where("chunk_id is not null and length(text) <= 1500").select(F.col("chunk_id").alias("conf_id"), F.coalesce("chunk_idx", F.lit(0)).alias("speech_idx"), "text")
    return H.speech_chunks(s).select("chunk_id", F.col("ref_id").alias("conf_id"), "chunk_idx").distinct()


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_files(spark, d):
    """Files named in the statement itself, through the read-only surface."""
    views(spark, d, TABLES)
    return sqltool.guarded(spark, f"SELECT n_name, r_name FROM parquet.`{d}/nation.parquet` JOIN region ON n_regionkey = r_regionkey")


@query("SELECT c_mktsegment, min(n_) AS most FROM (SELECT c_mktsegment, c_nationkey AS n_, count(*) AS c FROM customer GROUP BY 1, 2 QUALIFY rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) = 1) GROUP BY 1")
def s_mode(spark, d):
    views(spark, d, TABLES)
    return sqltool.guarded(spark, "SELECT c_mktsegment, mode(c_nationkey, true) AS most FROM customer GROUP BY c_mktsegment")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') o ON c_custkey = o_custkey")
def s_anti(spark, d):
    views(spark, d, TABLES)
    return sqltool.guarded(spark, "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') o ON c_custkey = o_custkey")


@query("SELECT l_returnflag, count(*) AS n, true AS median_near, true AS top_exact FROM lineitem GROUP BY 1")
def sql_approx(spark, d):
    """Approximate aggregates against their exact ranks, worked out beside them: the approximate median lies within a
    hundredth of the middle, the approximate top value is the most frequent one."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_linenumber")
    a = li.groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 1000).alias("m"), F.expr("approx_top_k(l_linenumber, 1)")[0]["item"].alias("t"), F.mode("l_linenumber", True).alias("mode"), F.count("*").alias("n"))
    r = li.join(F.broadcast(a), "l_returnflag").groupBy("l_returnflag", "n").agg(F.count_if(F.col("l_quantity") < F.col("m")).alias("below"), F.count_if(F.col("l_quantity") <= F.col("m")).alias("upto"), F.max(F.col("t") == F.col("mode")).alias("top_exact"))
    return r.select("l_returnflag", "n", ((F.col("below") <= 0.51 * F.col("n")) & (F.col("upto") >= 0.49 * F.col("n"))).alias("median_near"), "top_exact")


@query("SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY 1")
def stream_read(spark, d):
    """A stream over the files of the table, drained into micro-batches of partial counts that are put together."""
    import uuid

    from orrery.streaming import events as E

    folder = f"{V.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s = E.source(spark, f"{d}/events.parq*", table(spark, d, "events"))

    def batch(df, epoch):
        hour = F.date_trunc("hour", "ts")
        df.groupBy("event_type", hour.alias("h")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    E.drain(s, batch, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.count_distinct("h").alias("hours"))


@query("SELECT version, count(*) AS n FROM (SELECT 'a' AS version, doc_id FROM documents WHERE doc_id % 3 < 2 UNION SELECT 'b', doc_id FROM documents WHERE doc_id % 3 = 2) GROUP BY 1")
def k10_append(spark, d):
    """Three appends of which one repeats rows that are there and one has another version."""
    import uuid

    from orrery.sources import files

    folder, docs = f"{V.shared_folder(spark)}/append-{uuid.uuid4().hex}", table(spark, d, "documents").select("doc_id", "n_chars")
    for rest, version in ((docs.where("doc_id % 3 = 0"), "a"), (docs.where("doc_id % 3 < 2"), "a"), (docs.where("doc_id % 3 = 2"), "b")):
        files.append_versioned(rest, folder, "doc_id", version)
    return spark.read.parquet(f"{folder}/rows").groupBy("version").agg(F.count("*").alias("n"))
