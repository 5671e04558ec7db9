"""Registered queries on chunking, retrieval, topics and audits."""

from pyspark.sql import functions as F

from orrery.operators import audit as Q
from orrery.operators import chunking as H
from orrery.operators import relational as R
from orrery.operators import retrieval as V
from orrery.operators import stats as S
from orrery.operators import topics as M
from orrery.session import table

TERMS = ["인공지능", "ai", "예산은", "공공행정"]
KEYWORDS = [("privacy", "privacy"), ("privacy", "personal data"), ("safety", "safety rules"), ("safety", "inspection"), ("funding", "funding"), ("workforce", "workforce")]

#: The attributes' keywords in the other languages of the corpus too.
CORPUS_KEYWORDS = KEYWORDS + [
    ("privacy", "개인정보"), ("privacy", "données personnelles"), ("privacy", "personenbezogene daten"), ("safety", "안전성"), ("safety", "점검"), ("safety", "sécurité"), ("safety", "sicherheit"),
    ("funding", "예산"), ("funding", "재정지원"), ("funding", "budget"), ("funding", "financement"), ("workforce", "전문인력"), ("workforce", "노동조합"), ("workforce", "emploi"), ("workforce", "fachkräfte"),
]


def h1_char_chunks(spark, d):
    return H.char_chunks(table(spark, d, "documents").where("doc_id is not null"), "text", ["doc_id"]).select("doc_id", "chunk_idx", F.md5("text").alias("digest"))


def h2_speaker_chunks(spark, d):
    docs = table(spark, d, "document_text").where(F.col("source").startswith("minutes_"))
    return H.speaker_chunks(docs, "full_text", ["doc_id", "source"]).select("doc_id", "source", "chunk_idx", F.md5("text").alias("digest"))


def h3_bill_chunks(spark, d):
    return H.bill_chunks(table(spark, d, "bill_text")).select("chunk_id", "sub_source", "ref_id", "chunk_idx").distinct()


def h3_bill_cards(spark, d):
    return H.bill_cards(table(spark, d, "v_bill")).select("chunk_id", "ref_id", F.md5("text").alias("digest")).distinct()


def h3_member_cards(spark, d):
    return H.member_cards(table(spark, d, "v_member")).select("chunk_id", "ref_id", "text")


def h3_all_chunks(spark, d):
    """Chunks of all sources in one table."""
    parts = [H.bill_chunks(table(spark, d, "bill_text")), H.bill_cards(table(spark, d, "v_bill")), H.member_cards(table(spark, d, "v_member")), H.document_chunks(table(spark, d, "document_text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "sub_source").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"))


def h5_not_indexed(spark, d):
    c = table(spark, d, "chunks").where("chunk_id is not null")
    return H.not_indexed(c, c.where("chunk_idx % 2 = 0"), "e1-64").select("chunk_id", F.length("text").alias("n"))


def h7_export_counts(spark, d):
    c = table(spark, d, "chunks")
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return c.groupBy("source").agg(F.count_if(blank).alias("blank"), F.count_if(~blank).alias("kept"), F.count_distinct(F.when(~blank, F.col("chunk_id"))).alias("ids"))


def g20_length_histogram(spark, d):
    return S.histogram(table(spark, d, "chunks"), F.length("text"), [200, 400, 600, 800, 1000, 1500, 2000])


def g21_norms(spark, d):
    return table(spark, d, "embeddings").select(V.norm(F.col("embedding")).alias("x")).agg(F.min("x").alias("least"), F.avg("x").alias("mean"), F.max("x").alias("most"))


def _query_vector(spark, d):
    r = table(spark, d, "embeddings").where("vec_id = (select 1)").select("embedding").first()
    return [float(x) for x in r[0]] if r else [1.0] * 64


def r1_knn(spark, d):
    return V.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d)).select("vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


def r1_knn_batch(spark, d):
    """Every row whose id is divisible by 50 as a query against all rows."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return V.knn_batch(e, "vec_id", "embedding", q).select("query", "vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


def r3_ascii_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(V.ascii_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def _bm25(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null").withColumn("src", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    # The folder is named after the files, so an index is built once for as long as they stay as they are.
    digest = Q.storage_fingerprint(spark, f"{d}/documents.parquet").first()["digest"]
    return V.Bm25Index.build(docs, "doc_id", "text", F.col("src"), f"{V.shared_folder(spark)}/bm25-{digest}")


def r5_bm25(spark, d):
    return _bm25(spark, d).search(TERMS).select("id", "sub_id", F.round("score", 8).alias("score"), F.col("rank").cast("int").alias("rank"))


def r7_rrf(spark, d):
    a = V.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d)).select(F.col("vec_id").alias("id"), "rank")
    b = table(spark, d, "embeddings").where("label is not null").orderBy("label", "vec_id").limit(30).select(F.col("vec_id").alias("id"), "label")
    from pyspark.sql.window import Window

    b = b.withColumn("rank", F.row_number().over(Window.orderBy("label", "id")) - 1)
    return V.rrf(a, b, "id").select("id", F.round("score", 12).alias("score"), F.col("rank").cast("int").alias("rank"))


def r10_hybrid(spark, d):
    c = R.keep_first(table(spark, d, "chunks").where("chunk_id is not null"), ["chunk_id"], F.col("text").asc_nulls_last())
    v = [1.0 if i % 2 else -1.0 for i in range(64)]
    ok = c.where((F.size("vector") == 64) & F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return V.Search(ok).hybrid("인공지능 예산은", 10, {"source": "document"}, vector=v).select("chunk_id", F.round("score", 12).alias("score"))


def r13_stats(spark, d):
    return V.Search(table(spark, d, "chunks")).stats("e1-64")


def m3_corpus_tfidf(spark, d):
    """Of all documents, whatever their language, in words of two letters or more of any script."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"(\p{L}{2,})")), lambda x: F.lower(x)).alias("words"))
    return M.tfidf(docs, "doc_id", M.grams(F.col("words"), 2), min_df=2, max_df=0.95, max_features=10_000)


def m3_weights(spark, d):
    return m3_corpus_tfidf(spark, d).select("doc_id", "term", F.round("weight", 9).alias("weight"))


def m4_attributes(spark, d):
    k = spark.createDataFrame(CORPUS_KEYWORDS, "attr string, keyword string")
    return M.best_attribute(M.keyword_scores(m3_corpus_tfidf(spark, d).persist(), "doc_id", k), "doc_id").select("doc_id", "attr", F.round("score", 9).alias("score"))


def m5_lda(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"(\p{L}{2,})")), lambda x: F.lower(x)).alias("words"))
    return M.lda(docs.repartition(8, "doc_id").sortWithinPartitions("doc_id"), "doc_id", "words", topics=10, iterations=50)[0].select("doc_id", "topic")


def g23_centroids(spark, d):
    c = M.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 9).alias("x"))


def m10_nearest(spark, d):
    e = table(spark, d, "embeddings")
    return M.nearest_members(e, "label", "vec_id", "embedding", M.centroids(e, "label", "embedding"), 5).select("label", "vec_id", F.round("distance", 8).alias("distance"))


def j12_centroid_pairs(spark, d):
    return M.centroid_pairs(M.centroids(table(spark, d, "embeddings"), "label", "embedding"), "label", -1.0).select("a", "b", F.round("similarity", 8).alias("similarity"))


def g18_fingerprint(spark, d):
    return Q.portable_fingerprint(table(spark, d, "v_bill"), ["bill_id", "bill_name", "committee"])


def g18_bill_fingerprint(spark, d):
    """Of all columns."""
    bills = table(spark, d, "v_bill")
    return Q.portable_fingerprint(bills, bills.columns)


def g18_native_fingerprint(spark, d):
    return Q.fingerprint(table(spark, d, "v_vote"))


def d3_touched(spark, d):
    return Q.touched_rows(table(spark, d, "news_articles"), "ingested_at", F.lit("2022-01-01").cast("timestamp_ntz"))


def d7_uncastable(spark, d):
    return Q.uncastable(table(spark, d, "v_vote"), "vote_date", "int")


QUERIES = {f.__name__: f for f in (
    h1_char_chunks, h2_speaker_chunks, h3_bill_chunks, h3_bill_cards, h3_member_cards, h3_all_chunks, h5_not_indexed, h7_export_counts, g20_length_histogram, g21_norms, r1_knn, r1_knn_batch, r3_ascii_tokens, r5_bm25, r7_rrf, r10_hybrid, r13_stats,
    m3_weights, m4_attributes, m5_lda, g23_centroids, m10_nearest, j12_centroid_pairs, g18_fingerprint, g18_bill_fingerprint, g18_native_fingerprint, d3_touched, d7_uncastable,
)}

_WIN = """w AS (SELECT {keys}, i, body AS whole, CASE WHEN length(body) <= 1500 THEN body ELSE substr(body, i * 600 + 1, 800) END AS text
 FROM (SELECT {keys}, body, unnest(range(CASE WHEN length(body) <= 1500 THEN 1 ELSE greatest(ceil((length(body) - 200) / 600.0)::BIGINT, 1) END)) AS i FROM src WHERE length(body) > 0)),
c AS (SELECT {keys}, (row_number() OVER (PARTITION BY {part} ORDER BY i) - 1)::INT AS chunk_idx, text FROM w WHERE length(whole) <= 1500 OR length(regexp_replace(text, '\\s+', '', 'g')) > 0)"""
_V = lambda c: f"coalesce({c}::VARCHAR, '')"
_QV = "(SELECT embedding FROM embeddings WHERE vec_id = 1)"
_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
_KNN = f"knn AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT vec_id, {_COS.replace('a,', 'x::DOUBLE[],').replace(', a)', ', x::DOUBLE[])').replace('b,', 'y::DOUBLE[],').replace(', b)', ', y::DOUBLE[])')} AS score FROM (SELECT vec_id, embedding AS x, {_QV} AS y FROM embeddings WHERE embedding IS NOT NULL)) ORDER BY score DESC, vec_id LIMIT 30)"
_CENT = "cells AS (SELECT label, i, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label <> -1) GROUP BY 1, 2)"
_TOK = "tok AS (SELECT coalesce(lower(trim(source)), '') AS sub_id, doc_id AS id, lower(unnest(list_concat(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), regexp_extract_all(text, '[A-Za-z0-9_/.\\-]+')))) AS token FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
_TFIDF = """docs AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x)) AS w FROM documents WHERE lower(trim(lang)) = 'en' AND text IS NOT NULL),
g AS (SELECT doc_id, unnest(w) AS term FROM docs UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs)),
t AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM docs),
v AS (SELECT term, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM t, nn GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(n) ORDER BY sum(tf) DESC, term LIMIT 500),
r AS (SELECT doc_id, term, tf * idf AS raw FROM t JOIN v USING (term)), weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r)"""
_CORPUS_TFIDF = _TFIDF.replace("[A-Za-z]{3,}", "\\p{L}{2,}").replace("lower(trim(lang)) = 'en' AND ", "").replace("LIMIT 500", "LIMIT 10000")
_V_BILL = "bill_id bill_no bill_name proposer lead_proposer lead_mona_cd co_proposers committee propose_date proc_result proc_date cmt_result cmt_date law_result law_date age fetched_at".split()

SQL = {
    "h1_char_chunks": "WITH src AS (SELECT doc_id, text AS body FROM documents WHERE doc_id IS NOT NULL), " + _WIN.format(keys="doc_id", part="doc_id") + " SELECT doc_id, chunk_idx, md5(text) AS digest FROM c",
    "h3_bill_chunks": "WITH both_ AS (SELECT DISTINCT bill_id, 'reason' AS sub, reason_and_content AS body FROM bill_text UNION ALL SELECT DISTINCT bill_id, 'full', full_text FROM bill_text), src AS (SELECT *, row_number() OVER () AS rid FROM both_), " + _WIN.format(keys="rid, bill_id, sub", part="rid") + " SELECT DISTINCT substr(sha256(CASE WHEN bill_id IS NULL THEN NULL ELSE 'bill:' || bill_id || ':' || sub || ':' || chunk_idx || ':' || substr(text, 1, 80) END), 1, 16) AS chunk_id, sub AS sub_source, bill_id AS ref_id, chunk_idx FROM c",
    "h3_bill_cards": f"WITH t AS (SELECT bill_id, concat_ws(E'\\n', '법안명: ' || {_V('bill_name')}, CASE WHEN age <> 0 THEN '대수: ' || age || '대' END, '발의자: ' || coalesce(nullif(proposer, ''), {_V('lead_proposer')}), '위원회: ' || {_V('committee')}, '제안일: ' || {_V('propose_date')}, '처리결과: ' || {_V('proc_result')}) AS text FROM v_bill) SELECT DISTINCT substr(sha256('bill_meta:' || bill_id || ':' || substr(text, 1, 80)), 1, 16) AS chunk_id, bill_id AS ref_id, md5(text) AS digest FROM t",
    "h3_member_cards": "WITH t AS (SELECT mona_cd, concat_ws(E'\\n', " + ", ".join(f"CASE WHEN {c} <> '' THEN '{k}: ' || {c} END" for k, c in (("이름", "name"), ("정당", "party"), ("지역구", "district"), ("위원회", "committee"), ("당선횟수", "reelect"), ("역대대수", "terms_list"), ("성별", "gender"))) + ") AS text FROM v_member) SELECT substr(sha256('member:' || mona_cd || ':' || substr(text, 1, 80)), 1, 16) AS chunk_id, mona_cd AS ref_id, text FROM t WHERE text <> ''",
    "h5_not_indexed": "SELECT chunk_id, length(min(text)) AS n FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE embed_config_ver = 'e1-64' AND chunk_idx % 2 = 0 AND chunk_id IS NOT NULL) GROUP BY 1",
    "h7_export_counts": "SELECT source, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) FILTER (NOT (text IS NULL OR trim(text) = '')) AS kept, count(DISTINCT chunk_id) FILTER (NOT (text IS NULL OR trim(text) = '')) AS ids FROM chunks GROUP BY 1",
    "g20_length_histogram": "SELECT CASE " + " ".join(f"WHEN length(text) <= {e} THEN '<={e}'" for e in (200, 400, 600, 800, 1000, 1500, 2000)) + " ELSE '>2000' END AS bucket, count(*) AS n, avg(length(text)) AS mean, max(length(text)) AS longest FROM chunks WHERE text IS NOT NULL GROUP BY 1",
    "g21_norms": "SELECT min(x) AS least, avg(x) AS mean, max(x) AS most FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings)",
    "r1_knn": f"WITH {_KNN} SELECT vec_id, round(score, 9) AS score, rank::INT AS rank FROM knn",
    "r1_knn_batch": f"WITH s AS (SELECT query, vec_id, {_COS} AS score FROM (SELECT q.vec_id AS query, e.vec_id, e.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)), t AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) - 1)::INT AS rank FROM s) SELECT query, vec_id, round(score, 9) AS score, rank FROM t WHERE rank < 30",
    "r3_ascii_tokens": "SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_/.\\-]+'))) AS token FROM documents) GROUP BY 1",
    "r5_bm25": f"WITH {_TOK}, post AS (SELECT sub_id, id, token, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT sub_id, id, sum(tf) AS dl FROM post GROUP BY ALL), st AS (SELECT sub_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1), df AS (SELECT sub_id, token, count(*) AS df FROM post GROUP BY ALL), s AS (SELECT sub_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM post JOIN df USING (sub_id, token) JOIN st USING (sub_id) JOIN dl USING (sub_id, id) WHERE token IN ({', '.join(repr(t) for t in TERMS)}) GROUP BY ALL), best AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY score DESC, id) <= 30) SELECT id, sub_id, round(score, 8) AS score, (row_number() OVER (ORDER BY score DESC, id) - 1)::INT AS rank FROM best ORDER BY score DESC, id LIMIT 30",
    "r7_rrf": f"WITH {_KNN}, l AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS rank FROM (SELECT * FROM embeddings WHERE label IS NOT NULL ORDER BY label, vec_id LIMIT 30)), j AS (SELECT coalesce(a.vec_id, b.vec_id) AS id, a.rank AS r1, b.rank AS r2 FROM knn a FULL JOIN l b ON a.vec_id = b.vec_id), s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) AS score FROM j) SELECT id, round(score, 12) AS score, (row_number() OVER (ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) - 1)::INT AS rank FROM s",
    "r13_stats": "SELECT source, count(*) AS n FROM chunks WHERE embed_config_ver = 'e1-64' GROUP BY 1",
    "m3_weights": f"WITH {_CORPUS_TFIDF} SELECT doc_id, term, round(weight, 9) AS weight FROM weights",
    "m4_attributes": f"WITH {_CORPUS_TFIDF}, k(attr, keyword) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CORPUS_KEYWORDS) + "), f AS (SELECT attr, keyword AS term, 2.0 AS factor FROM k WHERE keyword IN (SELECT term FROM weights) UNION ALL SELECT attr, unnest(string_split(keyword, ' ')), 0.5 FROM k WHERE keyword NOT IN (SELECT term FROM weights) AND contains(keyword, ' ')), s AS (SELECT doc_id, attr, sum(weight * factor) AS score FROM weights JOIN f USING (term) GROUP BY 1, 2) SELECT doc_id, attr, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, attr DESC) = 1",
    "g23_centroids": f"WITH {_CENT} SELECT label, i::INT AS i, round(m, 9) AS x FROM cells",
    "m10_nearest": f"WITH {_CENT}, e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), dd AS (SELECT e.label, vec_id, sqrt(sum((v - m) * (v - m))) AS distance FROM e JOIN cells USING (label, i) GROUP BY 1, 2) SELECT label, vec_id, round(distance, 8) AS distance FROM dd QUALIFY row_number() OVER (PARTITION BY label ORDER BY dd.distance, vec_id) <= 5",
    "j12_centroid_pairs": f"WITH {_CENT} SELECT x.label AS a, y.label AS b, round(sum(x.m * y.m) / (sqrt(sum(x.m * x.m)) * sqrt(sum(y.m * y.m))), 8) AS similarity FROM cells x JOIN cells y ON x.i = y.i AND x.label < y.label GROUP BY 1, 2",
    "g18_fingerprint": "WITH h AS (SELECT ('0x' || substr(md5(concat_ws('|', coalesce(bill_id, '~'), coalesce(bill_name, '~'), coalesce(committee, '~'))), 1, 15))::BIGINT AS h FROM v_bill) SELECT count(*) AS n, bit_xor(h) AS xor, sum(h::DECIMAL(38, 0)) AS total FROM h",
    "g18_bill_fingerprint": "WITH h AS (SELECT ('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in _V_BILL) + ")), 1, 15))::BIGINT AS h FROM v_bill) SELECT count(*) AS n, bit_xor(h) AS xor, sum(h::DECIMAL(38, 0)) AS total FROM h",
    "d3_touched": "SELECT count(*) AS n FROM news_articles WHERE ingested_at >= TIMESTAMP '2022-01-01'",
    "d7_uncastable": "SELECT vote_date AS value, count(*) AS n FROM v_vote WHERE vote_date IS NOT NULL AND NOT regexp_matches(vote_date, '^\\d{1,9}$') GROUP BY 1",
}
