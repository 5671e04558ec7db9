import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import age as A
from orrery.functions import text as X
from orrery.functions.dates import loose_date
from orrery.operators import audit, chunking, cleaning, orphans, relational, retrieval, stats, topics
from orrery.plans import registry, sqltool
from orrery.sources import files, tasks
from orrery.streaming import events

#: One case per rule, and both sides of each boundary.
AGE_CASES = [
    ("none", {}, "x__AGE_20", None), ("join:other.KEY", {"KEY": "21"}, "x__AGE_20", None), ("constant:17", {"AGE": "3"}, None, 17),
    ("param:AGE", {}, "t__YEAR_2023__AGE_18", 18), ("param:YEAR", {}, "t__AGE_18", None), ("param:AGE", {}, None, None),
    ("column:ERACO", {"ERACO": " 18대 국회 "}, None, 18), ("column:ERACO", {"ERACO": "18대 의회"}, None, None), ("column:ERACO", {"ERACO": None}, None, None),
    ("column:UNIT_CD", {"UNIT_CD": "100001"}, None, 1), ("column:UNIT_CD", {"UNIT_CD": "100099"}, None, 99), ("column:UNIT_CD", {"UNIT_CD": "100100"}, None, None),
    ("column:PROFILE_UNIT_CD", {"PROFILE_UNIT_CD": "100000"}, None, None), ("column:NO", {"NO": "약 7대쯤"}, None, 7), ("column:NO", {"NO": " 19.0 "}, None, 19), ("column:NO", {}, None, None),
    ("date:D", {"D": "2020-05-29"}, None, 20), ("date:D", {"D": "2020.05.30."}, None, 21), ("date:D", {"D": "2020"}, None, 21), ("date:D", {"D": "soon"}, None, None), ("date:D", {"D": "1901-01-01"}, None, None),
]


@pytest.mark.parametrize("source,row,key,expected", AGE_CASES)
def test_derived_age(spark, source, row, key, expected):
    df = spark.range(1)
    got = df.select(A.derived_age(source, {k: F.lit(v) for k, v in row.items()}, F.lit(key).cast("string")).alias("x")).first()[0]
    assert got == expected


def test_term_of_date_edges(spark):
    days = ["1948-05-29", "1948-05-30", "2024-05-29", "2024-05-30", "20240530", "bad", None, "2024-13-45", ""]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert [r[0] for r in df.select(A.term_of_date(F.col("d"))).collect()] == [None, 1, 21, 22, 22, None, None, None, None]


def test_loose_date(spark):
    df = spark.createDataFrame([(x,) for x in ["20200105", "2020-01-05", "2020.1.5", "2020년 1월 5일", "20200105 101112", "2020-01-05 10:11:12", "", None, "x", "2020-02-31"]], "d string")
    assert [r[0] for r in df.select(loose_date(F.col("d"))).collect()] == [dt.date(2020, 1, 5)] * 6 + [None] * 4


ROW = "news_id string, provider string, title string, content string, published_at timestamp_ntz, byline string, provider_link_page string"


def news(spark, *rows):
    base = dict(news_id="1", provider="p", title="", content="", published_at=None, byline=None, provider_link_page=None)
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in ROW.split(", ")) for r in rows], ROW)


def test_sanitize_and_relevance(spark):
    df = news(spark, {"content": "a\nAI 앵커가 전합니다\nb"}, {"content": "AI가 대체 못 하는 일"}, {"content": "x(AI 학습 포함)y"}, {"content": None})
    assert [r[0] for r in df.select(cleaning.sanitized(F.col("content"))).collect()] == ["a\n\nb", "", "xy", None]
    latin = "AI " + "x" * 198
    cases = [("AI가 왔다", True), ("SAID no", False), (latin, False), (latin[:200], True), ("조류인플루엔자 AI", False), ("조류인플루엔자 AI 인공지능", True), ("AI 사이버대학", False), ("AI 문의 모집요강 장학금", False), ("AI 문의 모집요강", True), ("[사진 기사]\n", False), (None, None)]
    df = news(spark, *[{"news_id": str(i), "title": "t" if c != "[사진 기사]\n" else "AI", "content": c} for i, (c, _) in enumerate(cases)])
    got = {r[0] for r in df.where(cleaning.relevant(F.col("title"), F.col("content"), cleaning.sanitized(F.col("content")))).select("news_id").collect()}
    assert got == {str(i) for i, (_, ok) in enumerate(cases) if ok}


def test_dedup_order_and_idempotence(spark):
    t = dt.datetime(2020, 1, 1)
    df = news(spark, {"news_id": "1", "content": "a b"}, {"news_id": "2", "content": "ab", "published_at": t}, {"news_id": "3", "content": "a\nb", "published_at": t, "byline": "x"}, {"news_id": "4", "content": "ab", "provider": "q"})
    once = cleaning.dedup(df)
    assert {r.news_id for r in once.collect()} == {"3", "4"}
    assert cleaning.dedup(once).count() == 2


def test_ruleset_version_follows_rules():
    assert cleaning.ruleset_version("d") != cleaning.ruleset_version("d", cleaning.RULES[:2])
    assert cleaning.count_drift({"a": 100, "b": 50}, {"a": 100.5, "b": 60, "c": 1}) == ["b", "c"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "k int, v string, n int")
    up = lambda **kw: sorted(map(tuple, relational.upsert(old, new, ["k"], **kw).collect()))
    assert up() == [(1, "a", None), (2, None, 7), (3, "c", 1)]
    assert up(merge={"v": relational.coalesce_new("v")}) == [(1, "a", None), (2, "b", 7), (3, "c", 1)]
    assert sorted(map(tuple, relational.replace_tasks(old, new.where("k > 9"), "k").collect()), key=str) == [(1, "a", None), (2, "b", 5)]


def test_where_dict(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    pick = lambda s: [r.k for r in df.where(relational.where_dict(s)).collect()]
    assert pick({"v": "a"}) == [1] and pick({"v": {"$in": ["a", "b"]}, "k": {"$eq": 3}}) == [3] and pick({"$and": [{"v": "a"}, {"k": 2}]}) == [] and pick({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        relational.where_dict({"k": {"$gt": 1}})


def test_stage_and_swap(spark, tmp_path):
    p = str(tmp_path / "t")
    relational.stage_and_swap(spark.range(3), p)
    relational.stage_and_swap(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5
    with pytest.raises(Exception):
        relational.stage_and_swap(spark.range(2).select(F.raise_error(F.lit("no"))), p)
    assert spark.read.parquet(p).count() == 5 and [x.name for x in tmp_path.iterdir() if ".old" in x.name] == []


@pytest.mark.parametrize("n", [0, 1, 1500, 1501, 2000, 2001, 5003])
def test_windows_rebuild_the_text(spark, n):
    text = "".join(chr(0xAC00 + i % 999) for i in range(n))
    got = [r.text for r in chunking.char_chunks(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"]).orderBy("chunk_idx").collect()]
    assert got == chunking._plain(text)
    joined = got[0] if got else ""
    for part in got[1:]:
        joined = joined + part[chunking.OVERLAP :]
    assert joined == text


def test_speaker_chunks(spark):
    assert chunking.by_speaker("머리\n◯가 말\n◯나 말") == ["◯가 말\n◯나 말"]
    assert chunking.by_speaker("머리\n◯가 말", keep_head=True) == ["머리\n◯가 말"]
    long = "◯가 " + "말 " * 1000
    parts = chunking.by_speaker("◯나 짧은 말\n" + long)
    assert parts[0] == "◯나 짧은 말\n" and len(parts) > 2 and all(len(x) <= 800 for x in parts[1:])


def test_rrf_is_symmetric_in_scores(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "k string, rank int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "k string, rank int")
    one, two = ({r.k: round(r.score, 12) for r in retrieval.rrf(p, q, "k").collect()} for p, q in ((a, b), (b, a)))
    assert one == two and max(one, key=one.get) == "y"
    assert [r.k for r in retrieval.rrf(a, b, "k").orderBy("rank").collect()] == ["y", "x", "z"]


def test_search(spark, sf):
    c = spark.read.parquet(f"{sf}/chunks.parquet").dropDuplicates(["chunk_id"])
    s = retrieval.Search(c.where(F.size("vector") == 64))
    assert s.hybrid("인공지능", 3).count() <= 3
    assert {r.source for r in s.bills("인공지능", 5, vector=[1.0] * 64).collect()} <= {"bill"}


def test_shares_and_window(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("none",), (None,)], "c string")
    got = {r.c: round(r.pct, 6) for r in stats.share_without(df, [], "c").collect()}
    assert got == {"a": round(200 / 3, 6), "b": round(100 / 3, 6), "none": 0.0}
    e = spark.createDataFrame([(dt.datetime(2021, 7, 1),)], "t timestamp_ntz")
    r = stats.event_window(e, "t", None, "2021-06-15", 6).first()
    assert (r.n_before, r.n_after, r.avg_after) == (0, 1, 1.0) and math.isnan(r.pct)
    assert spark.range(1).select(stats.ema(F.array(F.lit(1.0), F.lit(2.0)))).first()[0] == pytest.approx(1.3)


def test_topics():
    assert topics.average_linkage(np.array([[1, 0], [0.99, 0.1], [0, 1.0]]), 0.9) == [0, 0, 1]
    t = [{"topic": 1, "count": 1, "keywords": ["a"], "centroid": [1, 0]}, {"topic": 2, "count": 3, "keywords": ["b", "a"], "centroid": [1, 0.01]}, {"topic": 3, "count": 1, "keywords": ["c"], "centroid": [0, 1]}]
    m = topics.merge_topics(t, 0.9)
    assert [(x["topic"], x["count"], x["keywords"]) for x in m] == [(2, 4, ["b", "a"]), (3, 1, ["c"])]
    assert topics.merge_topics([], 0.9) == []
    assert topics.greedy_pairs([(1, "x", 0.9), (1, "y", 0.95), (2, "y", 0.99)]) == [(2, "y", 0.99), (1, "x", 0.9)]


def test_weights_of_all_languages(spark, sf):
    import unicodedata
    from collections import Counter

    from orrery.plans import corpus
    from orrery.session import table

    docs, tf = table(spark, sf, "documents").where("text is not null").collect(), {}
    for r in docs:
        w = [x.lower() for x in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in r.text).split() if len(x) > 1]
        tf[r.doc_id] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df, total = Counter(t for c in tf.values() for t in c), sum(tf.values(), Counter())
    kept = sorted((t for t in df if 2 <= df[t] <= 0.95 * len(docs)), key=lambda t: (-total[t], t))[:10_000]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    want = {(d, t): n * idf[t] for d, c in tf.items() for t, n in c.items() if t in idf}
    square = Counter()
    for (d, _), x in want.items():
        square[d] += x * x
    got = {(r.doc_id, r.term): r.weight for r in corpus.m3_weights(spark, sf).collect()}
    assert got == {k: pytest.approx(x / math.sqrt(square[k[0]]), abs=1e-8) for k, x in want.items()}
    lang = {r.doc_id: (r.lang or "").strip().lower() for r in docs}
    assert {"ko", "en", "fr"} <= {lang[d] for d, _ in got} and len(idf) > 500
    assert {"ko", "en"} <= {lang[r.doc_id] for r in corpus.m4_attributes(spark, sf).collect()}


def test_topics_of_all_documents(spark, sf):
    import unicodedata
    from collections import Counter

    from orrery.plans import corpus
    from orrery.session import table

    got = {r.doc_id: r.topic for r in corpus.m5_lda(spark, sf).collect()}
    docs = table(spark, sf, "documents").where("text is not null").collect()
    words_of = {r.doc_id: {x.lower() for x in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in r.text).split() if len(x) > 1} for r in docs}
    df = Counter(w for ws in words_of.values() for w in ws)
    assert set(got) == set(words_of) and all((got[d] in range(10)) == any(df[w] > 1 for w in ws) for d, ws in words_of.items())
    two = spark.createDataFrame([(i, ["가나", "다라", "마바"] if i % 2 else ["ab", "cd", "ef"]) for i in range(60)] + [(60, ["z"])], "k int, w array<string>")
    a, words = topics.lda(two, "k", "w", topics=2)
    topic = {r.k: r.topic for r in a.collect()}
    assert len({topic[i] for i in range(0, 60, 2)}) == len({topic[i] for i in range(1, 60, 2)}) == 1 and topic[0] != topic[1] and topic[60] is None
    assert {frozenset(r.words[:3]) for r in words.collect()} == {frozenset(["가나", "다라", "마바"]), frozenset(["ab", "cd", "ef"])}


def test_curation(spark):
    t = spark.createDataFrame([("a", 1, 5, "x"), ("a", -1, 9, "o"), ("a", 2, 3, "y")], "attr string, topic_id int, count int, label string")
    drops = spark.createDataFrame([("a", 1), ("a", -1), ("z", 9)], "attr string, topic_id int")
    labels = spark.createDataFrame([("a", 2, "Y")], "attr string, topic_id int, label string")
    assert {(r.topic_id, r.label) for r in topics.curate(t, drops, labels).collect()} == {(-1, "o"), (2, "Y")}
    assert [tuple(r) for r in topics.unknown_targets(t, drops).collect()] == [("z", 9)]


def test_fingerprint_and_diff(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    fp = lambda df: tuple(audit.fingerprint(df).first())
    assert fp(a) == fp(a.orderBy(F.desc("k"))) and fp(a) != fp(a.distinct()) and fp(a) != fp(a.na.fill("")) and fp(a.limit(0)) == (0, 0, 0)
    one, two = audit.snapshot({"t": a, "u": a}), audit.snapshot({"t": a.withColumn("w", F.lit(1)), "v": a})
    assert audit.diff(one, two) == [("t", "schema_changed"), ("u", "dropped"), ("v", "created")]
    assert audit.diff(one, audit.snapshot({"t": a.withColumn("k", F.col("k") + 1), "u": a.limit(1)})) == [("t", "content_changed"), ("u", "rows_removed")]
    assert audit.diff(one, audit.snapshot({"t": a, "u": a}, {"t": 5.0}, 1.0)) == [("t", "content_unknown")]
    assert audit.diff(one, one, {"t"}) == [("t", "rewritten_identical")]
    log, now = str(tmp_path / "log"), {"df": a}
    take = lambda: audit.snapshot({"t": now["df"]})
    with audit.audit_run(log, "r1", take):
        now["df"] = a.union(a)
    with pytest.raises(RuntimeError), audit.audit_run(log, "r2", take):
        raise RuntimeError("x")
    with pytest.raises(SystemExit), audit.audit_run(log, "r3", take):
        raise SystemExit(3)
    open(log, "a").write("broken\n")
    now["df"] = a
    with audit.audit_run(log, "r4", take):
        pass
    e = audit.read_log(log)
    assert [x["status"] for x in e] == ["ok", "error", "exit:3", "ok"] and e[0]["changes"] == [["t", "rows_added"]] and e[3]["drift"] == [["t", "rows_removed"]]


def test_bill_fingerprint_sees_every_column(spark, sf, tmp_path):
    from orrery.plans import corpus
    from orrery.session import table

    bills, seen = table(spark, sf, "v_bill"), {tuple(corpus.g18_bill_fingerprint(spark, sf).first())}
    for c, kind in bills.dtypes:
        other = F.lit("x") if kind == "string" else F.col(c) + (F.expr("interval 1 day") if kind.startswith("timestamp") else 1)
        bills.withColumn(c, other).write.parquet(str(tmp_path / c / "v_bill.parquet"))
        seen.add(tuple(corpus.g18_bill_fingerprint(spark, str(tmp_path / c)).first()))
    assert len(seen) == len(bills.columns) + 1


def test_validators(spark):
    a = spark.createDataFrame([(21, "x"), (None, "y"), (22, "z")], "age int, k string")
    assert audit.validate({"t": a, "s": a.withColumn("age", F.lit("1"))}, ["t", "q"], ["t", "s"], ["t"]) == ["q: missing", "t: 1 null ages", "t: 2 ages", "s: age is string"]
    assert [tuple(r) for r in audit.uncastable(a, "k", "int").orderBy("value").collect()] == [("x", 1), ("y", 1), ("z", 1)]


def test_tasks(spark):
    t = lambda *a, **k: [r.task_key for r in tasks.tasks(spark, "x", *a, **k).orderBy("task_key").collect()]
    assert t("none") == ["x"] and t("age", ages=range(20, 22)) == ["x__AGE_20", "x__AGE_21"] and t("age_unit", ages=range(20, 21)) == ["x__UNIT_CD_100020"]
    assert t("daily", first="2024-02-28", last="2024-03-01") == ["x__DATE_2024-02-28", "x__DATE_2024-02-29", "x__DATE_2024-03-01"]
    assert len(t("age_year", ages=range(2), years=range(2020, 2023))) == 6
    b = spark.createDataFrame([("b1", 1), ("b1", 1), (None, 2)], "bill_id string, age int")
    assert t("lookup_bill", lookup=b, column="bill_id") == ["x__BILL_ID_b1"] and t("lookup_bill_age", lookup=b, column="bill_id") == ["x__AGE_1__BILL_ID_b1"]
    with pytest.raises(ValueError):
        tasks.tasks(spark, "x", "other")
    p = spark.createDataFrame([("x__AGE_22", dt.datetime(2024, 1, 1)), ("x__AGE_21", dt.datetime(2024, 1, 1)), ("x__AGE_20", None)], "task_key string, fetched_at timestamp_ntz")
    assert {r.task_key for r in tasks.stale(p, F.lit("2024-01-03").cast("timestamp_ntz"), 22).collect()} == {"x__AGE_22", "x__AGE_20"}
    w = tasks.widened(spark.createDataFrame([(" a ",)], "X string"), spark.createDataFrame([("", "q")], "x string, AGE string"))
    assert w.columns == ["x", "age"] and [tuple(r) for r in w.collect()] == [("a", None), (None, "q")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text(json.dumps({"news_id": "1", "published_at": "2020-01-02T03:04:05", "category": ["x"]}))
    (tmp_path / "a/2.json").write_text("{broken")
    (tmp_path / "a/3.json").write_text(json.dumps({"title": "no id"}))
    r = files.json_articles(spark, str(tmp_path / "a")).collect()
    assert [(x.news_id, str(x.published_at), x.category) for x in r] == [("1", "2020-01-02 03:04:05", '["x"]')]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/HR_12.txt").write_text("one\ntwo")
    (tmp_path / "t/HJRes_3.txt").write_text("x")
    assert {tuple(x) for x in files.text_bills(spark, str(tmp_path / "t")).collect()} == {("H.R. 12", "one\ntwo"), ("H.J.Res. 3", "x")}
    (tmp_path / "b").mkdir()
    for n, c in (("p", b"%PDF" + b"x" * 600), ("h", bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 600), ("z", b"PK\3\4" + b"x" * 600), ("x", b"PK\3\4mimetypeapplication/hwp+zip" + b"x" * 600), ("s", b"%PDF"), ("u", b"y" * 600)):
        (tmp_path / "b" / n).write_bytes(c)
    assert {x.path[-1]: x.format for x in files.binary_documents(spark, str(tmp_path / "b")).collect()} == {"p": "pdf", "h": "hwp", "z": "zip", "x": "hwpx", "s": "error", "u": "unknown"}
    files.write_shards(spark.range(10).toDF("i"), str(tmp_path / "s"), 4)
    assert files.row_range(files.parquet_parts(spark, str(tmp_path / "s"), "*.parquet"), "i", 3, 4).count() == 4
    files.write_csv_bom(spark.range(2).toDF("가"), str(tmp_path / "c.csv"))
    assert (tmp_path / "c.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    files.write_markdown(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "g string, i string"), str(tmp_path / "m.md"), "g", "i")
    assert (tmp_path / "m.md").read_text() == "## a (2)\n\n- x\n- y\n\n## b (1)\n\n- z\n\n"
    assert files.views(spark, "/root/testdata/sf0.001", ["nation", "nowhere"]) == ["nowhere"]


def test_law_texts(spark):
    law = "TITLE I\nArticle 1\nScope\nThis applies.\nMore.\nArticle 2\nWords\nText of two.\nCHAPTER II\nArticle 3\nEnd\nLast."
    got = spark.createDataFrame([(law,)], "t string").select(files.articles_of(F.col("t"))).first()[0]
    assert [(x.num, x.title, x.text) for x in got] == [(1, "Scope", "This applies.\nMore."), (2, "Words", "Text of two."), (3, "End", "Last.")]
    am = "Amendment 1\nArticle 5 – paragraph 2\nnew text, see Amendment 1 again\nAmendment 2\nnothing"
    got = spark.createDataFrame([(am,)], "t string").select(files.amendments_of(F.col("t"))).first()[0]
    assert [(x.num, x.target) for x in got] == [(1, "Article 5 – paragraph 2"), (2, "unknown")] and "again" in got[0].text


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.base_law(F.lit("개인정보 보호법 일부개정법률안"))) == "개인정보 보호법" and one(X.short_law(F.lit("개인정보 보호법"))) == "개인정보보호법"
    assert one(X.mentions(F.lit("AI와 A.I. 인공 지능 SAID"))) == 3
    assert one(X.strip_markup(F.lit("<style>x</style><p>a &amp; b</p><script>y</script><div>c</div>"))) == "a & b\nc"
    assert one(X.unescape(F.lit("&eacute;"))) == "é"
    assert one(X.reason_section(F.lit("표지\n제 안 이 유\n까닭은 이렇다"))) == "까닭은 이렇다"


def test_sql_tool(spark):
    spark.range(120).createOrReplaceTempView("r120")
    out = json.loads(sqltool.query(spark, "-- hi\n/* x */ SELECT id FROM r120 ORDER BY id"))
    assert len(out["rows"]) == 50 and out["more"] and sqltool.query(spark, "DROP VIEW r120").startswith("error")
    for bad in ("INSERT INTO r120 VALUES (1)", "CREATE TABLE x AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO r120 SELECT * FROM a", "SET x=1"):
        with pytest.raises(Exception):
            sqltool.guarded(spark, bad)
    assert "r120" in sqltool.list_tables(spark) and sqltool.describe(spark, "r120")["rows"] == 120


def test_streaming(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "src")
    e.repartition(3).write.parquet(src)
    got = []
    events.drain(events.windowed(events.source(spark, src, e, 1), "ts", "event_type", late="60 days"), lambda df, i: got.extend(df.collect()), str(tmp_path / "c1"), "update")
    want = {(r.start, r.event_type): r.n for r in events.windowed(e, "ts", "event_type").collect()}
    assert {(r.start, r.event_type): r.n for r in got} == want
    target = str(tmp_path / "out")
    for _ in range(2):
        events.drain(events.source(spark, src, e), events.append_new(target, "event_id"), str(tmp_path / "c2"))
    assert spark.read.parquet(target).count() == e.select("event_id").distinct().count()


def test_orphans_by_hand(spark):
    day = lambda x: dt.date(2020, 1, x)
    refs = spark.createDataFrame([("a ", day(1)), ("A", day(9)), ("b", day(1)), ("c", None), (None, day(1)), ("d", day(1)), ("d", day(1))], "bill_id string, d date")
    bills = spark.createDataFrame([("A", dt.datetime(2020, 1, 5)), ("a", dt.datetime(2020, 1, 7)), ("e", None)], "bill_id string, fetched_at timestamp_ntz")
    dead = spark.createDataFrame([("B",), ("a",)], "bill_id string")
    for share in (1, 10**9):  # all keys light, all keys heavy
        got = {tuple(r) for r in orphans.orphans([orphans.references(refs, "t", F.col("bill_id"), F.col("d"))], orphans.known_keys(bills, dead), share).collect()}
        assert got == {("t", "2020-01", "A", "late", 1), ("t", "2020-01", "B", "deleted", 1), ("t", "unknown", "C", "missing", 1), ("t", "2020-01", "D", "missing", 2)}
    none = orphans.orphans([orphans.references(refs.limit(0), "t", F.col("bill_id"), F.col("d"))], orphans.known_keys(bills.limit(0), dead.limit(0)))
    assert none.count() == 0


def test_registry_is_whole():
    q, s = registry.queries(), registry.oracle_sql()
    assert set(s) <= set(q) and registry.FLAGSHIP in q and len(q) > 120


def test_provider_with_retries(spark):
    from orrery.operators import labels

    def provider(text):
        if text == "busy":
            raise labels.Again("429")
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "busy"), (3, "bad"), (4, None)], "id int, text string")
    got = {r.id: (r.label, r.error) for r in labels.labelled(rows, "id", "text", provider, tries=2, wait=0.01).collect()}
    assert got == {1: ("A", None), 2: (None, "again: 429"), 3: (None, "ValueError: no"), 4: (None, "no text")}
    assert labels.labelled(rows.limit(0), "id", "text", provider).count() == 0


def test_ladder(spark):
    from orrery.operators import labels

    df = spark.createDataFrame([(["x low", None], 1), (["HIGH", "low"], 3), ([], 0), (None, 0)], "t array<string>, want int")
    assert all(r.got == r.want for r in df.withColumn("got", labels.highest_level(F.col("t"), {1: ["low"], 3: ["high", "top"]})).collect())


def test_stored_indexes(spark, tmp_path):
    import numpy as np

    docs = spark.createDataFrame([(1, "a b b", "s"), (2, "a c", "s"), (3, None, "s"), (4, "b", "t"), (None, "b", "t")], "id int, text string, sub string")
    ix = retrieval.Bm25Index.build(docs, "id", "text", F.col("sub"), f"{tmp_path}/bm25", tokens=lambda c: F.split(c, " "))
    again = retrieval.Bm25Index.build(docs.limit(0), "id", "text", F.col("sub"), f"{tmp_path}/bm25")  # opened, not built
    assert [r.id for r in ix.search(["b"]).collect()] == [r.id for r in again.search(["B"]).collect()] == [1, 4]
    plan = ix.search(["b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Generate" not in plan and "EqualTo(token,b)" in plan
    q = spark.createDataFrame([("q", ["b"]), ("r", ["zzz"])], "query string, terms array<string>")
    assert [r.id for r in ix.search_batch(q).orderBy("rank").collect()] == [1, 4] and ix.search([]).count() == 0
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.2 * rng.normal(size=(40, 16)) for c in rng.normal(size=(25, 16))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16)], "id int, v array<double>")
    ann = retrieval.AnnIndex.build(rows, "id", "v", f"{tmp_path}/ann")
    asked = rows.where("id % 50 = 0 and id < 1000").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    exact = {(r.query, r.id) for r in retrieval.knn_batch(rows, "id", "v", asked, 10).collect()}
    got = {(r.query, r.key) for r in ann.search_batch(asked, 10, probes=8).collect()}
    assert len(got & exact) >= 0.9 * len(exact) and ann.rows.count() == 1000
    one = {r.key for r in ann.search(x[50].tolist(), 10, probes=8).collect()}
    assert one == {k for q, k in got if q == 50}


def test_search_without_words_or_vectors(spark):
    c = spark.createDataFrame([("a", "s", None, "x", [1.0, 0.0]), ("b", "s", None, "y", [0.0, 1.0])], "chunk_id string, source string, doc_source string, text string, vector array<double>")
    s = retrieval.Search(c, bm25=None)
    assert [r.chunk_id for r in s.hybrid("x", vector=[1.0, 0.1]).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        s.hybrid("x")


def test_contract_and_embedding(spark):
    import numpy as np

    want = {"model": {"name": "m", "dim": 4, "revision": None}, "version": "1"}
    f = retrieval.contract_mismatches
    assert f(None, want) == [] and f({"model": {"name": "m", "dim": 4}, "version": "1"}, want) == []
    assert len(f({"model": {"name": "n"}}, want)) == 3
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id int, text string")
    got = retrieval.embedded(rows, "id", "text", lambda ts: np.array([[len(t), 0, 0, 0] for t in ts]), "q: ", 4).collect()
    assert [(r.id, r.vector) for r in got] == [(1, [1.0, 0.0, 0.0, 0.0])]


def test_log_prune_and_events(spark, tmp_path):
    from orrery.operators import audit

    log = f"{tmp_path}/log"
    with open(log, "w") as f:
        for i in range(4):
            f.write(f'{{"run": "r{i}", "start": {i}.0, "status": "ok", "changes": [["t{i % 2}", "rows_added"]]}}\n')
        f.write("broken\n")
    assert audit.events(audit.log_table(spark, log), "t1", 2).count() == 1
    assert audit.prune(log, 2) == 3 and [e["run"] for e in audit.read_log(log)] == ["r2", "r3"]
    with pytest.raises(ValueError):
        audit.cast_column(spark.createDataFrame([("1",), ("x",)], "a string"), "a", "int")
    assert dict(audit.cast_column(spark.createDataFrame([("1",)], "a string"), "a", "int").dtypes)["a"] == "int"


def test_whole_json_and_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":\n 1}')
    assert files.json_whole(spark, f"{tmp_path}/*.json").first().a == 1 and files.json_whole(spark, f"{tmp_path}/*.none") is None
    spark.range(7).write.parquet(f"{tmp_path}/p")
    assert files.parquet_rows(spark, f"{tmp_path}/p") == 7


def test_shards_and_digests(spark, tmp_path):
    import hashlib

    m = files.shards(spark.range(25).coalesce(1), f"{tmp_path}/s", rows_per_file=10).collect()
    assert len(m) == 3 and all(hashlib.sha256((tmp_path / "s" / r.file).read_bytes()).hexdigest() == r.sha256 for r in m)


def test_paged_source(spark):
    import json as j
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from orrery.sources import paged

    failed = set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            bad = 400 if q["size"] > 100 else 503 if q["page"] == 2 and not failed else 0
            if bad:
                failed.update([1] if bad == 503 else [])
                self.send_response(bad)
                self.end_headers()
                return
            a = (q["page"] - 1) * q["size"]
            body = j.dumps({"data": {"total": 230, "rows": [{"id": i} for i in range(a, min(230, a + q["size"]))]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = paged.paged(spark, f"http://127.0.0.1:{server.server_port}/x", totalPath="data.total", rowsPath="data.rows", perSecond=100, pagesPerTask=2)
    assert sorted(x["id"] for x in map(j.loads, (r.value for r in df.collect()))) == list(range(230)) and failed
    server.shutdown()
