"""Lines repeated across one source's documents (problem 2).

Per-source line counts are kept in tables. A new partition of articles is merged as a delta: articles and lines that the
tables have already are taken out by anti joins, the rest is counted and added. Then the lines that cross the
threshold are told from those that fall below it because their source has grown, and only documents that hold such a
line, or came with the partition, are marked anew and rebuilt.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.p5_copies import digest, keys, linked, loose
from orrery.session import broadcast_checked, shared_folder

MIN_ARTICLES = 3
MIN_SHARE = 0.05
#: The arrival months are folded in as so many partitions.
STEPS = 3

_MAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]*[a-z0-9]")
# Words before or behind which a line gives a person's name.
_KO_NAME = re.compile(r"[가-힣]{2,4}(?=(?:선임|수습|객원|전문|인턴)?(?:기자|특파원|논설위원|통신원|리포터|앵커))")
_EN_NAME = re.compile(r"(reporting|editing|written|story|photo|photographs|words|text|compiled)by[^;|,·/]*")
_TITLE = re.compile("기자|특파원|논설위원|통신원|리포터|앵커")
_DATE = re.compile(r"오전|오후|(?<=\d)(?:am|pm)")
_DIGIT, _NUMBER, _ZEROS, _MARKS = re.compile(r"\d"), re.compile(r"\d[\d.,:/-]*"), re.compile("0+"), re.compile(r"[^\w@]+|_+")
_NO_SIGN = {ord(c): None for c in "©ⓒⒸ"}


def line_key(line: str) -> str:
    """The wording without spacing, case, punctuation, leading marks, numbers, dates, mail and personal names; empty for
    lines without letters and digits."""
    s = line if line.isascii() else unicodedata.normalize("NFKC", line.translate(_NO_SIGN))
    s = s.lower()
    if "@" in s:
        s = _MAIL.sub("@", s)
    s = "".join(s.split())
    if "by" in s:
        s = _EN_NAME.sub(r"\1by", s)
    if _TITLE.search(s):
        s = _KO_NAME.sub("", s)
    if _DIGIT.search(s):
        s = _NUMBER.sub("0", _DATE.sub("", s))
        s = _ZEROS.sub("0", _MARKS.sub("", s))
    else:
        s = _DATE.sub("", s)
        s = _MARKS.sub("", s)
    return s if s.strip("@") else ""


_LINES = "provider string, news_id string, article long, line_no long, line long"


def _lines(batches):
    for pdf in batches:
        out = []
        for prov, nid, text in zip(pdf["provider"], pdf["news_id"], pdf["content"]):
            k1, k2 = keys(text) or (digest("\0" + nid),) * 2
            out.append((prov, nid, k2, 0, k1))
            for k, line in enumerate(text.split("\n"), 1):
                if w := line_key(line):
                    out.append((prov, nid, k2, k, digest(w)))
        yield pd.DataFrame(out, columns=["provider", "news_id", "article", "line_no", "line"]).astype({"article": np.int64, "line_no": np.int64, "line": np.int64})


def lines(articles: DataFrame) -> DataFrame:
    """(provider, news_id, article, line_no, line) of every line with letters or digits, line being the digest of its
    wording and article the second key of problem 5. A row with line_no 0 stands for the article itself and holds its
    first key. Null news_ids have no rows; null and empty contents only the row 0, under a key of their own."""
    base = articles.where(F.col("news_id").isNotNull()).select(F.coalesce(loose(F.col("provider")), F.lit("")).alias("provider"), "news_id", F.coalesce("content", F.lit("")).alias("content"))
    return base.mapInPandas(_lines, _LINES)


class Counts:
    """The stored tables of all sources, in one folder. Each holds a part for every step:

    lines    the line rows of the step's articles
    known    (provider, article) first seen in the step
    links    (provider, k1, k2) of the step's articles
    pairs    (provider, line, article) first seen in the step
    counts   (provider, line, n): what the step's pairs add
    crossed  (provider, line) over the threshold after the step, whole
    marks    (provider, line, news_id, line_no) of these lines after the step, whole
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/furniture-{uuid.uuid4().hex}"
        self.min_articles, self.min_share, self.step = min_articles, min_share, 0

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{self.step:06d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self, name: str, step: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.step if step is None else step:06d}")

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}/{k:06d}" for k in range(1, (self.step if upto is None else upto) + 1)])

    def add(self, articles: DataFrame) -> DataFrame:
        """Merge a partition of articles; (news_id) of the documents to be rebuilt comes out."""
        self.step += 1
        rows = self._put("lines", lines(articles))
        first = self.step == 1
        heads = rows.where("line_no = 0").select("provider", F.col("line").alias("k1"), "article").distinct()
        self._put("links", heads.withColumnRenamed("article", "k2"))
        arrived = heads.select("provider", "article").distinct()
        fresh = self._put("known", arrived if first else arrived.join(self.table("known", self.step - 1), ["provider", "article"], "left_anti"))
        pairs = rows.where("line_no > 0").select("provider", "line", "article").distinct()
        if not first:  # only articles seen before can have lines that are counted already
            old = pairs.join(fresh, ["provider", "article"], "left_anti").join(self.table("pairs", self.step - 1), ["provider", "line", "article"], "left_anti")
            pairs = pairs.join(fresh, ["provider", "article"], "left_semi").unionByName(old)
        pairs = self._put("pairs", pairs)
        self._put("counts", pairs.groupBy("provider", "line").agg(F.count("*").alias("n")))
        over = self._put("crossed", self.over())
        if first:
            marks, touched = marked(rows, over), None
        else:
            before = self.part("crossed", self.step - 1)
            risen = over.join(before, ["provider", "line"], "left_anti")
            fallen = before.join(over, ["provider", "line"], "left_anti")
            kept, gone = (self.part("marks", self.step - 1).join(broadcast_checked(fallen), ["provider", "line"], how) for how in ("left_anti", "left_semi"))
            anew = marked(self.table("lines", self.step - 1), risen)
            marks = kept.unionByName(anew).unionByName(marked(rows, over)).distinct()
            touched = gone.select("news_id").unionByName(anew.select("news_id"))
        self._put("marks", marks)
        came = rows.where("line_no = 0").select("news_id")
        return (came if touched is None else came.unionByName(touched)).distinct()

    def over(self) -> DataFrame:
        """(provider, line) at or over both thresholds now. Copies that only a chain of keys links are one article: what they
        count too much is taken off again."""
        by, links = ["provider"], self.table("links")
        several = links.groupBy("provider", "k1").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).where("a < b").select("provider", "k1")
        alias = linked(links, several, by).withColumnRenamed("k2", "article").persist()
        excess = (F.count_distinct("article") - F.count_distinct("least")).alias("excess")
        twice = self.table("pairs").join(broadcast_checked(alias), ["provider", "article"]).groupBy("provider", "line").agg(excess).where("excess > 0")
        total = self.table("known").groupBy("provider").agg(F.count("*").alias("total")).join(alias.groupBy("provider").agg(excess), "provider", "left").select("provider", (F.col("total") - F.coalesce("excess", F.lit(0))).alias("total"))
        n = self.table("counts").groupBy("provider", "line").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_articles)
        n = n.join(twice, ["provider", "line"], "left").withColumn("n", F.col("n") - F.coalesce("excess", F.lit(0))).where(F.col("n") >= self.min_articles)
        return n.join(total, "provider").where(F.col("n") >= F.col("total") * self.min_share).select("provider", "line")

    def hits(self) -> DataFrame:
        return self.part("marks").select("news_id", "line_no").distinct()


def marked(line_rows: DataFrame, furniture: DataFrame) -> DataFrame:
    """(provider, line, news_id, line_no) of the lines whose wording is furniture of their source; there are at most
    1 / min_share times the mean number of lines an article has of it per source, and it is broadcast if its checked size
    allows."""
    return line_rows.where("line_no > 0").join(broadcast_checked(furniture), ["provider", "line"], "left_semi").select("provider", "line", "news_id", "line_no")


def partitions(articles: DataFrame, steps: int = STEPS) -> list[DataFrame]:
    """The articles by month of arrival, consecutive months together such that there are at most `steps` parts of about
    equal size; articles without a time of arrival come first. The driver gets a row per month."""
    month = F.coalesce(F.date_format("ingested_at", "yyyy-MM"), F.lit(""))
    n = sorted((r["m"], r["n"]) for r in articles.groupBy(month.alias("m")).agg(F.count("*").alias("n")).collect())
    total, seen, last = sum(k for _, k in n), 0, [""]
    for m, k in n:
        if len(last) < steps and seen >= total * len(last) / steps:
            last.append(m)
        seen += k
    return [articles.where((month >= a) & (month < b if b else F.lit(True))) for a, b in zip(last, [*last[1:], None])]


def folded(articles: DataFrame, steps: int = STEPS) -> Counts:
    """The tables after all partitions of arrival."""
    state = Counts(articles.sparkSession)
    for part in partitions(articles, steps):
        state.add(part)
    return state


def found(articles: DataFrame) -> DataFrame:
    return folded(articles).hits()


def rebuild(articles: DataFrame, hits: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(news_id, content, removed) of the articles that hold one of the (news_id, line_no) hits, without these lines; of the
    news_ids in `only`, if it is given, all, with those that hold none any more as they are. Other articles don't come
    out; rows loaded again come out once per distinct content."""
    cut = hits.groupBy("news_id").agg(F.collect_set("line_no").alias("cut"))
    text = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains("cut", (i + 1).cast("long")))
    rows = articles.select("news_id", "content")
    rows = rows.join(cut, "news_id") if only is None else rows.join(only, "news_id", "left_semi").join(cut, "news_id", "left").withColumn("cut", F.coalesce("cut", F.array().cast("array<bigint>")))
    return rows.select("news_id", F.array_join(text, "\n").alias("content"), F.size("cut").cast("long").alias("removed")).distinct()
