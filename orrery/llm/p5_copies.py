"""Duplicates hidden by formatting differences (problem 5).

Progressive partition refinement: records fall into classes by invariants that no typesetting and no order of fields
changes (number of letters and digits, hash of their histogram). A bitmap of the classes with several members goes
into the second scan, where only their rows get the costlier keys: the digest of the letters and digits in order, and
the digest with the labelled fields sorted. A key counts inside its class only, so two records agree when length,
histogram hash and a 64-bit digest agree. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.bits import bitmap, has
from orrery.session import broadcast_checked, checkpointed

_NON = re.compile(r"[\W_]+")
_LETTER, _COLON = re.compile(r"[^\W\d_]"), re.compile("[:：]")
#: Fewer `label: value` lines than this have one order only.
MIN_FIELDS = 2
#: Groups with more members than this are joined under salts.
HOT = 100_000
SALTS = 32
CLASS = ["provider", "n", "hist"]


def stripped(text: str) -> str:
    """Letters and digits in lower case."""
    return _NON.sub("", text.lower())


def digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def histogram(s: str) -> int:
    """A hash of the multiset of characters: equal for any order, by one pass over the code points."""
    x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return int(x.sum(dtype=np.uint64).astype(np.int64))


def is_field(line: str) -> bool:
    """Whether the line is `label: value`: a letter stands before its first colon."""
    m = _COLON.search(line)
    return m is not None and _LETTER.search(line, 0, m.start()) is not None


def keys(text: str) -> tuple[int, int] | None:
    """(digest in order, digest with sorted fields); None without letters and digits."""
    plain = stripped(text)
    if not plain:
        return None
    fields, rest = [], []
    for line in text.split("\n"):
        (fields if is_field(line) else rest).append(stripped(line))
    if len(fields) < MIN_FIELDS:
        return digest(plain), digest(plain)
    return digest(plain), digest("\n".join(["".join(rest), *sorted(fields)]))


def loose(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def _invariants(batches):
    for pdf in batches:
        s = [stripped(t) for t in pdf["content"]]
        yield pd.DataFrame({"provider": pdf["provider"], "news_id": pdf["news_id"], "n": [len(x) for x in s], "hist": [histogram(x) for x in s]})


def _keyed(bits: np.ndarray):
    def run(batches):
        for pdf in batches:
            plain = [stripped(t) for t in pdf["content"]]
            hist = np.array([histogram(x) for x in plain], dtype=np.int64)
            some = np.flatnonzero(has(bits, hist) & np.array([x != "" for x in plain], dtype=bool))
            out = [(pdf["provider"].iat[i], pdf["news_id"].iat[i], len(plain[i]), hist[i], *keys(pdf["content"].iat[i])) for i in some]
            yield pd.DataFrame(out, columns=["provider", "news_id", "n", "hist", "k1", "k2"]).astype({"n": "int32", "hist": "int64", "k1": "int64", "k2": "int64"})

    return run


def groups(articles: DataFrame) -> DataFrame:
    """(provider, news_id, keep) of every member of a group of two or more copies; keep is the smallest news_id.

    Null news_ids and contents, and contents without letters and digits, belong to no group; null providers are one
    provider, under the empty name. Rows loaded again are one member; a news_id whose contents differ stands with each.
    """
    base = articles.where(F.col("news_id").isNotNull() & F.col("content").isNotNull()).select(F.coalesce(loose(F.col("provider")), F.lit("")).alias("provider"), "news_id", "content")
    cheap = base.mapInPandas(_invariants, "provider string, news_id string, n int, hist long").where("n > 0").distinct()
    several = bitmap(cheap.groupBy(*CLASS).agg(F.count("*").alias("members")).where("members > 1").persist(), F.col("hist"))
    keyed = base.mapInPandas(_keyed(several), "provider string, news_id string, n int, hist long, k1 long, k2 long").distinct().persist()
    one = components(keyed, keyed.groupBy(*CLASS, "k1").agg(F.min("k2").alias("g"), F.max("k2").alias("top"), F.count("*").alias("members")).persist())
    split = salted_join(keyed, one, [*CLASS, "k1"]).select(*CLASS, "news_id", "g").persist()
    kept = split.groupBy(*CLASS, "g").agg(F.min("news_id").alias("keep"), F.max("news_id").alias("last"), F.count("*").alias("members")).where("keep < last").drop("last")
    return salted_join(split, kept, [*CLASS, "g"]).select("provider", "news_id", "keep").distinct()


def components(keyed: DataFrame, one: DataFrame, by: list[str] = CLASS) -> DataFrame:
    """(*by, k1, g, members) of every k1, where g is the least k2 that can be reached over shared keys of either kind."""
    names = linked(keyed, one.where("g < top").select(*by, "k1"), by).select(*by, F.col("k2").alias("g"), "least")
    return one.join(names, [*by, "g"], "left").select(*by, "k1", F.coalesce("least", "g").alias("g"), "members")


def linked(keyed: DataFrame, several: DataFrame, by: list[str]) -> DataFrame:
    """(*by, k2, least) of the k2 that a k1 with several k2 (one of `several`) links to others; least is the smallest of the
    component. Over these keys, never over rows, minima are exchanged until none changes."""
    links = checkpointed(keyed.select(*by, "k1", "k2").distinct().join(several, [*by, "k1"]).withColumn("g", F.col("k2")))
    while True:
        for k in ("k1", "k2"):
            links = links.withColumn("g" if k == "k2" else "h", F.min("g" if k == "k1" else "h").over(Window.partitionBy(*by, k)))
        # After the exchange over k2, all is settled if no k1 holds two values.
        links = checkpointed(links.drop("h"))
        if links.groupBy(*by, "k1").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a < b").limit(1).count() == 0:
            break
    return links.select(*by, "k2", F.col("g").alias("least")).distinct()


def salted_join(rows: DataFrame, one: DataFrame, on: list[str], hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """Join rows to a table with one row per key and the key's `members`. Keys with more than `hot` members are spread over
    salts, taken from the rows themselves so that a task that runs again gives the same, so a key that holds a third of all rows fills many tasks; the others are joined as they are. There are at most
    rows / hot such keys."""
    big = one.where(F.col("members") > hot).select(*on)
    if big.limit(1).count() == 0:
        return rows.join(one.drop("members"), on)
    marked = rows.join(broadcast_checked(big).withColumn("_hot", F.lit(True)), on, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    spread = F.when(F.col("members") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_salt", salt).drop("_hot").join(one.withColumn("_salt", F.explode(spread)).drop("members"), [*on, "_salt"]).drop("_salt")


def found(articles: DataFrame) -> DataFrame:
    """(news_id_keep, news_id_copy), one row per copy besides the kept one."""
    return groups(articles).where("news_id <> keep").select(F.col("keep").alias("news_id_keep"), F.col("news_id").alias("news_id_copy")).distinct()


def collapsed(articles: DataFrame) -> DataFrame:
    """One row per record (provider, news_id, copies): groups under their kept news_id, all other articles by themselves."""
    g = groups(articles)
    every = articles.where(F.col("news_id").isNotNull()).select(F.coalesce(loose(F.col("provider")), F.lit("")).alias("provider"), "news_id").distinct()
    alone = every.join(g.select("provider", "news_id"), ["provider", "news_id"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
    return g.groupBy("provider", F.col("keep").alias("news_id")).agg(F.count("*").alias("copies")).unionByName(alone)
