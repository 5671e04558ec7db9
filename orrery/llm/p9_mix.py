"""Mixing sources to target weights (problem 9), by balanced sampling with the cube method.

Every document of a source has the same expected number of uses, the source's target tokens over its tokens. The whole
part is used as it is; the fractions move through the null space of the balancing constraints (tokens and documents of
the source), block by block, until each block has at most two documents left between 0 and 1. These go into the next,
much smaller level, and the last two of a source are landed where the tokens come out nearest.
"""

from __future__ import annotations

import math
import random
from itertools import product

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.tokens import TOKENIZER, sized

BLOCK = 4096
_EPS = 1e-9


def flight(p: list[float], tokens: list[int], rng: random.Random) -> list[float]:
    """Inclusion probabilities moved until at most two lie between 0 and 1; their sum and their sum weighted by tokens
    stay the same, and each keeps its expectation."""
    p = list(p)
    live = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    act: list[int] = []
    k = 0
    while True:
        while len(act) < 3 and k < len(live):
            act.append(live[k])
            k += 1
        if len(act) < 3:
            break
        a, b, c = act
        u = [tokens[b] - tokens[c], tokens[c] - tokens[a], tokens[a] - tokens[b]]
        if not any(u):
            u = [1, -1, 0]
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(act, u) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(act, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(act, u):
            p[i] += step * x
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
        act = [i for i in act if 0 < p[i] < 1]
    return p


def landing(p: list[float], tokens: list[int]) -> list[float]:
    """The few probabilities left rounded such that the tokens, then the documents, come nearest to what was expected."""
    live = [i for i, x in enumerate(p) if 0 < x < 1]
    want, docs = sum(p[i] * tokens[i] for i in live), sum(p[i] for i in live)
    best = min(product((0.0, 1.0), repeat=len(live)), key=lambda z: (abs(sum(x * tokens[i] for x, i in zip(z, live)) - want), abs(sum(z) - docs), z))
    out = list(p)
    for i, x in zip(live, best):
        out[i] = x
    return out


def _level(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        tokens = pdf["tokens"].tolist()
        rng = random.Random(f"{seed}|{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}|{len(pdf)}")
        p = flight(pdf["p"].tolist(), tokens, rng)
        return pdf.assign(p=landing(p, tokens) if last else p)[["doc_id", "source", "tokens", "whole", "p"]]

    return run


_ROW = "doc_id long, source string, tokens long, whole long, p double"


def loose_source(c):
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), r"[\s_-]+", "_")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, rate, documents): the expected uses of each document. One row per source that is listed and has
    tokens, so as many rows as the target table at most.

    Shares of sources without documents go to the others in proportion. The total is the largest at which no source
    needs more than its repeats allow."""
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy(loose_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("max_repeats"))
    s = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).where("tokens > 0").join(t, "source")
    total = s.agg(F.sum("share").alias("all"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).alias("total"))
    return s.crossJoin(F.broadcast(total)).select("source", (F.col("share") / F.col("all")).alias("share"), F.least(F.col("share") * F.col("total") / F.col("tokens"), F.col("max_repeats")).alias("rate"), "documents")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, repeats, tokens) of the chosen documents; tokens is the size of one use.

    Sources are compared without surrounding space, letter case and kind of separator. Documents of unlisted and null
    sources and documents without tokens are never chosen; a repeated doc_id is one document, with its largest size.
    """
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull()).select(F.col("doc_id").cast("long"), loose_source(F.col("source")).alias("source"), "text")
    sizes = sized(docs, tokenizer).where("tokens > 0").groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_id", "m.source", "m.tokens").persist(StorageLevel.MEMORY_AND_DISK)
    rates = plan(sizes, targets).collect()  # a row per listed source
    if not rates:
        return sizes.select("doc_id", "source", F.col("tokens").alias("repeats"), "tokens").limit(0)
    spark = documents.sparkSession
    table = spark.createDataFrame([(r["source"], math.floor(r["rate"] + 1e-12), max(0.0, r["rate"] - math.floor(r["rate"] + 1e-12))) for r in rates], "source string, whole long, p double")
    rows = sizes.join(F.broadcast(table), "source").select("doc_id", "source", "tokens", "whole", "p")
    left = {r["source"]: r["documents"] for r in rates}
    settled = []
    while True:
        n = {s: max(1, math.ceil(k / block)) for s, k in left.items()}
        last = max(n.values()) == 1
        blocks = F.element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), F.col("source"))
        moved = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(len(settled))), blocks)).groupBy("source", "block").applyInPandas(_level(last, seed), _ROW).persist(StorageLevel.MEMORY_AND_DISK)
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(moved.where(~open_))
        if last:
            break
        rows = moved.where(open_)
        left = {s: 2 * k for s, k in n.items()}
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", (F.col("whole") + F.round("p").cast("long")).alias("repeats"), "tokens").where("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, uses, tokens, actual_share) of every listed source, those without documents too."""
    t = targets.where(F.col("source").isNotNull()).groupBy(loose_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"))
    every = got.agg(F.sum("tokens").alias("every"))
    return (
        t.join(got, "source", "left").crossJoin(F.broadcast(every)).na.fill(0, ["documents", "uses", "tokens"])
        .select("source", "target_share", "documents", "uses", "tokens", F.coalesce(F.try_divide(F.col("tokens"), F.col("every")), F.lit(0.0)).alias("actual_share"))
    )


def bounds(mixed: DataFrame, targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(source, target, reached, repeats_ok) of every listed source that has documents: its share among such sources, whether
    the share of tokens is within the tolerance of it, and whether no document is used too often."""
    t = targets.where(F.col("source").isNotNull()).groupBy(loose_source(F.col("source")).alias("source")).agg(F.min("max_repeats").alias("cap"))
    got = shares(mixed, targets).where("tokens > 0")
    every = got.agg(F.sum("target_share").alias("all"))
    used = mixed.groupBy("source").agg(F.max("repeats").alias("most"))
    target = F.col("target_share") / F.col("all")
    return got.crossJoin(F.broadcast(every)).join(t, "source").join(used, "source").select("source", F.round(target, 9).alias("target"), (F.abs(F.col("actual_share") - target) <= tolerance).alias("reached"), (F.col("most") <= F.col("cap")).alias("repeats_ok"))
