"""Most similar vectors for every vector (problem 4), by multi-index hashing.

Rotations learned on a bounded sample (principal axes, then alternating between signs and the nearest rotation) turn
vectors into binary codes of several substrings, each about as wide as log2 of the number of vectors, so that buckets
hold a few vectors each at any size. By the pigeonhole principle codes within a Hamming radius agree in one substring
up to one bit; every substring is probed exactly and with one flipped bit. There are as many substrings as the sample
shows to be needed for the wanted recall. Pairs that agree in a substring meet inside its bucket, where their vectors
are at hand; pairs that agree only up to a flipped bit are retrieved by their codes, and their vectors joined. Both are
reranked on floats.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.session import broadcast_checked

DIM = 64
#: Substrings are log2(vectors / LOAD) bits wide.
LOAD = 4
MIN_SUBS, MAX_SUBS, MAX_BITS = 4, 16, 30
#: Recall wanted of the probes, measured on the sample's own nearest pairs when the rotations are learned.
RECALL = 0.96
TOP = 5
MIN_COSINE = 0.85
#: Codes that differ in more than this share of their bits are not compared on floats: vectors of a cosine of MIN_COSINE,
#: an angle of 32 degrees, differ in 18 % on average, and of the nearest pairs 0.4 % differ in more than a quarter.
RADIUS = 0.25
#: The rotation is fitted on about so many vectors, taken by the hash of their ids; all vectors are indexed.
SAMPLE = 8192
ITERATIONS = 30
#: Buckets with more vectors than this are split into blocks; every pair of blocks is compared in a task of its own.
BUCKET = 2000


def usable(v: Column, dim: int = DIM) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def learn(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) such that the signs of (x - mean) @ rotation are near the rotated vectors."""
    mean = x.mean(0)
    v = x - mean
    _, axes = np.linalg.eigh(v.T @ v / max(1, len(v)))
    v = v @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(ITERATIONS):
        a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (a @ b).T
    return mean, axes @ r


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Learned rotations, and the codes they give: `subs` substrings of `bits` bits."""

    def __init__(self, sample: np.ndarray, n: int):
        self.bits = int(min(MAX_BITS, max(4, math.ceil(math.log2(max(n, 2) / LOAD)))))
        self.learned = [learn(sample, seed) for seed in range(math.ceil(MAX_SUBS * self.bits / DIM))]
        self.subs = MAX_SUBS
        pairs = self._nearest(sample)
        codes = self.of(sample)
        miss = np.ones(len(pairs), dtype=bool)
        for s in range(MAX_SUBS):
            x = codes[pairs[:, 0], s] ^ codes[pairs[:, 1], s]
            miss &= np.bitwise_count(x) > 1
            if s + 1 >= MIN_SUBS and miss.mean() <= 1 - RECALL if len(pairs) else s + 1 == MIN_SUBS:
                self.subs = s + 1
                break
        self.learned = self.learned[: math.ceil(self.subs * self.bits / DIM)]
        self.radius = int(RADIUS * self.subs * self.bits)

    @staticmethod
    def _nearest(x: np.ndarray) -> np.ndarray:
        """The sample's pairs of at least MIN_COSINE that are among the nearest of one of them."""
        out = []
        for a in range(0, len(x), 1024):
            c = x[a : a + 1024] @ x.T
            c[np.arange(len(c)), np.arange(a, a + len(c))] = -1
            j = c.argmax(1)
            i = np.flatnonzero((c[np.arange(len(c)), j] >= MIN_COSINE) & (c[np.arange(len(c)), j] < 1 - 1e-9))
            out.append(np.stack([i + a, j[i]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """int32 substrings of unit vectors, a row each."""
        signs = np.concatenate([(x - mean) @ r > 0 for mean, r in self.learned], axis=1)[:, : self.subs * self.bits]
        return (signs.reshape(len(x), self.subs, self.bits) * (1 << np.arange(self.bits))).sum(2).astype(np.int32)


def _encode(codes: Codes):
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            vec = [r.tobytes() for r in np.stack([np.asarray(v, dtype=np.float32) for v in pdf["vector"]])]
            yield pd.DataFrame({"vh": pdf["vh"], "rid": pdf["rid"], "code": list(codes.of(unit(pdf["vector"]))), "vec": vec})

    return run


def _within(radius: int):
    """Pairs inside buckets: rows come sorted by bucket; runs are cut where the bucket changes, across batches too."""

    def run(batches):
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["pair"] == pdf["pair"].iloc[-1])
            rest = pdf[last]
            if not last.all():
                yield _bucket_pairs(pdf[~last], radius)
        if rest is not None and len(rest):
            yield _bucket_pairs(rest, radius)

    return run


def _bucket_pairs(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    n = len(pdf)
    key, pair, blk, same = (pdf[c].to_numpy() for c in ("key", "pair", "blk", "same"))
    code, rid, sub = np.stack(pdf["code"].to_numpy()), pdf["rid"].to_numpy(), key >> 32
    bucket = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
    v = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float32).reshape(n, DIM).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out_i, out_j, out_c = [], [], []
    at = np.arange(n)
    for o in range(1, n):
        at = at[at + o < n]
        at = at[bucket[at] == bucket[at + o]]
        if not len(at):
            break
        i, j = at, at + o
        x = code[i] ^ code[j]
        # The pair counts only in the first substring that agrees.
        ok = (same[i] | (blk[i] != blk[j])) & (np.bitwise_count(x).sum(1) <= radius) & ((x == 0).argmax(1) == sub[i])
        i, j = i[ok], j[ok]
        c = np.round(np.einsum("ij,ij->i", v[i], v[j]), 6)
        ok = c >= MIN_COSINE
        out_i.append(i[ok])
        out_j.append(j[ok])
        out_c.append(c[ok])
    if not out_i:
        return pd.DataFrame({"rid": [], "other": [], "cosine": []}).astype({"rid": str, "other": str, "cosine": float})
    i, j, c = (np.concatenate(x) for x in (out_i, out_j, out_c))
    d = pd.DataFrame({"run": bucket[np.concatenate([i, i])], "rid": rid[np.concatenate([i, j])], "other": rid[np.concatenate([j, i])], "cosine": np.concatenate([c, c])})
    d = d.sort_values(["run", "rid", "cosine", "other"], ascending=[True, True, False, True], kind="stable")
    return d[d.groupby(["run", "rid"], sort=False).cumcount() <= TOP][["rid", "other", "cosine"]]


def _rerank(batches):
    for pdf in batches:
        if not len(pdf):
            continue
        a, b = (np.frombuffer(b"".join(pdf[c]), dtype=np.float32).reshape(len(pdf), DIM).astype(np.float64) for c in ("vec_a", "vec_b"))
        c = np.round(np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)), 6)
        yield pd.DataFrame({"a": pdf["rid_a"], "b": pdf["rid_b"], "cosine": c})[c >= MIN_COSINE]


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("rid").orderBy(F.desc("cosine"), F.asc("other"))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def _kept_by_hash(df: DataFrame) -> DataFrame:
    """df kept with the partitioning it has, so later joins on the same key move the other side only."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name, None)
    conf.set(name, "false")
    try:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def neighbours(chunks: DataFrame) -> DataFrame:
    """(chunk_id, other, cosine): for every usable vector the five most similar others of at least 0.85, by cosine
    rounded to 6 decimals, ties to the smaller chunk_id. Null ids and unusable vectors are left out; a chunk_id with
    several usable vectors stands with the smallest. Equal vectors are indexed once, under their smallest id, and
    expanded at the end; only the six smallest ids of a group can be among anyone's nearest."""
    ok = chunks.where(F.col("chunk_id").isNotNull() & usable(F.col("vector"))).select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))
    twice = ok.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    again = ok.join(broadcast_checked(twice), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("vector").alias("vector"))
    base = ok.join(broadcast_checked(twice), "chunk_id", "left_anti").unionByName(again).withColumn("vh", F.xxhash64("vector"))
    n = ok.count()
    if n == 0:
        return ok.select("chunk_id", F.col("chunk_id").alias("other"), F.lit(1.0).alias("cosine")).limit(0)
    sample = ok.where(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // SAMPLE))) == 0).select("vector").toPandas()["vector"]
    codes_of = Codes(unit(sample) if len(sample) else np.eye(DIM), n)
    subs, bits = codes_of.subs, codes_of.bits
    coded = base.select("vh", F.col("chunk_id").alias("rid"), "vector").mapInPandas(_encode(codes_of), "vh long, rid string, code array<int>, vec binary")
    order = Window.partitionBy("vh").orderBy("rid")
    first = coded.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= TOP + 1)
    members = coded.select("vh", "rid").withColumn("rn", F.row_number().over(order)).where((F.col("rn") <= TOP + 1) & (F.col("rn") > 1)).select("vh", F.col("rid").alias("chunk_id"))
    reps = _kept_by_hash(first.where("rn = 1").drop("rn"))

    # A key is the number of the substring in the upper half, its bits in the lower.
    keys = reps.withColumn("key", F.explode(F.array(*[F.lit(s << 32) + F.get("code", F.lit(s)) for s in range(subs)])))
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("m")).persist()
    blocks = lambda rows: rows.join(broadcast_checked(hot), "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    own = F.pmod("vh", F.col("m")).cast("int")
    blocked = blocks(keys).withColumn("blk", own).withColumn("with", every)
    blocked = blocked.select("key", (F.least("blk", "with") * F.col("m") + F.greatest("blk", "with")).alias("pair"), "blk", (F.col("blk") == F.col("with")).alias("same"), "rid", "code", "vec")
    # The same pair of blocks has one number from either side; within it, rows of one block meet only in their own.
    near = blocked.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInPandas(_within(codes_of.radius), "rid string, other string, cosine double")

    # Of two keys that differ in one bit, the one without the bit asks. A hot bucket is asked block by block.
    codes = keys.select("vh", "code", "key")
    flips = codes.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.expr("0") == F.call_function("getbit", F.col("key"), b))))
    probe = flips.select(F.col("vh").alias("vh_a"), F.col("code").alias("code_a"), (F.col("key") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("key"))
    x = [F.get("code_a", F.lit(s)).bitwiseXOR(F.get("code", F.lit(s))) for s in range(subs)]
    none_equal, distance, first_near = F.lit(True), F.lit(0), F.lit(subs)
    for s in reversed(range(subs)):
        none_equal, distance = none_equal & (x[s] != 0), distance + F.bit_count(x[s])
        first_near = F.when(F.bit_count(x[s]) == 1, F.lit(s)).otherwise(first_near)
    met = blocks(probe).withColumn("blk", every).drop("m").join(blocks(codes).withColumn("blk", own).drop("m"), ["key", "blk"])
    far = met.where((distance <= codes_of.radius) & none_equal & (first_near == F.shiftright("key", 32))).select("vh_a", F.col("vh").alias("vh_b"))
    vec = lambda k: reps.select(F.col("vh").alias(f"vh_{k}"), F.col("rid").alias(f"rid_{k}"), F.col("vec").alias(f"vec_{k}"))
    met = far.join(vec("a"), "vh_a").join(vec("b"), "vh_b").select("rid_a", "rid_b", "vec_a", "vec_b").mapInPandas(_rerank, "a string, b string, cosine double")
    met = met.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("other")), F.struct(F.col("b").alias("rid"), F.col("a").alias("other")))).alias("p"), "cosine").select("p.rid", "p.other", "cosine")

    best = _best(near.unionByName(met), TOP + 1).persist(StorageLevel.MEMORY_AND_DISK)
    # Groups of equal vectors: every member asks, the six smallest ids answer.
    group = reps.select("vh", "rid")
    answers = group.select("rid", F.col("rid").alias("id")).unionByName(group.join(members, "vh").select("rid", F.col("chunk_id").alias("id")))
    lists = answers.groupBy("rid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    several = lists.where(F.size("ids") > 1)
    own = several.select("rid", F.explode("ids").alias("other"), F.lit(1.0).alias("cosine"))
    spread = best.join(several.withColumnRenamed("rid", "other"), "other", "left").select("rid", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cosine")
    ranked = _best(spread.unionByName(own), TOP + 1).persist(StorageLevel.MEMORY_AND_DISK)
    askers = base.select("vh", "chunk_id").join(group, "vh").where("chunk_id <> rid").select("rid", "chunk_id")
    asked = ranked.withColumn("chunk_id", F.col("rid")).unionByName(ranked.join(askers, "rid"))
    final = asked.where("other <> chunk_id").select(F.col("chunk_id").alias("rid"), "other", "cosine")
    return _best(final, TOP).withColumnRenamed("rid", "chunk_id")


def found(chunks: DataFrame) -> DataFrame:
    return neighbours(chunks).select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()
