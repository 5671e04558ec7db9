"""Dense search, BM25 over sub-corpora, reciprocal rank fusion, and the search façade."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.relational import where_dict
from orrery.session import broadcast_checked, shared_folder

# Fixed values.
TOP_K, RRF_K = 30, 60
K1, B = 1.5, 0.75
ASCII_TOKEN = r"[A-Za-z0-9_/.\-]+"
SHARDS = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def knn(index: DataFrame, key: str, vector: str, query: list[float], k: int = TOP_K, where: dict | None = None) -> DataFrame:
    """(key, score, rank) of the k nearest by cosine; the filter is applied before. Ties go to the smaller key, rank counts
    from 0. A top-k of one sort key, so nothing but k rows per task is moved."""
    rows = index.where(where_dict(where)) if where else index
    q = F.array(*[F.lit(float(x)) for x in query])
    top = rows.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("score")).where("score is not null").orderBy(F.desc("score"), F.asc(key)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))) - 1)


def _best(batches, queries: list[tuple], k: int):
    """The k best of each query among the rows of a task, by blocks of rows; ties to the smaller key."""
    names, q = [a for a, _ in queries], np.array([v for _, v in queries], dtype=float)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    kept: list[list[tuple]] = [[] for _ in names]
    for pdf in batches:
        rows = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["vector"]]]
        if not len(rows):
            continue
        x = np.stack(rows["vector"].to_numpy()).astype(float)
        with np.errstate(all="ignore"):
            score = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        ids = rows["key"].to_numpy()
        for i, row in enumerate(score):
            ok = np.flatnonzero(np.isfinite(row))
            if len(ok) > k:  # all ties with the k-th stay until the keys decide
                ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k]]
            kept[i] = sorted([*kept[i], *((-float(row[j]), ids[j]) for j in ok)])[:k]
    yield pd.DataFrame([(n, key, -s) for n, best in zip(names, kept) for s, key in best], columns=["query", "key", "score"])


def knn_batch(index: DataFrame, key: str, vector: str, queries: DataFrame, k: int = TOP_K, block: int = 1_000) -> DataFrame:
    """(query, key, score, rank) of the k nearest rows of every query (query, vector), by cosine, ranks from 0, ties to the
    smaller key. Queries are taken in blocks of `block`, each against the whole table; a task sends on k rows a query.
    Vectors that are null, of another length, of length 0 or not finite are neither found nor asked."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ask = queries.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).select("query", "vector")
    kinds = dict(index.dtypes) | {"query": dict(ask.dtypes)["query"]}
    schema = f"query {kinds['query']}, key {kinds[key]}, score double"
    rows = index.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    out, waiting = ask.sparkSession.createDataFrame([], schema), {}

    def against(qs: list[tuple]) -> DataFrame:
        return rows.mapInPandas(lambda batches: _best(batches, qs, k), schema)

    for r in ask.toLocalIterator():
        part = waiting.setdefault(len(r["vector"]), [])
        part.append((r["query"], [float(x) for x in r["vector"]]))
        if len(part) == block:
            out, waiting[len(r["vector"])] = out.unionByName(against(part)), []
    for part in waiting.values():
        if part:
            out = out.unionByName(against(part))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query", F.col("key").alias(key), "score", "rank")


def ascii_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({ASCII_TOKEN})")), lambda x: F.lower(x))


def word_tokens(text: Column) -> Column:
    """Runs of Hangul or other letters and digits in lower case, and the ASCII tokens again, so those count twice as with a
    tagger that emits them too. A tagger can take the place of the first part."""
    return F.concat(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)")), lambda x: F.lower(x)), ascii_tokens(text))


def sub_corpus(source: Column, doc_source: Column, chunk_id: Column) -> Column:
    """The index a chunk belongs to: its source, documents by their source, committee minutes in four shards by the first hex
    digit of the id."""
    digit = F.conv(F.substring(chunk_id, 1, 1), 16, 10).cast("int")
    doc = F.when(doc_source == "minutes_committee", F.concat(F.lit("doc_minutes_committee_"), F.pmod(digit, F.lit(SHARDS)).cast("string"))).otherwise(F.concat(F.lit("doc_"), doc_source))
    return F.when(source == "document", doc).otherwise(source)


class Bm25Index:
    """A stored index: (bucket, token, sub_id, id, weight), one row per posting, partitioned by a hash bucket of the token
    and sorted by token. What a token adds to a document's score doesn't depend on the query, so it is worked out once,
    with the statistics of the sub-corpus; a search reads the rows of its terms and sums them up.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.postings = folder, spark.read.parquet(f"{folder}/postings")

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, sub: Column, folder: str | None = None, tokens: Callable[[Column], Column] = word_tokens) -> Bm25Index:
        """Build the index in a folder, by default one in the session's shared folder. A folder that has a finished index is
        opened as it is. The texts are read once; null keys and texts and texts without tokens are not in it."""
        spark = docs.sparkSession
        folder = folder or f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
        if not _exists(spark, f"{folder}/postings/_SUCCESS"):
            t = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(sub.alias("sub_id"), F.col(key).alias("id"), F.explode(tokens(F.col(text))).alias("token"))
            p = t.groupBy("sub_id", "id", "token").agg(F.count("*").alias("tf")).persist()
            lengths = p.groupBy("sub_id", "id").agg(F.sum("tf").alias("dl"))
            stats = lengths.groupBy("sub_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
            frequency = p.groupBy("sub_id", "token").agg(F.count("*").alias("df"))
            idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
            tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
            rows = p.join(lengths, ["sub_id", "id"]).join(broadcast_checked(stats), "sub_id").join(frequency, ["sub_id", "token"])
            rows = rows.select(_bucket(F.col("token")).alias("bucket"), "token", "sub_id", "id", (idf * tf).alias("weight"))
            # A bucket is a folder of the table, not a task: tokens spread over all tasks, whatever the bucket.
            rows.repartition("token").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
            p.unpersist()
        return cls(spark, folder)

    def search(self, terms: list[str], k: int = TOP_K) -> DataFrame:
        """(id, sub_id, score, rank): top k per sub-corpus, scores over 0, then the top k of all by raw score."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        hits = self.postings.where(F.col("bucket").isin(buckets_of(self.postings.sparkSession, terms)) & F.col("token").isin(terms))
        scored = hits.groupBy("sub_id", "id").agg(F.sum("weight").alias("score")).where("score > 0")
        w = Window.partitionBy("sub_id").orderBy(F.desc("score"), F.asc("id"))
        best = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).orderBy(F.desc("score"), F.asc("id")).limit(k)
        return best.select("id", "sub_id", "score", (F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))) - 1).alias("rank"))

    def search_batch(self, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """(query, id, sub_id, score, rank) of (query, terms array) rows, each as by `search`."""
        asked = queries.select("query", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("token"))
        scored = self.postings.join(broadcast_checked(asked), "token").groupBy("query", "sub_id", "id").agg(F.sum("weight").alias("score")).where("score > 0")
        per = Window.partitionBy("query", "sub_id").orderBy(F.desc("score"), F.asc("id"))
        every = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
        best = scored.withColumn("rn", F.row_number().over(per)).where(F.col("rn") <= k).drop("rn")
        return best.withColumn("rank", F.row_number().over(every) - 1).where(F.col("rank") < k).select("query", "id", "sub_id", "score", "rank")


BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def buckets_of(spark: SparkSession, terms: list[str]) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect() if terms else []
    return [r["b"] for r in rows]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class AnnIndex:
    """A stored inverted file of vectors: (cell, key, vector), partitioned by the nearest of at most 256 centroids. A search
    reads the few cells nearest to its query. Centroids are fitted on a bounded sample, taken by the hash of the key; all
    sound vectors are indexed."""

    CELLS, SAMPLE = 256, 65_536

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.rows = folder, spark.read.parquet(f"{folder}/vectors")
        c = spark.read.parquet(f"{folder}/centroids").orderBy("cell").toPandas()
        self.centroids = np.stack(c["centroid"].to_numpy()) if len(c) else np.zeros((0, 0))

    @classmethod
    def build(cls, rows: DataFrame, key: str, vector: str, folder: str | None = None, cells: int | None = None, seed: int = 5) -> AnnIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = rows.sparkSession
        folder = folder or f"{shared_folder(spark)}/ann-{uuid.uuid4().hex}"
        if not _exists(spark, f"{folder}/vectors/_SUCCESS"):
            v = F.col(vector).cast("array<double>")
            sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
            base = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(key).alias("key"), F.transform(v, lambda x: x / norm(v)).alias("unit"), F.col(vector).alias("vector"))
            n = base.count()
            sample = base.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // cls.SAMPLE))) == 0).select(array_to_vector("unit").alias("features"))
            k = min(cells or cls.CELLS, max(2, int(np.sqrt(max(n, 1)))))
            model = KMeans(k=k, seed=seed, maxIter=15).fit(sample)
            cents = [[float(x) for x in c] for c in model.clusterCenters()]
            spark.createDataFrame(list(enumerate(cents)), "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")
            placed = model.transform(base.withColumn("features", array_to_vector("unit"))).select(F.col("prediction").alias("cell"), "key", "vector")
            placed.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
        return cls(spark, folder)

    def search(self, query: list[float], k: int = TOP_K, probes: int = 16, where: dict | None = None) -> DataFrame:
        """(key, score, rank) of the k nearest within the `probes` cells nearest to the query; with as many probes as cells
        the exact result. Only these cells' folders are read."""
        q = np.asarray(query, dtype=float)
        d = ((self.centroids - q / np.linalg.norm(q)) ** 2).sum(1)
        near = [int(i) for i in np.argsort(d, kind="stable")[:probes]]
        return knn(self.rows.where(F.col("cell").isin(near)), "key", "vector", [float(x) for x in q], k, where)

    def search_batch(self, queries: DataFrame, k: int = TOP_K, probes: int = 16) -> DataFrame:
        """(query, key, score, rank) of every (query, vector) row, by a join on the probed cells."""
        cents = self.centroids
        kind = dict(queries.dtypes)["query"]

        def probed(batches):
            for pdf in batches:
                q = np.stack([np.asarray(v, dtype=float) for v in pdf["vector"]]) if len(pdf) else np.zeros((0, cents.shape[1]))
                d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ cents.T * 2 + (cents**2).sum(1)
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query": np.repeat(pdf["query"].to_numpy(), near.shape[1]), "cell": near.ravel().astype("int32"), "asked": [v for v in pdf["vector"] for _ in range(near.shape[1])]})

        ask = queries.where("vector is not null").select("query", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(probed, f"query {kind}, cell int, asked array<double>")
        s = self.rows.join(broadcast_checked(ask), "cell").select("query", "key", cosine(F.col("asked"), F.col("vector")).alias("score")).where("score is not null")
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
        return s.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def rrf(first: DataFrame, second: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (key, rank from 0): (key, score, rank). Ties keep the order of the first list, then
    of the second."""
    j = first.select(key, F.col("rank").alias("r1")).join(second.select(key, F.col("rank").alias("r2")), key, "full")
    s = j.withColumn("score", F.coalesce(1.0 / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("r2")), F.lit(0.0)))
    order = Window.orderBy(F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"))
    return s.withColumn("rank", F.row_number().over(order) - 1).select(key, "score", "rank")


class Search:
    """Hybrid search over a chunk table: dense and BM25 lists of 30, BM25 filtered after its cut, fused, texts joined. Without
    a vector the words alone decide, without a word index (`bm25=None`) the vectors."""

    def __init__(self, chunks: DataFrame, key: str = "chunk_id", vector: str = "vector", text: str = "text", embed: Callable[[str], list[float]] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, bm25: Bm25Index | str | None = "build"):
        self.chunks, self.key, self.vector, self.text, self.embed, self.rerank = chunks, key, vector, text, embed, rerank
        self._bm25 = bm25

    @property
    def bm25(self) -> Bm25Index | None:
        if self._bm25 == "build":  # built when it is first asked for
            self._bm25 = Bm25Index.build(self.chunks, self.key, self.text, sub_corpus(F.col("source"), F.col("doc_source"), F.col(self.key)))
        return self._bm25

    def hybrid(self, query: str, top_k: int = 10, where: dict | None = None, vector: list[float] | None = None) -> DataFrame:
        v = vector if vector is not None else self.embed and self.embed(query)
        if self.bm25 is None:
            if v is None:
                raise ValueError("neither vectors nor words to search by")
            sparse = knn(self.chunks, self.key, self.vector, v, 1).limit(0)
        else:
            sparse = self.bm25.search(query.split()).select(F.col("id").alias(self.key), "score", "rank")
        if where:
            sparse = sparse.join(self.chunks.where(where_dict(where)).select(self.key), self.key, "left_semi")
        if v is None:  # without an embedding the words alone decide
            fused = rrf(sparse.limit(0), sparse, self.key)
        else:
            fused = rrf(knn(self.chunks, self.key, self.vector, v, where=where), sparse, self.key)
        out = fused.join(self.chunks.select(self.key, "source", self.text), self.key)
        out = self.rerank(out) if self.rerank else out
        return out.orderBy("rank").limit(top_k)

    def bills(self, query: str, top_k: int = 10, age: int | None = None, committee: str | None = None, **kw) -> DataFrame:
        where = {"source": "bill"} | ({"age": age} if age is not None else {}) | ({"committee": committee} if committee else {})
        return self.hybrid(query, top_k, where, **kw)

    def documents(self, query: str, top_k: int = 10, doc_source: str | None = None, **kw) -> DataFrame:
        return self.hybrid(query, top_k, {"source": "document"} | ({"doc_source": doc_source} if doc_source else {}), **kw)

    def speeches(self, query: str, top_k: int = 10, dae_num: str | None = None, speaker: str | None = None, **kw) -> DataFrame:
        return self.hybrid(query, top_k, {"source": "speech"} | ({"dae_num": dae_num} if dae_num else {}) | ({"speaker": speaker} if speaker else {}), **kw)

    def members(self, query: str, top_k: int = 10, **kw) -> DataFrame:
        return self.hybrid(query, top_k, {"source": "member"}, **kw)

    def bill(self, bill_id: str) -> DataFrame:
        return self.chunks.where(where_dict({"$and": [{"source": "bill_meta"}, {"bill_id": bill_id}]}))

    def stats(self, version: str) -> DataFrame:
        return self.chunks.where(F.col("embed_config_ver") == version).groupBy("source").agg(F.count("*").alias("n"))

    def member(self, name: str, members: DataFrame) -> DataFrame:
        """The cards of a member by name; where the chunks have none, the rows of the member table."""
        cards = self.chunks.where(where_dict({"source": "member", "name": name})).select(F.col("mona_cd"), "name", F.col(self.text).alias("text"))
        own = members.where(where_dict({"name": name})).select("mona_cd", "name", F.concat_ws(" ", "name", "party", "district").alias("text"))
        return cards.unionByName(own.join(cards.select("mona_cd"), "mona_cd", "left_anti"))


SHOWN_TEXT = 400
REFERENCES = ("bill_id", "doc_id", "conf_id", "mona_cd")


def formatted(results: DataFrame, text: str = "text", shown: int = SHOWN_TEXT, notes: tuple[str, ...] = ("bill_name", "speaker", "name", "party", "age", "committee")) -> DataFrame:
    """(source, ref, notes, text) of results: the first reference that isn't empty, `name=value` of the fields that have
    one, and the beginning of the text for display."""
    ref = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in REFERENCES], F.lit(""))
    bits = F.concat_ws(" | ", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in notes])
    return results.withColumns({"_ref": ref, "_notes": bits}).select(F.coalesce("source", F.lit("?")).alias("source"), F.col("_ref").alias("ref"), F.col("_notes").alias("notes"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, shown).alias("text"))


def embedded(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], prefix: str = "", dim: int = 1024) -> DataFrame:
    """(key, vector) by a model that is passed in and runs on Arrow batches. The prefix stands before queries only; vectors
    come out with length 1; null and empty texts get none."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for pdf in batches:
            v = np.asarray(model([prefix + t for t in pdf[text]]), dtype=float).reshape(len(pdf), dim)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: pdf[key], "vector": list(v.astype("float32"))})

    return rows.where(F.col(text) != "").select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<float>")


def contract_mismatches(recorded: dict | None, wanted: dict, optional: tuple[str, ...] = ()) -> list[str]:
    """Keys of a wanted embedding contract, nested ones as `a.b`, that a recorded one lacks or has otherwise. Nothing recorded
    is no mismatch; optional keys may be missing or null."""
    if recorded is None:
        return []

    def flat(d, head=""):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from flat(v, f"{head}{k}.")
            else:
                yield f"{head}{k}", v

    have, out = dict(flat(recorded)), []
    for k, v in flat(wanted):
        if have.get(k) is None and (k in optional or v is None):
            continue
        if k not in have:
            out.append(f"{k}: missing, wanted {v!r}")
        elif have[k] != v:
            out.append(f"{k}: {have[k]!r}, wanted {v!r}")
    return out
