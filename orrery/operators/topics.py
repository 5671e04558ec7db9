"""TF-IDF, keyword scores, topic centroids, merging, alignment and curation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.retrieval import cosine
from orrery.session import broadcast_checked

# Rule and factor of the smallest cluster per attribute; the floor.
SMALLEST = 8
CLUSTER_RULES = {
    "산업정책": ("sqrt", 0.5), "공익/소비자보호": ("log", 10), "국가안보": ("linear", 200), "노동/고용": ("cbrt", 3), "책임/윤리AI": ("sqrt", 0.6),
    "시장경쟁/독과점": ("cbrt", 3), "국제협력": ("linear", 200), "선거/민주주의": ("log", 10), "AI안전": ("log", 15), "저작권/지식재산": ("linear", 200),
}
#: Centroids of two languages are aligned from this similarity on.
ALIGN = 0.68


def grams(tokens: Column, upto: int = 2) -> Column:
    out = tokens
    for n in range(2, upto + 1):
        many = F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, many)
    return out


def tfidf(docs: DataFrame, key: str, tokens: Column, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000) -> DataFrame:
    """(key, term, weight) with smoothed idf ln((1+n)/(1+df))+1 and rows of length 1. Terms in fewer than min_df documents or
    in more than a share max_df are left out; of the rest the most frequent in the corpus stay, ties to the smaller term."""
    t = docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    vocabulary = t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    idf = vocabulary.select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = t.join(broadcast_checked(idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("raw") / length).alias("weight"))


def keyword_scores(weights: DataFrame, key: str, keywords: DataFrame, exact: float = 2.0, part: float = 0.5) -> DataFrame:
    """(key, attr, score): keyword weights `exact` times where the keyword is a feature, else `part` times each of its words.
    keywords has (attr, keyword)."""
    features = weights.select("term").distinct().withColumn("known", F.lit(True))
    k = keywords.join(features.withColumnRenamed("term", "keyword"), "keyword", "left")
    whole = k.where("known").select("attr", F.col("keyword").alias("term"), F.lit(exact).alias("factor"))
    parts = k.where(F.col("known").isNull() & F.col("keyword").contains(" ")).select("attr", F.explode(F.split("keyword", " ")).alias("term"), F.lit(part).alias("factor"))
    return weights.join(whole.unionByName(parts), "term").groupBy(key, "attr").agg(F.sum(F.col("weight") * F.col("factor")).alias("score"))


def best_attribute(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.max(F.struct(F.col("score"), F.col("attr"))).alias("m")).select(key, F.col("m.attr").alias("attr"), F.col("m.score").alias("score"))


def centroids(vectors: DataFrame, group: str, vector: str, outlier: int | None = -1) -> DataFrame:
    """(group, centroid, n): mean vectors by partial averages per place; the outlier group is left out."""
    rows = vectors if outlier is None else vectors.where(F.col(group) != outlier)
    cells = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def nearest_members(vectors: DataFrame, group: str, key: str, vector: str, cents: DataFrame, k: int = 5) -> DataFrame:
    """(group, key, distance): the k members of each group nearest to its centroid (L2)."""
    square = F.aggregate(F.zip_with(F.col(vector), F.col("centroid"), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    d = vectors.join(cents, group).select(group, key, F.sqrt(square).alias("distance"))
    w = Window.partitionBy(group).orderBy("distance", key)
    return d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def centroid_pairs(cents: DataFrame, group: str, least: float) -> DataFrame:
    """(a, b, similarity) of centroids at least so similar. The table has a row per topic, some hundreds at most."""
    a, b = cents.select(F.col(group).alias("a"), F.col("centroid").alias("ca")), cents.select(F.col(group).alias("b"), F.col("centroid").alias("cb"))
    return a.join(broadcast_checked(b), F.col("a") < F.col("b")).select("a", "b", cosine(F.col("ca"), F.col("cb")).alias("similarity")).where(F.col("similarity") >= least)


def greedy_pairs(pairs: list[tuple]) -> list[tuple]:
    """One-to-one pairs (a, b, similarity) by falling similarity."""
    used_a, used_b, out = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, s))
    return out


def average_linkage(vectors: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers of agglomerative average linkage on cosine distance, cut at 1 - threshold. For topic centroids."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - x @ x.T
    members = {i: [i] for i in range(len(x))}
    while len(members) > 1:
        ks = list(members)
        best = min(((d[np.ix_(members[a], members[b])].mean(), a, b) for i, a in enumerate(ks) for b in ks[i + 1 :]))
        if best[0] > 1 - threshold:
            break
        members[best[1]] += members.pop(best[2])
    label = {i: n for n, (_, ms) in enumerate(sorted(members.items())) for i in ms}
    return [label[i] for i in range(len(x))]


def merge_topics(topics: list[dict], threshold: float) -> list[dict]:
    """Similar topics as one: the largest names it, centroids weighted by counts, up to 10 keywords in order, counts summed."""
    labels = average_linkage(np.array([t["centroid"] for t in topics], dtype=float), threshold) if topics else []
    out = []
    for n in sorted(set(labels)):
        ts = sorted((t for t, k in zip(topics, labels) if k == n), key=lambda t: (-t["count"], t["topic"]))
        total = sum(t["count"] for t in ts)
        words = list(dict.fromkeys(w for t in ts for w in t["keywords"]))[:10]
        cent = sum(np.array(t["centroid"], dtype=float) * t["count"] for t in ts) / total
        out.append({"topic": ts[0]["topic"], "count": total, "keywords": words, "centroid": cent.tolist(), "merged": [t["topic"] for t in ts]})
    return out


def curate(topics: DataFrame, drops: DataFrame, labels: DataFrame) -> DataFrame:
    """Topics (attr, topic_id, count, label) without dropped ones and with new labels; outliers (-1) always stay."""
    kept = topics.join(drops.withColumn("_drop", F.lit(True)), ["attr", "topic_id"], "left").where(F.col("_drop").isNull() | (F.col("topic_id") == -1)).drop("_drop")
    return kept.join(labels.withColumnRenamed("label", "_label"), ["attr", "topic_id"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def unknown_targets(topics: DataFrame, directives: DataFrame) -> DataFrame:
    return directives.select("attr", "topic_id").distinct().join(topics.select("attr", "topic_id"), ["attr", "topic_id"], "left_anti")


def topic_articles(topics: DataFrame, assignments: DataFrame, articles: DataFrame) -> DataFrame:
    """(label, article_id, title): topics carry an array of keys `attr:topic_id`; each is exploded and joined to its articles."""
    keys = topics.select("label", F.explode("keys").alias("key"))
    a = assignments.withColumn("key", F.concat_ws(":", "attr", F.col("topic_id").cast("string")))
    return keys.join(a, "key").join(articles, "article_id").select("label", "article_id", "title").distinct()


def min_cluster_size(n: Column, rule: str = "sqrt", factor: float = 0.6) -> Column:
    """The smallest cluster of n rows: a factor times the root, cube root or decimal logarithm of n, rounded up, or one in
    `factor` rows; never under SMALLEST."""
    size = {
        "sqrt": lambda: F.ceil(factor * F.sqrt(n)), "cbrt": lambda: F.ceil(factor * F.pow(n.cast("double"), F.lit(1 / 3))),
        "log": lambda: F.ceil(factor * F.log10(F.greatest(n, F.lit(10)))), "linear": lambda: F.floor(n / factor),
    }[rule]()
    return F.greatest(F.lit(SMALLEST), size.cast("int"))


def ctfidf(docs: DataFrame, group: str, tokens: Column, k: int = 10) -> DataFrame:
    """(group, term, score, rank): the terms of a cluster taken as one text. Frequency in the cluster over its length, times
    ln(1 + mean length / frequency in all); ties to the smaller term."""
    t = docs.where(F.col(group).isNotNull()).select(group, F.explode(tokens).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    size = t.groupBy(group).agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    every = t.groupBy("term").agg(F.sum("tf").alias("all"))
    score = F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("all"))
    s = t.join(every, "term").join(broadcast_checked(size), group).crossJoin(F.broadcast(mean)).select(group, "term", score.alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("term"))
    return s.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def density_topics(vectors: DataFrame, key: str, vector: str, topics: int, smallest: int, seed: int = 7) -> DataFrame:
    """(key, topic): bisecting k-means on unit vectors, an approximation of density clustering. Clusters of fewer than
    `smallest` rows are outliers, topic -1, as a density method leaves sparse rows out."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    rows = Normalizer(inputCol="_v", outputCol="_u").transform(rows).persist()
    found = BisectingKMeans(k=topics, featuresCol="_u", predictionCol="_c", seed=seed, minDivisibleClusterSize=float(2 * smallest)).fit(rows).transform(rows).select(key, "_c")
    n = found.groupBy("_c").agg(F.count("*").alias("n"))  # a row per topic
    return found.join(F.broadcast(n), "_c").select(key, F.when(F.col("n") >= smallest, F.col("_c")).otherwise(-1).alias("topic"))


def aligned(cents: DataFrame, group: str, side: Column, threshold: float = ALIGN) -> list[tuple]:
    """(a, b, similarity) of centroids of two sides, one to one by falling similarity from the threshold on. The tables have
    a row per topic, some hundreds at most."""
    rows = cents.withColumn("_side", side)
    a, b = (rows.where(F.col("_side") == x).select(F.col(group).alias(n), F.col("centroid").alias(f"c{n}")) for x, n in ((True, "a"), (False, "b")))
    s = a.join(broadcast_checked(b), F.lit(True)).select("a", "b", cosine(F.col("ca"), F.col("cb")).alias("s")).where(F.col("s") >= threshold)
    return greedy_pairs([tuple(r) for r in s.collect()])


def curate_all(topics: DataFrame, drops: DataFrame, labels: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, deltas): dropped and relabelled topics, then fields replaced by (attr, topic_id, field, value) overrides of
    `label` and `group_label`; deltas has per attribute how many topics and rows were dropped."""
    kept = curate(topics, drops, labels)
    for field in ("label", "group_label"):
        new = overrides.where(F.col("field") == field).groupBy("attr", "topic_id").agg(F.max("value").alias("_new"))
        kept = kept.join(new, ["attr", "topic_id"], "left").withColumn(field, F.coalesce("_new", field)).drop("_new")
    gone = topics.join(drops.select("attr", "topic_id").distinct(), ["attr", "topic_id"], "left_semi").where("topic_id <> -1")
    return kept, gone.groupBy("attr").agg(F.count("*").alias("topics"), F.sum("count").alias("rows"))


def lda(docs: DataFrame, key: str, tokens: str, topics: int = 10, seed: int = 42, iterations: int = 50):
    """(assignments, terms) of an online LDA on counts: the strongest topic per document and the top words per topic. Every
    iteration draws as many documents as there are, and all terms of two documents or more count. Documents without such
    a term come out with a null topic."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    cv = CountVectorizer(inputCol=tokens, outputCol="_tf", minDF=2, vocabSize=2**31 - 1).fit(docs)
    model = LDA(k=topics, featuresCol="_tf", seed=seed, maxIter=iterations, optimizer="online", subsamplingRate=1.0).fit(cv.transform(docs).persist())
    mix = vector_to_array("topicDistribution")
    strongest = F.when(F.exists(mix, lambda x: x != 0), F.array_position(mix, F.array_max(mix)).cast("int") - 1)
    terms = cv.vocabulary
    words = model.describeTopics(10).select("topic", F.posexplode("termIndices").alias("at", "i"))
    used = sorted({r.i for r in words.select("i").distinct().collect()})
    names = F.create_map(*[F.lit(x) for i in used for x in (i, terms[i])])
    ordered = words.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("at", F.element_at(names, F.col("i")).alias("w")))).alias("w"))
    return model.transform(cv.transform(docs)).select(key, strongest.alias("topic")), ordered.select("topic", F.col("w.w").alias("words"))
