"""Set-wise forms of the write and lookup patterns: upserts, todo sets, keep-latest, reconciliation, dict filters."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; give an order that ends in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The row with the greatest `when`; ties keep the smallest `tie`."""
    return keep_first(df, keys, F.col(when).desc_nulls_last(), F.col(tie).asc())


def keep_longest(df: DataFrame, keys: list[str], text: str, position: str) -> DataFrame:
    return keep_first(df, keys, F.length(text).desc_nulls_last(), F.col(position).asc())


def latest_version(df: DataFrame, version: str, when: str) -> DataFrame:
    """The one version with the greatest timestamp, ties to the greater version."""
    return df.where(F.col(version).isNotNull()).groupBy(version).agg(F.max(when).alias(when)).orderBy(F.col(when).desc_nulls_last(), F.col(version).desc()).limit(1)


def todo(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a finished row. Written as an anti join: an outer join with an IS NULL filter isn't turned into one."""
    return rows.join(done.select(*on).distinct(), on, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, by one full join of distinct keys."""
    a, b = (x.where(F.col(key).isNotNull()).select(key).distinct() for x in (left, right))
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full")
    return j.where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "orphan").otherwise("missing").alias("side"))


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First write wins, among the new rows too (in the order of `order`)."""
    fresh = keep_first(new, keys, F.col(order).asc())
    return table.unionByName(fresh.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def insert_or_replace(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins, among the new rows too."""
    fresh = keep_first(new, keys, F.col(order).desc()).select(*table.columns)
    return table.join(fresh.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE by one full join. `merge` gives a column's value from `old_x` and `new_x`; other columns take
    the new value. New rows must be unique by key."""
    o = table.select(*keys, *[F.col(c).alias(f"old_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_new"))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def value(c):
        chosen = (merge or {}).get(c, F.col(f"new_{c}"))
        return F.when(both, chosen).when(F.col("_new").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)

    return o.join(n, keys, "full").select(*[F.col(c) if c in keys else value(c) for c in table.columns])


def coalesce_new(c: str) -> Column:
    return F.coalesce(F.col(f"new_{c}"), F.col(f"old_{c}"))


def replace_tasks(table: DataFrame, new: DataFrame, task: str) -> DataFrame:
    """All rows of the tasks that the new rows name are replaced; an empty batch changes nothing."""
    return table.join(new.select(task).distinct(), task, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def keep_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """DELETE ... NOT IN: only rows whose key is known stay; null keys go."""
    return df.join(known.select(key).distinct(), key, "left_semi")


def stage_and_swap(df: DataFrame, path: str, **options) -> None:
    """Write beside the target, then swap: a failed write leaves the old table as it was. Partitioned by nothing; the
    folders are renamed by the driver through Hadoop's file system, so it works on shared storage."""
    spark = df.sparkSession
    jvm = spark._jvm
    tmp, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(tmp)
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    if not fs.rename(P(tmp), P(path)):
        if fs.exists(P(old)):
            fs.rename(P(old), P(path))
        raise OSError(f"can't move {tmp} to {path}")
    if fs.exists(P(old)):
        fs.delete(P(old), True)


def where_dict(spec: dict) -> Column:
    """A filter from {column: value}, {column: {"$eq": value}}, {column: {"$in": [...]}} and {"$and": [spec, ...]}; a null
    never equals."""

    def one(k, v):
        if k == "$and":
            return reduce(lambda a, b: a & b, [where_dict(x) for x in v], F.lit(True))
        if isinstance(v, dict):
            (op, x), = v.items()
            if op == "$in":
                return F.coalesce(F.col(k).isin(list(x)), F.lit(False))
            if op != "$eq":
                raise ValueError(f"unknown operator {op}")
            v = x
        return F.coalesce(F.col(k) == F.lit(v), F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in spec.items()], F.lit(True))


def keep_flag(flag: str) -> Column:
    """Rows whose flag is true or unknown."""
    return F.coalesce(F.col(flag), F.lit(True))


def renamed(df: DataFrame, spec: dict[str, tuple[str, str]], view: str | None = None) -> DataFrame:
    """A typed view: {column: (raw column, type)}. Casts that fail give null. With `view` it is registered in the session."""
    out = df.select(*[F.col(raw).try_cast(kind).alias(c) for c, (raw, kind) in spec.items()])
    if view:
        out.createOrReplaceTempView(view)
    return out


def gather(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows with the vectors of the same key: an equi-join on the key, after vectors are reduced to one per key (the
    smallest), so no row multiplies."""
    one = vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("vector").alias("vector"))
    return rows.join(one, key)


def upsert_vectors(table: DataFrame, new: DataFrame, key: str, dim: int) -> DataFrame:
    """Upsert of (key, vector) rows. New vectors that are null, of another length or not finite are left out; of repeated
    keys the smallest vector counts; vectors are stored in single precision."""
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fresh = new.where(F.col(key).isNotNull() & sound).groupBy(key).agg(F.min(v.cast("array<float>")).alias("vector"))
    return upsert(table.select(key, v.cast("array<float>").alias("vector")), fresh, [key])


def fallback(df: DataFrame, key: str, out: str, *sources: tuple[DataFrame, str, str]) -> DataFrame:
    """`out` from the first source that has a non-empty value: each source is (table, its key, its value column), reduced to
    the smallest value per key before the join."""
    cols = []
    for i, (t, k, v) in enumerate(sources):
        one = t.where((F.col(v) != "") & F.col(k).isNotNull()).groupBy(F.col(k).alias(key)).agg(F.min(v).alias(f"_v{i}"))
        df = df.join(one, key, "left")
        cols.append(f"_v{i}")
    return df.withColumn(out, F.coalesce(*cols)).drop(*cols)


def names_to_members(bills: DataFrame, members: DataFrame) -> DataFrame:
    """(bill_id, name, mona_cd, party) for every name of a bill's comma-separated proposers; namesakes resolve to the
    smallest mona_cd, unknown names to null."""
    one = members.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("mona_cd", "party")).alias("m"))
    names = bills.select("bill_id", F.explode(F.split("co_proposers", ",")).alias("name")).withColumn("name", F.trim("name")).where("name <> ''")
    return names.join(one, "name", "left").select("bill_id", "name", F.col("m.mona_cd").alias("mona_cd"), F.col("m.party").alias("party"))


