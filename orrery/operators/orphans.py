"""References to records that do not exist (problem 6)."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.dates import month_or_unknown
from orrery.session import null_safe_key

#: A key is heavy if it holds more than 1 in HEAVY_SHARE of all references, so at most HEAVY_SHARE keys are heavy,
#: however large the tables are; that bounds the broadcast.
HEAVY_SHARE = 1000


def references(df: DataFrame, name: str, key: Column, day: Column) -> DataFrame:
    """(ref_table, bill_id, day, n): the references of one table, pre-aggregated per key and day. Null keys are no
    references; a null day stays null."""
    return (
        df.select(F.lit(name).alias("ref_table"), null_safe_key(key).alias("bill_id"), day.alias("day"))
        .where(F.col("bill_id").isNotNull())
        .groupBy("ref_table", "bill_id", "day")
        .agg(F.count("*").alias("n"))
    )


def known_keys(bills: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(bill_id, held, first_day): one row per key that the target table or its tombstones name."""
    held = bills.select(null_safe_key(F.col("bill_id")).alias("bill_id"), F.lit(True).alias("held"), F.to_date("fetched_at").alias("first_day"))
    gone = tombstones.select(null_safe_key(F.col("bill_id")).alias("bill_id"), F.lit(False).alias("held"), F.lit(None).cast("date").alias("first_day"))
    return held.unionByName(gone).where(F.col("bill_id").isNotNull()).groupBy("bill_id").agg(F.max("held").alias("held"), F.min("first_day").alias("first_day"))


def orphans(refs: list[DataFrame], known: DataFrame, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Orphan references as (ref_table, period, bill_id, kind, n).

    kind is `missing` (never known), `deleted` (only a tombstone is left) or `late` (the reference's day lies before
    the record's first day). References without a day are never late; records without a first day make none late.
    Keys with a large share of all references are checked against a broadcast of just these keys (at most
    `heavy_share` of them); the other keys are shuffled. Empty inputs give no rows.
    """
    every = reduce(DataFrame.unionByName, refs).persist(StorageLevel.MEMORY_AND_DISK)
    per_key = every.groupBy("bill_id").agg(F.sum("n").alias("n"))
    total = every.agg(F.sum("n")).first()[0] or 0
    heavy = per_key.where(F.col("n") * heavy_share > total).select("bill_id").persist(StorageLevel.MEMORY_AND_DISK)
    heavy_known = known.join(F.broadcast(heavy), "bill_id", "left_semi")
    parts = [
        every.join(F.broadcast(heavy), "bill_id", "left_semi").join(F.broadcast(heavy_known), "bill_id", "left"),
        every.join(F.broadcast(heavy), "bill_id", "left_anti").join(known, "bill_id", "left"),
    ]
    kind = F.when(F.col("held").isNull(), "missing").when(~F.col("held"), "deleted").when(F.col("day") < F.col("first_day"), "late")
    return (
        parts[0]
        .unionByName(parts[1])
        .select("ref_table", month_or_unknown(F.col("day")).alias("period"), "bill_id", kind.alias("kind"), "n")
        .where(F.col("kind").isNotNull())
        .groupBy("ref_table", "period", "bill_id", "kind")
        .agg(F.sum("n").alias("n"))
    )
