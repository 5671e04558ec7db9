"""Distinct rows without a shuffle of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import broadcast_checked


def once(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The distinct (*keys, text) rows. Repeated rows are told by a hash of the text, and only keys that have one are
    shuffled with their texts; null keys are keys like any other."""
    src = rows.select(*keys, text).withColumn("_h", F.xxhash64(text))
    on = [*keys, "_h"]
    twice = src.select(*on).groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n").select(*[F.col(c).alias(f"_{c}") for c in on])
    twice = broadcast_checked(twice.persist())
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return src.join(twice, same, "left_anti").drop("_h").unionByName(src.join(twice, same, "left_semi").drop("_h").distinct())
