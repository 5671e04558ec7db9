"""Descriptive statistics: series, shares, event windows, matrices, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def filled_months(df: DataFrame, ts: str) -> DataFrame:
    """(month, n) for every month between the first and the last, 0 where there are no rows."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.trunc(ts, "month").alias("m")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return every.join(counts, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def trailing_mean(value: str, order: str, n: int, full_only: bool = False, by: list[str] | None = None) -> Column:
    """Mean of the last n rows; at the start over the rows there are, or null there if only full windows count.

    Without `by` the frame is global, which suits series of a row per period, not raw tables."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-(n - 1), 0)
    mean = F.avg(value).over(w)
    return F.when(F.count("*").over(w) == n, mean) if full_only else mean


def running_sum(value: str, order: str, by: list[str] | None = None) -> Column:
    return F.sum(value).over(Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def share_without(df: DataFrame, by: list[str], category: str, excluded: str = "none") -> DataFrame:
    """Counts per category, and percent shares whose denominator leaves one category out; its own share is 0."""
    n = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("n"))
    counted = F.when(F.col(category) != excluded, F.col("n"))
    if by:
        n = n.withColumn("_total", F.sum(counted).over(Window.partitionBy(*by)))
    else:  # one row, so no window pulls all groups into one task
        n = n.crossJoin(F.broadcast(n.agg(F.sum(counted).alias("_total"))))
    return n.withColumn("pct", F.coalesce(F.try_divide(100.0 * counted, F.col("_total")), F.lit(0.0))).drop("_total")


def matrix(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Counts with one column per listed value, 0 where empty; other values are dropped."""
    return df.where(F.col(column).isin(columns)).groupBy(row).pivot(column, columns).agg(F.count(F.lit(1))).na.fill(0)


def keyword_trend(df: DataFrame, ts: str, text: str, keywords: dict[str, str]) -> DataFrame:
    """Per month: rows, and one count per keyword (name: substring, whatever the case), in one pass."""
    counts = [F.count_if(F.col(text).ilike(f"%{k}%")).alias(name) for name, k in keywords.items()]
    return df.where(F.col(ts).isNotNull()).groupBy(month(F.col(ts)).alias("month")).agg(F.count("*").alias("n"), *counts)


def event_window(df: DataFrame, ts: str, by: str | None, day: str, months: int) -> DataFrame:
    """Monthly means before and after an event: rows from `months` before the day to `months` after it; a month before the
    event's month is before, that month and later ones are after; the mean is over months that have rows. pct is NaN
    without anything before. Boundary months count as whole months, so the numbers of months come out too."""
    d = F.lit(day).cast("date")
    rows = df.where((F.col(ts) >= F.add_months(d, -months)) & (F.col(ts) < F.add_months(d, months))).select(*([by] if by else []), month(F.col(ts)).alias("ym"))
    before = F.col("ym") < day[:7]
    out = rows.groupBy(*([by] if by else [])).agg(
        F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"),
        F.count_distinct(F.when(before, F.col("ym"))).alias("months_before"), F.count_distinct(F.when(~before, F.col("ym"))).alias("months_after"),
    )
    out = out.withColumn("avg_before", F.coalesce(F.try_divide("n_before", "months_before"), F.lit(0.0))).withColumn("avg_after", F.coalesce(F.try_divide("n_after", "months_after"), F.lit(0.0)))
    return out.withColumn("pct", F.coalesce(F.try_divide((F.col("avg_after") - F.col("avg_before")) * 100.0, F.col("avg_before")), F.lit(float("nan"))))


def top_by_count(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def gaps(a: DataFrame, b: DataFrame, category: str, excluded: str = "none") -> DataFrame:
    """Percent shares of two tables side by side and their difference, for the categories of either."""
    one = lambda t, name: share_without(t, [], category, excluded).where(F.col(category) != excluded).select(category, F.col("pct").alias(name))
    j = one(a, "pct_a").join(one(b, "pct_b"), category, "full").na.fill(0.0)
    return j.withColumn("gap", F.col("pct_a") - F.col("pct_b"))


def histogram(df: DataFrame, length: Column, edges: list[int]) -> DataFrame:
    """Counts per right-closed bucket (prev, edge], the last one open."""
    bucket = F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        bucket = F.when(length <= e, F.lit(f"<={e}")).otherwise(bucket)
    return df.where(length.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(length).alias("mean"), F.max(length).alias("longest"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts of two labels, and the rate of agreement over all rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.groupBy(a, b).agg(F.count("*").alias("n"))
    rate = n.agg((F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    return n.crossJoin(F.broadcast(rate))


def annualised(n: Column, days: Column) -> Column:
    """A count over so many days as a count per year, rounded."""
    return F.round(F.try_divide(n * 365.0, days)).cast("long")


def ema(values: Column, alpha: float = 0.3) -> Column:
    """Exponential mean of an array in its order; null for an empty one."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x.cast("double")).otherwise(alpha * x + (1 - alpha) * acc))


def eta(values: Column, left: Column) -> Column:
    """struct(low, high) of the seconds left: the exponential mean of the seconds per piece times the pieces left, with a
    margin that narrows with the number of observations; null under five."""
    n = F.size(values)
    margin = F.when(n >= 50, 0.2).when(n >= 20, 0.35).otherwise(0.5)
    mid = ema(values) * left
    return F.when(n >= 5, F.struct((mid * (1 - margin)).alias("low"), (mid * (1 + margin)).alias("high")))


def top_matrix(df: DataFrame, key: str, column: str, n: int, columns: list[str]) -> DataFrame:
    """(key, total, a column per listed value) of the n most frequent keys, ties to the smaller; the keys are a table of n
    rows, so the matrix is one more pass with a broadcast."""
    top = top_by_count(df, key, n).withColumnRenamed("n", "total")
    cells = df.join(F.broadcast(top), key).groupBy(key, "total").pivot(column, columns).agg(F.count(F.lit(1)))
    return cells.na.fill(0)


def gap_order(df: DataFrame, group: str, category: str, base: Column, excluded: str = "none") -> DataFrame:
    """(category, mean_gap, groups): the mean absolute difference between each group's percent share of a category and the
    share in the base rows; the mean is over all groups, and a category that a group lacks is 0 % there."""
    share = share_without(df.where(~base), [group], category, excluded).where(F.col(category) != excluded)
    ref = share_without(df.where(base), [], category, excluded).where(F.col(category) != excluded).select(category, F.col("pct").alias("base_pct"))
    groups = df.where(~base & F.col(category).isNotNull()).select(group).distinct()
    every = share.select(category).unionByName(ref.select(category)).distinct()
    grid = every.crossJoin(F.broadcast(groups)).join(share.select(group, category, "pct"), [group, category], "left").join(ref, category, "left")
    gap = F.abs(F.coalesce("pct", F.lit(0.0)) - F.coalesce("base_pct", F.lit(0.0)))
    return grid.groupBy(category).agg(F.avg(gap).alias("mean_gap"), F.count("*").alias("groups"))


def topic_stats(topics: DataFrame) -> DataFrame:
    """(attr, group_id, label, total, members) of topics (attr, topic_id, group_id, group_label, label, count): members by
    falling count, the group's label where several topics share it, else the topic's own. Groups are small lists."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "topic_id", "label", "count", "group_label"))), lambda m: m)
    g = topics.groupBy("attr", "group_id").agg(F.sum("count").alias("total"), order.alias("m"))
    named = F.get(F.filter("m", lambda m: F.coalesce(m["group_label"], F.lit("")) != ""), F.lit(0))["group_label"]
    label = F.when(F.size("m") > 1, F.coalesce(named, F.col("m")[0]["label"])).otherwise(F.col("m")[0]["label"])
    return g.select("attr", "group_id", label.alias("label"), "total", F.transform("m", lambda m: m["topic_id"]).alias("members"))
