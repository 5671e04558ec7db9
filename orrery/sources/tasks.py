"""Work lists of a paged collection, as tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _key(api: str, *parts) -> Column:
    return F.concat_ws("__", F.lit(api), *[F.concat(F.lit(f"{n}_"), c.cast("string")) for n, c in parts])


def tasks(spark: SparkSession, api: str, strategy: str, ages: range = range(0), years: range = range(0), first: str = "", last: str = "", lookup: DataFrame | None = None, column: str = "") -> DataFrame:
    """(task_key, params) of one strategy: none, age, age_unit, year, year_host, age_year, daily, committee, lookup_bill,
    lookup_bill_age or lookup_conf. Lookups take the distinct non-null values of a column."""
    one = spark.range(1)
    age = one.select(F.explode(F.sequence(F.lit(ages.start), F.lit(ages.stop - 1))).alias("a")) if len(ages) else None
    year = one.select(F.explode(F.sequence(F.lit(years.start), F.lit(years.stop - 1))).alias("y")) if len(years) else None

    def out(df, *parts):
        params = F.create_map(*[x for n, c in parts for x in (F.lit(n), c.cast("string"))]) if parts else F.create_map().cast("map<string,string>")
        return df.select(_key(api, *parts).alias("task_key"), params.alias("params"))

    if strategy == "none":
        return out(one)
    if strategy == "age":
        return out(age, ("AGE", F.col("a")))
    if strategy == "age_unit":
        return out(age, ("UNIT_CD", F.col("a") + 100000))
    if strategy in ("year", "year_host"):
        return out(year, ("YEAR" if strategy == "year" else "HOST_DT", F.col("y")))
    if strategy == "age_year":
        return out(age.crossJoin(year), ("AGE", F.col("a")), ("YEAR", F.col("y")))
    if strategy == "daily":
        return out(one.select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")), ("DATE", F.col("d")))
    if strategy in ("committee", "lookup_bill", "lookup_conf"):
        return out(lookup.where(F.col(column).isNotNull()).select(column).distinct(), (column.upper(), F.col(column)))
    if strategy == "lookup_bill_age":
        return out(lookup.where(F.col(column).isNotNull() & F.col("age").isNotNull()).select(column, "age").distinct(), ("AGE", F.col("age")), (column.upper(), F.col(column)))
    raise ValueError(f"unknown strategy {strategy}")


def stale(progress: DataFrame, now: Column, current_age: int, days: int = 7, current_days: int = 1) -> DataFrame:
    """Tasks to fetch again: not strictly newer than the cut-off, which is closer for the current term."""
    current = F.regexp_extract("task_key", r"__AGE_(-?\d+)", 1) == str(current_age)
    limit = F.when(current, F.lit(current_days)).otherwise(F.lit(days))
    return progress.where(F.col("fetched_at").isNull() | ~(F.col("fetched_at") > now - F.make_dt_interval(limit)))


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns of both, folded by letter case; missing ones null; trimmed text, empty text null."""
    low = lambda df: df.select(*[F.col(c).alias(c.lower()) for c in df.columns])
    out = low(old).unionByName(low(new), allowMissingColumns=True)
    return out.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])
