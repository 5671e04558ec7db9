"""The read-only SQL surface: guarded statements, catalog listing, bounded rendering."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

SHOWN = 50
_COMMENT = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", re.S)


class NotReadOnly(ValueError):
    pass


def guarded(spark: SparkSession, sql: str) -> DataFrame:
    """The plan of one SELECT, WITH or parenthesised statement. The parser decides: commands and inserts are refused, before
    anything runs."""
    body = _COMMENT.sub("", sql).rstrip().rstrip(";")
    if not re.match(r"(?i)(select|with|values|from)\b|\(", body):
        raise NotReadOnly("only SELECT and WITH are allowed")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    kinds = parsed.toString()
    name = parsed.getClass().getSimpleName()
    if re.search(r"Command|Insert|Create|Drop|Merge|Update|Delete|Alter", name) or re.search(r"(?m)^\W*'?(InsertIntoStatement|CreateTable|MergeIntoTable|DeleteFromTable|UpdateTable)\b", kinds):
        raise NotReadOnly(f"{name} is not read-only")
    return spark.sql(body)


def render(df: DataFrame, shown: int = SHOWN) -> str:
    """Up to 50 rows as JSON and a note whether there are more; the plan is limited, so nothing else is fetched."""
    rows = df.limit(shown + 1).toJSON().collect()
    more = len(rows) > shown
    return json.dumps({"columns": df.columns, "rows": [json.loads(r) for r in rows[:shown]], "more": more}, ensure_ascii=False)


def query(spark: SparkSession, sql: str) -> str:
    try:
        return render(guarded(spark, sql))
    except Exception as e:  # noqa: BLE001
        return f"error: {str(e).splitlines()[0][:500]}"


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe(spark: SparkSession, name: str) -> dict:
    df = spark.table(name)
    return {"columns": df.dtypes, "rows": df.count(), "sample": [r.asDict(recursive=True) for r in df.limit(3).collect()]}
