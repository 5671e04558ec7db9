"""Registered queries on references between tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.dates import loose_date
from orrery.operators.orphans import known_keys, orphans, references
from orrery.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    cls = table(spark, d, "bill_classifications").where(F.col("source").startswith("kr_"))
    refs = [
        references(cls, "bill_classifications", F.col("bill_id"), F.to_date("classified_at")),
        references(table(spark, d, "bill_text"), "bill_text", F.col("bill_id"), F.to_date("extracted_at")),
        references(table(spark, d, "v_vote"), "v_vote", F.col("bill_id"), loose_date(F.col("vote_date"))),
    ]
    return orphans(refs, known_keys(table(spark, d, "v_bill"), table(spark, d, "bill_tombstones")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "period", "bill_id", "kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and distinct orphan keys per table, period and kind."""
    return _orphans(spark, d).groupBy("ref_table", "period", "kind").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_keys"))


_DAY = r"""coalesce(
  try_strptime(nullif(regexp_extract(trim(vote_date), '^(\d{8})(?:\D|$)', 1), ''), '%Y%m%d')::DATE,
  try_strptime(nullif(regexp_replace(regexp_extract(trim(vote_date), '^\d{4}\s*(?:[-./]|년)\s*\d{1,2}\s*(?:[-./]|월)\s*\d{1,2}'), '[^0-9]+', '-', 'g'), ''), '%Y-%m-%d')::DATE)"""
_ORPHANS = rf"""
WITH refs AS (
  SELECT 'bill_classifications' AS ref_table, upper(trim(bill_id, E' \t\n\r')) AS bill_id, classified_at::DATE AS day FROM bill_classifications WHERE source LIKE 'kr\_%' ESCAPE '\'
  UNION ALL SELECT 'bill_text', upper(trim(bill_id, E' \t\n\r')), extracted_at::DATE FROM bill_text
  UNION ALL SELECT 'v_vote', upper(trim(bill_id, E' \t\n\r')), {_DAY} FROM v_vote),
held AS (SELECT upper(trim(bill_id, E' \t\n\r')) AS bill_id, min(fetched_at)::DATE AS first_day FROM v_bill GROUP BY 1),
gone AS (SELECT DISTINCT upper(trim(bill_id, E' \t\n\r')) AS bill_id FROM bill_tombstones),
o AS (
  SELECT r.ref_table, coalesce(strftime(r.day, '%Y-%m'), 'unknown') AS period, r.bill_id,
    CASE WHEN h.bill_id IS NULL AND g.bill_id IS NULL THEN 'missing' WHEN h.bill_id IS NULL THEN 'deleted' WHEN r.day < h.first_day THEN 'late' END AS kind
  FROM refs r LEFT JOIN held h USING (bill_id) LEFT JOIN gone g USING (bill_id) WHERE r.bill_id IS NOT NULL)
"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": _ORPHANS + "SELECT DISTINCT ref_table, period, bill_id, kind FROM o WHERE kind IS NOT NULL",
    "p6_report": _ORPHANS + "SELECT ref_table, period, kind, count(*) AS n_refs, count(DISTINCT bill_id) AS n_keys FROM o WHERE kind IS NOT NULL GROUP BY ALL",
}
