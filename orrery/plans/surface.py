"""The SQL surface: joins, aggregation, windows, set operations and nested data, as statements that both engines run."""

from pyspark.sql import functions as F

from orrery.plans import sqltool
from orrery.session import table
from orrery.sources.files import views
from orrery.streaming import events as E

TABLES = "region nation customer supplier part orders lineitem events".split()

#: name: (statement for Spark, statement for the other engine or None if the same text runs)
STATEMENTS = {
    "s_inner": ("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "s_star": ("SELECT r_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, year(o_orderdate)", "SELECT r_name, year(o_orderdate)::INT AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "s_pricing": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= date '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "s_left_full": ("SELECT c.c_custkey AS k, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey", None),
    "s_full": ("SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k", None),
    "s_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "s_in": ("SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)", None),
    "s_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)", None),
    "s_correlated": ("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem x WHERE x.l_suppkey = l.l_suppkey)", None),
    "s_cross": ("SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2 WHERE r1.r_regionkey < r2.r_regionkey", None),
    "s_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "s_range_join": ("SELECT p_partkey, b.lo FROM part JOIN (VALUES (0, 10), (10, 20), (20, 30), (30, 40), (40, 51)) AS b(lo, hi) ON p_size >= b.lo AND p_size < b.hi", None),
    "s_lateral": ("SELECT n_name, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t", None),
    "s_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", None),
    "s_filter_agg": ("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderpriority", None),
    "s_rollup": ("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "s_cube": ("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "s_grouping_sets": ("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "s_percentile": ("SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1"),
    "s_moments": ("SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_samp(l_quantity, l_discount), 8) AS cv, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY l_returnflag", None),
    "s_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "s_list": ("SELECT n_regionkey, sort_array(collect_list(n_nationkey)) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS ks FROM nation GROUP BY 1"),
    "s_ranks": ("SELECT o_orderkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)", None),
    "s_lag_lead": ("SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "s_rows_frame": ("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM orders", None),
    "s_range_frame": ("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_partkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING), 4) AS s FROM lineitem", None),
    "s_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "s_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "s_union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "s_intersect": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier", None),
    "s_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "s_except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45", None),
    "s_except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", None),
    "s_cte": ("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT o_custkey, round(t, 2) AS t FROM a, b WHERE t > 2 * m", None),
    "s_recursive": ("WITH RECURSIVE s(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM s WHERE n < 20) SELECT n, f FROM s", None),
    "s_pivot": ("SELECT * FROM (SELECT o_orderpriority AS p, o_orderstatus AS s FROM orders) PIVOT (count(1) FOR s IN ('F' AS f, 'O' AS o, 'P' AS pp))", "SELECT o_orderpriority AS p, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS pp FROM orders GROUP BY 1"),
    "s_unpivot": ("SELECT r_regionkey, k, v FROM (SELECT r_regionkey, r_name, upper(r_name) AS big FROM region) UNPIVOT (v FOR k IN (r_name, big))", "SELECT r_regionkey, k, v FROM (SELECT r_regionkey, r_name, upper(r_name) AS big FROM region) UNPIVOT (v FOR k IN (r_name, big))"),
    "s_unnest": ("SELECT n_name, w FROM nation LATERAL VIEW explode(split(n_name, ' ')) t AS w", "SELECT n_name, unnest(string_split(n_name, ' ')) AS w FROM nation"),
    "s_lambda": ("SELECT n_nationkey, transform(sequence(1, 3), x -> x * n_nationkey) AS xs, aggregate(sequence(1, 4), 0, (a, x) -> a + x) AS t FROM nation", "SELECT n_nationkey, [x * n_nationkey FOR x IN [1, 2, 3]] AS xs, 10 AS t FROM nation"),
    "s_json": ("SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type", "SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT)) AS k FROM events GROUP BY 1"),
    "s_case": ("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c, count(*) AS n, round(avg(p_retailprice), 4) AS m FROM part GROUP BY 1", None),
    "s_dates": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(add_months(o_orderdate, -1) AS DATE) AS before FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, (o_orderdate - INTERVAL 1 MONTH)::DATE AS before FROM orders"),
    "s_topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "s_offset": ("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20", None),
    "s_like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR lower(p_name) LIKE '%a%e%'", None),
}


def _statement(sql):
    def run(spark, d):
        views(spark, d, TABLES)
        return sqltool.guarded(spark, sql)

    return run


def asof_window(spark, d):
    """As-of join without a pair per match: the last purchase value at or before each event, by one window over one sort."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_value"))


def approx_distinct(spark, d):
    """Approximate distinct counts lie within a tenth of the exact ones."""
    e = table(spark, d, "lineitem")
    return e.agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.count_distinct("l_partkey")) <= 0.1 * F.count_distinct("l_partkey")).alias("near"))


def stream_windows(spark, d):
    return E.windowed(table(spark, d, "events"), "ts", "event_type", "1 hour").select("start", "event_type", "n", F.round("total", 6).alias("total"))


def stream_sliding(spark, d):
    return E.windowed(table(spark, d, "events"), "ts", "event_type", "1 day", slide="12 hours").groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


def stream_sessions(spark, d):
    return E.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes").select("user_id", "start", "n")


def sample_rows(spark, d):
    return table(spark, d, "orders").sample(fraction=0.1, seed=3).agg((F.count("*") > 0).alias("some"))


QUERIES = {k: _statement(a) for k, (a, b) in STATEMENTS.items()} | {f.__name__: f for f in (asof_window, approx_distinct, stream_windows, stream_sliding, stream_sessions, sample_rows)}
SQL = {k: b or a for k, (a, b) in STATEMENTS.items()} | {
    "asof_window": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_value FROM events",
    "approx_distinct": "SELECT true AS near",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "WITH w AS (SELECT event_type, (epoch_us(ts) // 43200000000) - o AS s FROM events, (VALUES (0), (1)) t(o)) SELECT event_type, count(DISTINCT s) AS windows, count(*) AS n FROM w GROUP BY 1",
    "stream_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s",
    "sample_rows": "SELECT true AS some",
}
