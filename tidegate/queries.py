"""The registered queries of the dialect's operators and, for each, DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.engine import Engine
from tidegate.functions import call
from tidegate.operators import joins, partitions, recursive, search, setops, sort, temporal, windows
from tidegate.sources import parquet
from tidegate.storage import new_path
from tidegate.streaming import windows as streams

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def _dialect(name: str, sql: str, oracle: str | None = None, args: list | None = None) -> None:
    """A query in the dialect. Without an oracle text DuckDB reads the same words."""
    _queries[name] = lambda spark, sf_dir: Engine(spark, sf_dir).sql(sql, args)
    _oracle[name] = oracle or sql


def _frame(oracle: str | None):
    """A query of the DataFrame API, named as its function."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracle[f.__name__] = oracle
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [parquet.table(spark, sf_dir, n) for n in names]


# flagship and scans

FLAGSHIP = """
SELECT n_name, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1998-01-01'
GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10"""
_dialect("flagship_revenue_by_nation", FLAGSHIP)
_dialect("scan_full", "SELECT * FROM nation")
_dialect("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
_dialect("scan_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = ?", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7", [7])
_dialect("scan_derived_table", "SELECT big, COUNT(*) AS n FROM (SELECT o_totalprice > 200000 AS big FROM orders) AS d GROUP BY big")
_dialect("select_without_from", "SELECT 1 + 2 AS a, 7 / 2 AS b, 'x' || 'y' AS c, NULL IS NULL AS d", "SELECT 1 + 2 AS a, 3.5::DOUBLE AS b, 'x' || 'y' AS c, NULL IS NULL AS d")

# predicates and operators

_dialect("where_three_valued", "SELECT COUNT(*) AS n FROM customer WHERE NOT (NULLIF(c_mktsegment, 'BUILDING') = 'AUTOMOBILE') OR c_acctbal < 0")
_dialect("null_safe_equality", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) <=> NULL AND c_nationkey IS NOT DISTINCT FROM 3", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) IS NULL AND c_nationkey = 3")
_dialect("is_true_unknown", "SELECT COUNT(*) AS n FROM customer WHERE (NULLIF(c_nationkey, 5) > 10) IS UNKNOWN OR (c_acctbal > 5000) IS TRUE", "SELECT COUNT(*) AS n FROM customer WHERE (NULLIF(c_nationkey, 5) > 10) IS NULL OR (c_acctbal > 5000)")
_dialect("between_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand NOT IN ('Brand#11', 'Brand#22')")
_dialect("like_escape", "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!' AND n_name NOT LIKE '%!_1_' ESCAPE '!' OR n_name LIKE '_ATION_2%'")
_dialect("regexp_glob", "SELECT n_name FROM nation WHERE n_name REGEXP '^NATION_[12][0-9]$' AND n_name GLOB 'NATION_?[0-5]' = 0 AND n_name GLOB '*_2?'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '^NATION_[12][0-9]$') AND n_name GLOB '*_2?'")
_dialect("arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 3 AS a, l_partkey % 7 AS b, -l_linenumber AS c, l_suppkey / (l_linenumber - l_linenumber) AS d FROM lineitem",
         "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 3 AS a, l_partkey % 7 AS b, -l_linenumber AS c, CAST(NULL AS DOUBLE) AS d FROM lineitem")
_dialect("bitwise", "SELECT o_orderkey, o_orderkey & 6 AS a, o_orderkey | 9 AS b, o_orderkey ^ 5 AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e, ~o_orderkey AS f FROM orders",
         "SELECT o_orderkey, o_orderkey & 6 AS a, o_orderkey | 9 AS b, xor(o_orderkey, 5) AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e, ~o_orderkey AS f FROM orders")
_dialect("case_expression", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
_dialect("cast_never_fails", "SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS a, CAST(c_name AS INTEGER) AS b, CAST(c_custkey AS TEXT) AS c, CAST(c_mktsegment AS REAL) AS d FROM customer",
         "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(c_custkey AS VARCHAR) AS c, CAST(0 AS DOUBLE) AS d FROM customer")
_dialect("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)")
_dialect("correlated_subquery", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
_dialect("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_dialect("not_in_subquery_nulls", "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(c_nationkey, 3) FROM customer)")
_dialect("exists_not_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 2)")

# joins

_dialect("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_dialect("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000) AS o ON c_custkey = o_custkey")
_dialect("join_right", "SELECT n_name, c_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) AS c RIGHT JOIN nation ON c_nationkey = n_nationkey")
_dialect("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) AS a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 9) AS b ON a.k = b.k")
_dialect("join_cross", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
_dialect("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_dialect("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) AS x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) AS y")
_dialect("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) AS x LEFT JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier WHERE s_acctbal > 5000) AS y USING (k)")
_dialect("join_self", "SELECT a.o_custkey AS cust, COUNT(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey")
_dialect("join_five_way", "SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name")


@_frame("SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def join_salted(spark, sf_dir):
    """A join that spreads hot keys itself, then an aggregation with a map-side part."""
    orders, customer = _t(spark, sf_dir, "orders", "customer")
    both = joins.salted(orders.withColumnRenamed("o_custkey", "k"), customer.select(F.col("c_custkey").alias("k")), "k", 8)
    return both.groupBy(F.col("k").alias("o_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_frame("SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a JOIN supplier b ON NULLIF(a.n_nationkey, 4) IS NOT DISTINCT FROM NULLIF(b.s_nationkey, 4)")
def join_null_safe(spark, sf_dir):
    nation, supplier = _t(spark, sf_dir, "nation", "supplier")
    a = nation.select(F.expr("nullif(n_nationkey, 4)").alias("k"), F.col("n_nationkey").alias("x"))
    b = supplier.select(F.expr("nullif(s_nationkey, 4)").alias("k"), F.col("s_suppkey").alias("y"))
    return joins.null_safe(a, b, ["k"]).select("x", "y")


# aggregates

_dialect("aggregate_global", "SELECT COUNT(*) AS n, COUNT(NULLIF(l_returnflag, 'N')) AS m, COUNT(DISTINCT l_suppkey) AS d, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem")
_dialect("aggregate_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MAX(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0")
_dialect("pricing_summary", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, ROUND(AVG(l_discount), 6) AS disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
_dialect("group_by_expression", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)")
_dialect("group_by_alias_ordinal", "SELECT o_orderstatus AS st, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY st, 2")
_dialect("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15 AND MAX(o_totalprice) > 300000")
_dialect("having_without_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 5")
_dialect("aggregate_filter", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS big, ROUND(SUM(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS tax FROM lineitem GROUP BY l_returnflag")
_dialect("aggregate_expressions", "SELECT l_suppkey, ROUND(SUM(l_extendedprice) / COUNT(*), 3) AS mean, ROUND(MAX(l_quantity) - MIN(l_quantity), 2) AS spread FROM lineitem GROUP BY l_suppkey")
_dialect("aggregate_spread", "SELECT c_mktsegment, ROUND(STDDEV(c_acctbal), 4) AS sp, ROUND(STDDEV_SAMP(c_acctbal), 4) AS ss, ROUND(VARIANCE(c_acctbal), 2) AS vp, ROUND(VAR_SAMP(c_acctbal), 2) AS vs FROM customer GROUP BY c_mktsegment",
         "SELECT c_mktsegment, ROUND(stddev_pop(c_acctbal), 4) AS sp, ROUND(stddev_samp(c_acctbal), 4) AS ss, ROUND(var_pop(c_acctbal), 2) AS vp, ROUND(var_samp(c_acctbal), 2) AS vs FROM customer GROUP BY c_mktsegment")
_dialect("group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '; ') AS names, GROUP_CONCAT(DISTINCT LEFT(n_name, 8)) AS heads FROM nation GROUP BY n_regionkey",
         "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(DISTINCT left(n_name, 8), ',' ORDER BY left(n_name, 8)) AS heads FROM nation GROUP BY n_regionkey")
_dialect("json_aggregates", "SELECT r_regionkey, JSON_OBJECTAGG(n_name, n_nationkey) AS o FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey",
         "SELECT r_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
_dialect("json_arrayagg_keeps_nulls", "SELECT JSON_ARRAYAGG(x) AS a FROM (SELECT NULLIF(n_regionkey, n_regionkey) AS x FROM nation WHERE n_nationkey < 3) AS d", "SELECT '[null,null,null]' AS a")
_dialect("count_distinct_groups", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, ROUND(SUM(DISTINCT l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag")
_dialect("aggregate_over_derived", "SELECT MAX(n) AS most, ROUND(AVG(n), 6) AS mean FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS d")
_dialect("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, NULLIF(l_linenumber, 1) AS k FROM lineitem")


@_frame("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_extension(spark, sf_dir):
    """Beyond the dialect."""
    (orders,) = _t(spark, sf_dir, "orders")
    return orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@_frame("SELECT n_regionkey, first(n_name ORDER BY n_nationkey) AS first_name, MAX(n_nationkey) AS top FROM nation GROUP BY n_regionkey")
def ungrouped_column_first_row(spark, sf_dir):
    """The dialect's value of an ungrouped column: that of the group's first row in the file."""
    return Engine(spark, sf_dir).sql("SELECT n_regionkey, n_name AS first_name, MAX(n_nationkey) AS top FROM nation GROUP BY n_regionkey")


# windows

_W = "SELECT event_id, user_id, {0} AS x FROM events"
for _name, _call in {
    "window_row_number": "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts)",
    "window_rank": "RANK() OVER (PARTITION BY user_id ORDER BY event_type)",
    "window_dense_rank": "DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type DESC)",
    "window_ntile": "NTILE(4) OVER (PARTITION BY user_id ORDER BY ts)",
}.items():
    _dialect(_name, _W.format(f"CAST({_call} AS BIGINT)"))
for _name, _call in {
    "window_percent_rank": "PERCENT_RANK() OVER (PARTITION BY user_id ORDER BY event_type)",
    "window_cume_dist": "CUME_DIST() OVER (PARTITION BY user_id ORDER BY event_type)",
    "window_sum_peers": "SUM(value) OVER (PARTITION BY user_id ORDER BY event_type)",
    "window_avg_frame": "AVG(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "window_sum_following": "SUM(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}.items():
    _dialect(_name, f"SELECT event_id, user_id, ROUND({_call}, 6) AS x FROM events")
_dialect("window_lag_lead", "SELECT event_id, LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS a, LEAD(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events",
         "SELECT event_id, LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS a, LEAD(value, 2, -1.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events")
_dialect("window_first_last_nth", "SELECT event_id, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS a, LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b, LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c, NTH_VALUE(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events",
         "SELECT event_id, FIRST_VALUE(event_type) OVER w AS a, event_type AS b, LAST_VALUE(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, NTH_VALUE(event_type, 2) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
_dialect("window_range_counts_rows", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE 3 PRECEDING) AS x FROM events",
         "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS x FROM events")
_dialect("window_filter", "SELECT event_id, COUNT(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts) AS x FROM events")
_dialect("window_min_max_count", "SELECT event_id, MIN(value) OVER (PARTITION BY event_type) AS a, MAX(value) OVER (PARTITION BY event_type) AS b, COUNT(*) OVER (PARTITION BY event_type) AS c, ROUND(value - AVG(value) OVER (PARTITION BY event_type), 4) AS d FROM events")
_dialect("window_null_order", "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'view'), event_id) AS BIGINT) AS a, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'view') DESC, event_id) AS BIGINT) AS b FROM events",
         "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'view') NULLS LAST, event_id) AS a, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'view') DESC NULLS FIRST, event_id) AS b FROM events")
_dialect("window_over_join_group", "SELECT c_nationkey, n, CAST(RANK() OVER (ORDER BY n DESC, c_nationkey) AS BIGINT) AS place FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey) AS d")


@_frame("SELECT event_id, CAST(COUNT(CASE WHEN value > 50 THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS n, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS f FROM events")
def window_helpers(spark, sf_dir):
    (events,) = _t(spark, sf_dir, "events")
    spec = windows.over(["user_id"], ["ts"], (-4, 0))
    return events.select("event_id", windows.filtered(F.count, None, F.col("value") > 50, spec).alias("n"), windows.first_value("event_id", ["user_id"], ["ts"]).alias("f"))


# order, limits, set operations, recursion

_dialect("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
_dialect("order_nulls", "SELECT k FROM (SELECT NULLIF(n_regionkey, 0) AS k, n_nationkey FROM nation) AS d ORDER BY k, n_nationkey LIMIT 22", "SELECT k FROM (SELECT NULLIF(n_regionkey, 0) AS k, n_nationkey FROM nation) AS d ORDER BY k NULLS LAST, n_nationkey LIMIT 22")
_dialect("order_nulls_first", "SELECT NULLIF(n_regionkey, 0) AS k, n_nationkey FROM nation ORDER BY 1 NULLS FIRST, 2 LIMIT 7")
_dialect("order_hidden_aggregate", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY SUM(o_totalprice) DESC LIMIT 3")
_dialect("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
_dialect("union_distinct", "SELECT NULLIF(n_regionkey, 1) AS k FROM nation UNION SELECT NULLIF(r_regionkey, 2) FROM region")
_dialect("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
_dialect("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_dialect("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
_dialect("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_dialect("set_operations_left_to_right", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2 ORDER BY k LIMIT 5",
         "SELECT * FROM ((SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2) ORDER BY k LIMIT 5")
_dialect("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey WHERE n > 1")
_dialect("recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t")
_dialect("recursive_union_cycle", "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT (r.k * 2 + 1) % 25 FROM r) SELECT k FROM r",
         "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT CAST((r.k * 2 + 1) % 25 AS INTEGER) FROM r) SELECT k FROM r")


@_frame("(SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 6) UNION ALL SELECT r_regionkey FROM region")
def set_operation_chain(spark, sf_dir):
    nation, supplier, region = _t(spark, sf_dir, "nation", "supplier", "region")
    return setops.chain(nation.select(F.col("n_nationkey").alias("k")), ("EXCEPT", supplier.filter("s_suppkey < 6").select("s_nationkey")), ("UNION ALL", region.select("r_regionkey")))


@_frame("WITH RECURSIVE r(a) AS (SELECT o_custkey FROM orders WHERE o_orderkey = 1 UNION SELECT o2.o_custkey FROM r JOIN orders o1 ON o1.o_custkey = r.a JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1) SELECT a FROM r")
def recursive_reachability(spark, sf_dir):
    """Customers reached through consecutive orders: a fixed point over a cyclic graph."""
    (orders,) = _t(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1).alias("o_orderkey")).join(orders, "o_orderkey").select("a", F.col("o_custkey").alias("b"))
    return recursive.fixpoint(orders.filter("o_orderkey = 1").select(F.col("o_custkey").alias("a")), lambda r: r.join(edges, "a").select(F.col("b").alias("a")), rows=None)  # no more rows than customers


@_frame("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def top_k(spark, sf_dir):
    (customer,) = _t(spark, sf_dir, "customer")
    return sort.top(customer.select("c_custkey", "c_acctbal"), 15, "-c_acctbal", "c_custkey")


# scalar functions

_dialect("functions_string", """SELECT doc_id, LENGTH(text) AS len, UPPER(lang) AS up, LOWER(source) AS lo, TRIM('  a b ') AS tr, LTRIM('xxab', 'x') AS lt, RTRIM('abyy', 'y') AS rt, CONCAT(lang, '-', source) AS cc,
  CONCAT_WS('/', lang, NULL, source) AS cw, REPLACE(source, 'src', 's') AS rp, REVERSE(source) AS rv, REPEAT(lang, 2) AS rr, LPAD(lang, 5, '*') AS lp, RPAD(lang, 1, '*') AS rq, INSTR(source, 'c') AS ins, LOCATE('r', source, 2) AS loc,
  SUBSTRING_INDEX('a.b.c', '.', 2) AS si, SUBSTR(source, 2, 2) AS sb, SUBSTR(source, -20, 3) AS sn, LEFT(source, 3) AS le, RIGHT(source, 2) AS ri, ASCII(lang) AS asc_, HEX(255) AS hx, QUOTE('it''s') AS qu, CHAR(72, 105) AS ch, PRINTF('%s-%d', lang, 5) AS pf FROM documents""",
         """SELECT doc_id, strlen(text) AS len, upper(lang) AS up, lower(source) AS lo, 'a b' AS tr, 'ab' AS lt, 'ab' AS rt, lang || '-' || source AS cc,
  lang || '/' || source AS cw, replace(source, 'src', 's') AS rp, reverse(source) AS rv, repeat(lang, 2) AS rr, lpad(lang, 5, '*') AS lp, rpad(lang, 1, '*') AS rq, instr(source, 'c') AS ins, CAST(CASE WHEN instr(substr(source, 2), 'r') > 0 THEN instr(substr(source, 2), 'r') + 1 ELSE 0 END AS BIGINT) AS loc,
  'a.b' AS si, substr(source, 2, 2) AS sb, substr(source, 1, 3) AS sn, left(source, 3) AS le, right(source, 2) AS ri, CAST(ascii(lang) AS BIGINT) AS asc_, 'FF' AS hx, '''it''''s''' AS qu, 'Hi' AS ch, lang || '-5' AS pf FROM documents""")
_dialect("functions_math", """SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal, 1) AS r, ROUND(c_acctbal, -2) AS r2, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, MOD(c_custkey, 7) AS m, MOD(c_custkey, 0) AS m0, POWER(c_nationkey, 2) AS p, ROUND(SQRT(ABS(c_acctbal)), 6) AS s, SIGN(c_acctbal) AS sg,
  TRUNCATE(c_acctbal, 1) AS t, ROUND(LN(c_custkey + 1), 6) AS l, ROUND(LOG(2, c_custkey + 1), 6) AS lb, ROUND(EXP(c_nationkey / 10), 6) AS e, GREATEST(c_custkey, c_nationkey) AS g, LEAST(c_custkey, NULL) AS le, ROUND(SIN(c_custkey) + COS(c_custkey) + ATAN2(c_custkey, 3) + RADIANS(c_nationkey) + DEGREES(1) + PI(), 6) AS trig FROM customer""",
         """SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, round(c_acctbal, -2) AS r2, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, c_custkey % 7 AS m, CAST(NULL AS BIGINT) AS m0, CAST(c_nationkey * c_nationkey AS DOUBLE) AS p, round(sqrt(abs(c_acctbal)), 6) AS s, CAST(sign(c_acctbal) AS DOUBLE) AS sg,
  sign(c_acctbal) * floor(abs(c_acctbal) * 10.0::DOUBLE) / 10.0::DOUBLE AS t, round(ln(c_custkey + 1), 6) AS l, round(ln(c_custkey + 1) / ln(2), 6) AS lb, round(exp(c_nationkey / 10), 6) AS e, greatest(c_custkey, c_nationkey) AS g, CAST(NULL AS BIGINT) AS le, round(sin(c_custkey) + cos(c_custkey) + atan2(c_custkey, 3) + radians(c_nationkey) + degrees(1) + pi(), 6) AS trig FROM customer""")
_dialect("functions_conditional", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS a, IFNULL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS b, IIF(c_acctbal < 0, 'debt', 'fine') AS c, TYPEOF(c_acctbal) AS d, TYPEOF(c_name) AS e, TYPEOF(c_custkey) AS f FROM customer",
         "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS a, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS b, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS c, 'real' AS d, 'text' AS e, 'integer' AS f FROM customer")
_dialect("functions_datetime", """SELECT o_orderkey, DATE(o_orderdate) AS d, TIME(o_orderdate) AS t, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS dd, DAYOFYEAR(o_orderdate) AS doy, DAYOFWEEK(o_orderdate) AS dow, WEEKDAY(o_orderdate) AS wd, STRFTIME('%Y/%m/%d %H', o_orderdate) AS sf,
  DATE_ADD(DATE(o_orderdate), 40) AS da, DATE_SUB(DATE(o_orderdate), 40) AS ds, DATEDIFF(o_orderdate, '1995-01-01') AS df, EXTRACT(YEAR FROM o_orderdate) AS ex FROM orders""",
         """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) + 1 AS dow, (dayofweek(o_orderdate) + 6) % 7 AS wd, strftime(o_orderdate, '%Y/%m/%d %H') AS sf,
  strftime(CAST(o_orderdate AS DATE) + 40, '%Y-%m-%d') AS da, strftime(CAST(o_orderdate AS DATE) - 40, '%Y-%m-%d') AS ds, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS df, year(o_orderdate) AS ex FROM orders""")
_dialect("functions_json", "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS INTEGER) AS k, props ->> '$.k' AS t, JSON_VALID(props) AS v, JSON_TYPE(props) AS ty, JSON_TYPE(props, '$.k') AS tk, JSON_ARRAY_LENGTH('[1,2,3]') AS al, JSON_QUOTE(event_type) AS q, JSON_UNQUOTE(JSON_QUOTE(event_type)) AS uq, JSON_OBJECT('e', event_type, 'n', NULL) AS o, JSON_ARRAY(1, event_type, NULL) AS a FROM events",
         """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS t, json_valid(props) AS v, 'object' AS ty, 'number' AS tk, CAST(3 AS BIGINT) AS al, '"' || event_type || '"' AS q, event_type AS uq, '{"e":"' || event_type || '","n":null}' AS o, '[1,"' || event_type || '",null]' AS a FROM events""")
_dialect("functions_json_change", """SELECT event_id, JSON_SET('{"a":1}', '$.b', event_type) AS s, JSON_REMOVE('{"a":1,"b":2}', '$.a') AS r, JSON_MERGE('{"a":[1],"x":{"p":1}}', '{"a":[2],"x":{"q":2}}') AS m, JSON_MINIFY('{ "b" : 1, "a" : 2 }') AS mi FROM events""",
         """SELECT event_id, '{"a":1,"b":"' || event_type || '"}' AS s, '{"b":2}' AS r, '{"a":[1,2],"x":{"p":1,"q":2}}' AS m, '{"a":2,"b":1}' AS mi FROM events""")
_dialect("functions_regex", "SELECT p_partkey, REGEXP_MATCH(p_name, '[0-9]$') AS m, REGEXP_REPLACE(p_brand, '[0-9]', '_') AS r, JSON_ARRAY_LENGTH('[]') AS z FROM part WHERE REGEXP_LIKE(p_brand, '#[1-3]')",
         "SELECT p_partkey, regexp_matches(p_name, '[0-9]$') AS m, regexp_replace(p_brand, '[0-9]', '_', 'g') AS r, CAST(0 AS BIGINT) AS z FROM part WHERE regexp_matches(p_brand, '#[1-3]')")


@_frame("SELECT p_partkey, array_to_string(regexp_extract_all(p_brand, '[0-9]'), '+') AS digits, round(ln(p_size), 6) AS l FROM part")
def functions_as_columns(spark, sf_dir):
    """The same functions on DataFrames."""
    (part,) = _t(spark, sf_dir, "part")
    return part.select("p_partkey", F.array_join(call("REGEXP_EXTRACT", "p_brand", "'[0-9]'"), "+").alias("digits"), F.round(call("LN", "p_size"), 6).alias("l"))


# vectors and full text

_Q = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]
_QS = "[" + ", ".join(f"{x:.1f}" for x in _Q) + "]"
_V = "CAST(embedding AS DOUBLE[])"


@_frame(f"SELECT vec_id, round(list_distance({_V}, {_QS}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY list_distance({_V}, {_QS}::DOUBLE[]), vec_id LIMIT 10")
def vector_knn(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "embeddings")
    q = [float(f"{x:.1f}") for x in _Q]
    return search.knn(e, "embedding", q, 10, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@_frame(f"SELECT vec_id, round(list_distance({_V}, {_QS}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY list_distance({_V}, {_QS}::DOUBLE[]), vec_id LIMIT 10")
def vector_index_knn(spark, sf_dir):
    """The same by an index: every list that can hold one of the nearest."""
    engine = Engine(spark, sf_dir)
    engine.sql("CREATE VECTOR INDEX v ON embeddings (embedding)")
    return engine.search_vector("v", [float(f"{x:.1f}") for x in _Q], k=10).select("vec_id", F.round("distance", 6).alias("distance"))


@_frame(f"SELECT vec_id FROM embeddings WHERE list_distance({_V}, {_QS}::DOUBLE[]) <= 8.9")
def vector_range(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "embeddings")
    return search.within(e, "embedding", [float(f"{x:.1f}") for x in _Q], 8.9).select("vec_id")


_dialect("vector_metrics", f"SELECT vec_id, ROUND(COSINE_SIMILARITY(embedding, {_QS}), 6) AS c, ROUND(L2_DISTANCE(embedding, {_QS}), 6) AS l, ROUND(INNER_PRODUCT(embedding, {_QS}), 5) AS i, L2_DISTANCE(embedding, [1.0]) > 1e300 AS mismatch FROM embeddings",
         f"SELECT vec_id, round(list_cosine_similarity({_V}, {_QS}::DOUBLE[]), 6) AS c, round(list_distance({_V}, {_QS}::DOUBLE[]), 6) AS l, round(list_inner_product({_V}, {_QS}::DOUBLE[]), 5) AS i, true AS mismatch FROM embeddings")


@_frame(f"SELECT q.vec_id AS q, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), e.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 3")
def vector_knn_join(spark, sf_dir):
    """A stated set of queries against all rows."""
    (e,) = _t(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return search.knn_join(queries, e, "q", "embedding", "vec_id", "embedding", 3).select("q", "vec_id", "rank")


_dialect("fulltext_match", "SELECT doc_id FROM documents WHERE MATCH(text, source) AGAINST('the and src1' IN NATURAL LANGUAGE MODE)", "SELECT doc_id FROM documents WHERE contains(lower(text || chr(0) || source), 'the') AND contains(lower(text || chr(0) || source), 'and') AND contains(lower(source), 'src1') OR (contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'src1'))")


@_frame("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'license')")
def fulltext_postings(spark, sf_dir):
    """Rows that hold both words, by an inverted index."""
    (docs,) = _t(spark, sf_dir, "documents")
    return search.search(search.postings(docs, "doc_id", ["text"]), "doc_id", "the license")


# views, time travel, partitions, policies, changes


def _with(spark: SparkSession, sf_dir: str, statements: list[str], user: str | None = None) -> DataFrame:
    engine = Engine(spark, sf_dir, user=user)
    for s in statements[:-1]:
        engine.sql(s)
    return engine.sql(statements[-1])


def _script(name: str, statements: list[str], oracle: str, user: str | None = None) -> None:
    """Several statements of one engine; the last one's rows are compared."""
    _queries[name] = lambda spark, sf_dir: _with(spark, sf_dir, statements, user)
    _oracle[name] = oracle


_script("view", ["CREATE VIEW v (k, total) AS SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey", "SELECT k, ROUND(total, 2) AS total FROM v WHERE total > 1000000"],
        "SELECT o_custkey AS k, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 1000000")
_script("materialized_view", ["CREATE TABLE n AS SELECT n_nationkey, n_regionkey FROM nation", "CREATE MATERIALIZED VIEW m AS SELECT n_regionkey, COUNT(*) AS c FROM n GROUP BY n_regionkey", "DELETE FROM n WHERE n_regionkey = 1", "SELECT n_regionkey, c FROM m"],
        "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS c FROM nation GROUP BY n_regionkey")
_script("materialized_view_refresh", ["CREATE TABLE n AS SELECT n_nationkey, n_regionkey FROM nation", "CREATE MATERIALIZED VIEW m AS SELECT n_regionkey, COUNT(*) AS c FROM n GROUP BY n_regionkey", "DELETE FROM n WHERE n_regionkey = 1", "REFRESH MATERIALIZED VIEW m", "SELECT n_regionkey, c FROM m"],
        "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS c FROM nation WHERE n_regionkey <> 1 GROUP BY n_regionkey")
_script("time_travel", ["CREATE TABLE n AS SELECT n_nationkey FROM nation", "SELECT a.c AS now_rows, b.c AS before_rows FROM (SELECT COUNT(*) AS c FROM n AS OF '+1 hour') AS a CROSS JOIN (SELECT COUNT(*) AS c FROM n AS OF SYSTEM TIME '-1 hour') AS b"],
        "SELECT COUNT(*) AS now_rows, CAST(0 AS BIGINT) AS before_rows FROM nation")


@_frame("SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) <= epoch(TIMESTAMP '1997-01-01') AND (o_orderkey % 3 <> 0 OR epoch(o_orderdate) + 86400 * 100 > epoch(TIMESTAMP '1997-01-01'))")
def time_travel_versions(spark, sf_dir):
    """Versions as columns: made at the order's date, a third of them deleted 100 days later."""
    (orders,) = _t(spark, sf_dir, "orders")
    made = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60 + F.second("o_orderdate")
    versions = orders.select("o_orderkey", made.alias("_created_at")).withColumn("_deleted_at", F.when(F.col("o_orderkey") % 3 == 0, F.col("_created_at") + 86400 * 100).otherwise(F.lit(0)).cast("long"))
    return temporal.as_of(versions, temporal.seconds("1997-01-01")).select("o_orderkey")


@_frame("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS r, CAST(p_partkey % 4 AS VARCHAR) AS h, COUNT(*) AS n FROM part GROUP BY ALL")
def partition_routing(spark, sf_dir):
    (part,) = _t(spark, sf_dir, "part")
    ranged = partitions.route("p_size", "RANGE", [("small", 10), ("middle", 30), ("large", None)])
    return part.select(ranged.alias("r"), partitions.route("p_partkey", "HASH", n=4).alias("h")).groupBy("r", "h").agg(F.count("*").alias("n"))


_script("row_level_security", ["CREATE TABLE c AS SELECT c_custkey, c_nationkey, c_mktsegment FROM customer", "CREATE POLICY a ON c FOR SELECT USING (c_nationkey = 3)", "CREATE POLICY b ON c FOR ALL USING (c_nationkey = 5)", "CREATE POLICY r ON c AS RESTRICTIVE FOR SELECT USING (c_mktsegment <> 'BUILDING')", "ALTER TABLE c ENABLE ROW LEVEL SECURITY", "SELECT c_nationkey, COUNT(*) AS n FROM c GROUP BY c_nationkey"],
        "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, COUNT(*) AS n FROM customer WHERE c_nationkey IN (3, 5) AND c_mktsegment <> 'BUILDING' GROUP BY c_nationkey", user="ann")
_script("insert_select", ["CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT DEFAULT 'none', x REAL)", "INSERT INTO t (k, x) SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO t VALUES (100, 'a', 1.5), (101, DEFAULT, NULL)", "SELECT k, v, x FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, 'none' AS v, CAST(n_regionkey AS DOUBLE) AS x FROM nation UNION ALL SELECT * FROM (VALUES (100, 'a', 1.5), (101, 'none', NULL))")
_script("insert_or_ignore_replace", ["CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "INSERT OR IGNORE INTO t VALUES (1, 'ignored'), (50, 'new')", "REPLACE INTO t VALUES (2, 'replaced'), (51, 'new')", "SELECT k, v FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey WHEN 2 THEN 'replaced' ELSE n_name END AS v FROM nation UNION ALL SELECT * FROM (VALUES (50, 'new'), (51, 'new'))")
_script("upsert", ["CREATE TABLE t (k INTEGER PRIMARY KEY, n INTEGER)", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO t SELECT s_nationkey, COUNT(*) FROM supplier GROUP BY s_nationkey ON CONFLICT (k) DO UPDATE SET n = n + excluded.n * 10 WHERE excluded.n > 1", "SELECT k, n FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey + CASE WHEN c > 1 THEN c * 10 ELSE 0 END AS BIGINT) AS n FROM nation LEFT JOIN (SELECT s_nationkey, COUNT(*) AS c FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
_script("update_where", ["CREATE TABLE t AS SELECT c_custkey, c_acctbal FROM customer", "UPDATE t SET c_acctbal = c_acctbal * 2 WHERE c_custkey % 5 = 0", "SELECT c_custkey, c_acctbal FROM t"],
        "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
_script("update_from", ["CREATE TABLE t AS SELECT c_custkey, c_nationkey, c_name FROM customer", "UPDATE t SET c_name = nation.n_name FROM nation WHERE nation.n_nationkey = t.c_nationkey AND nation.n_regionkey = 1", "SELECT c_custkey, c_name FROM t"],
        "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_script("delete_using", ["CREATE TABLE t AS SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM t USING nation WHERE nation.n_nationkey = t.c_nationkey AND nation.n_regionkey < 3", "SELECT c_custkey FROM t"],
        "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey >= 3")
_script("returning", ["CREATE TABLE t AS SELECT n_nationkey, n_name FROM nation", "DELETE FROM t WHERE n_nationkey < 5 RETURNING n_nationkey AS k, LOWER(n_name) AS gone"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, lower(n_name) AS gone FROM nation WHERE n_nationkey < 5")
_script("foreign_key_cascade", ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, k INTEGER REFERENCES p(k) ON DELETE CASCADE)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM p WHERE k >= 3", "SELECT id, k FROM c"],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS k FROM nation WHERE n_regionkey < 3")
_script("alter_table", ["CREATE TABLE t AS SELECT n_nationkey, n_name FROM nation", "ALTER TABLE t ADD COLUMN extra INTEGER DEFAULT 7", "ALTER TABLE t RENAME COLUMN n_name TO label", "ALTER TABLE t DROP COLUMN n_nationkey", "ALTER TABLE t RENAME TO u", "SELECT label, extra FROM u"],
        "SELECT n_name AS label, CAST(7 AS BIGINT) AS extra FROM nation")
_script("transaction_rollback", ["CREATE TABLE t AS SELECT n_nationkey FROM nation", "BEGIN", "DELETE FROM t WHERE n_nationkey < 20", "SAVEPOINT s", "TRUNCATE TABLE t", "ROLLBACK TO s", "COMMIT", "SELECT n_nationkey FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey >= 20")
_script("procedure_call", ["CREATE PROCEDURE top_nation(IN lim INTEGER) BEGIN SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < lim; END", "CALL top_nation(4)"],
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 4")


@_frame("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Beyond the dialect: the windowed count of a stream, here over the whole table."""
    (events,) = _t(spark, sf_dir, "events")
    out = streams.tumbling(events.withColumn("ts", F.col("ts").cast("string")), "ts", "1 day", ["event_type"], "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# statements whose effects are compared

_N = "CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)"
_FILL = "INSERT INTO t SELECT n_nationkey, n_name FROM nation"
_script("upsert_same_key", ["CREATE TABLE t (k INTEGER PRIMARY KEY, n INTEGER)", "INSERT INTO t VALUES (3, 100)", "INSERT INTO t SELECT s_nationkey, s_suppkey FROM supplier ON CONFLICT (k) DO UPDATE SET n = t.n + excluded.n", "SELECT k, n FROM t"],
        "SELECT CAST(k AS BIGINT) AS k, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT s_nationkey AS k, s_suppkey AS n FROM supplier UNION ALL SELECT 3, 100) GROUP BY k")
_script("duplicate_key_update", ["CREATE TABLE t (k INTEGER PRIMARY KEY, n INTEGER)", "INSERT INTO t VALUES (1, 1), (1, 2), (2, 5), (1, 10) ON DUPLICATE KEY UPDATE n = n * 2 + VALUES(n)", "SELECT k, n FROM t"],
        "SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n FROM (VALUES (1, 18), (2, 5)) AS x(k, n)")
_script("rename_keeps_foreign_keys", ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, k INTEGER REFERENCES p(k) ON DELETE CASCADE)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation",
        "ALTER TABLE p RENAME TO q", "ALTER TABLE q RENAME COLUMN k TO rk", "DELETE FROM q WHERE rk >= 3", "SELECT id, k FROM c"],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS k FROM nation WHERE n_regionkey < 3")
_script("rename_column_keeps_check", ["CREATE TABLE t (k INTEGER PRIMARY KEY, n INTEGER CHECK (n >= 0))", "ALTER TABLE t RENAME COLUMN n TO m", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation", "SELECT k, m FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS m FROM nation")
_script("before_trigger", ["CREATE TABLE t (k INTEGER)", "CREATE TABLE log (at TEXT, n INTEGER)", "CREATE TRIGGER b BEFORE INSERT ON t FOR EACH ROW BEGIN INSERT INTO log SELECT 'before', COUNT(*) FROM t; END",
        "CREATE TRIGGER a AFTER INSERT ON t FOR EACH ROW BEGIN INSERT INTO log SELECT 'after', COUNT(*) FROM t; END", "INSERT INTO t SELECT r_regionkey FROM region", "SELECT at, n, COUNT(*) AS c FROM log GROUP BY at, n"],
        "SELECT x AS at, CAST(CASE x WHEN 'after' THEN COUNT(*) ELSE 0 END AS BIGINT) AS n, COUNT(*) AS c FROM region, (VALUES ('before'), ('after')) AS y(x) GROUP BY x")
_script("after_trigger_row_values", ["CREATE TABLE t (k INTEGER PRIMARY KEY, n INTEGER)", "CREATE TABLE log (k INTEGER, d INTEGER)", "CREATE TRIGGER u AFTER UPDATE ON t WHEN (NEW.n > OLD.n) BEGIN INSERT INTO log VALUES (NEW.k, NEW.n - OLD.n); END", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation",
        "UPDATE t SET n = CASE WHEN k % 2 = 0 THEN n + k ELSE n - 1 END", "SELECT k, d FROM log"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS d FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey > 0")
_script("instead_of_trigger", [_N, "CREATE VIEW low AS SELECT k, LOWER(v) AS name FROM t", "CREATE TRIGGER i INSTEAD OF INSERT ON low BEGIN INSERT INTO t VALUES (NEW.k, UPPER(NEW.name)); END", "INSERT INTO low SELECT r_regionkey, r_name FROM region", "SELECT k, v FROM t"],
        "SELECT CAST(r_regionkey AS BIGINT) AS k, upper(r_name) AS v FROM region")
_script("truncate_table", [_N, _FILL, "TRUNCATE TABLE t", "INSERT INTO t VALUES (1, 'one')", "SELECT k, v FROM t"], "SELECT CAST(1 AS BIGINT) AS k, 'one' AS v")
_script("drop_and_create_again", [_N, _FILL, "DROP TABLE t", "DROP TABLE IF EXISTS t", "CREATE TABLE IF NOT EXISTS t (k INTEGER)", "INSERT INTO t SELECT r_regionkey FROM region", "SELECT k FROM t"], "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region")
_script("foreign_key_set_null", ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, k INTEGER REFERENCES p(k) ON DELETE SET NULL)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM p WHERE k = 2", "SELECT id, k FROM c"],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(NULLIF(n_regionkey, 2) AS BIGINT) AS k FROM nation")
_script("foreign_key_set_default", ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, k INTEGER DEFAULT 0 REFERENCES p(k) ON DELETE SET DEFAULT)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM p WHERE k = 2", "SELECT id, k FROM c"],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(CASE n_regionkey WHEN 2 THEN 0 ELSE n_regionkey END AS BIGINT) AS k FROM nation")
_script("foreign_key_update_cascade", ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, k INTEGER REFERENCES p(k) ON UPDATE CASCADE)", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "UPDATE p SET k = k + 100 WHERE k > 2", "SELECT id, k FROM c"],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(CASE WHEN n_regionkey > 2 THEN n_regionkey + 100 ELSE n_regionkey END AS BIGINT) AS k FROM nation")
_script("add_and_drop_constraint", [_N, "ALTER TABLE t ADD CONSTRAINT short CHECK (LENGTH(v) < 3)", "ALTER TABLE t DROP CONSTRAINT short", "ALTER TABLE t ADD CONSTRAINT u UNIQUE (v)", _FILL, "INSERT OR IGNORE INTO t SELECT n_nationkey + 100, n_name FROM nation", "SELECT k, v FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation")
_script("unique_index_conflict", ["CREATE TABLE t (k INTEGER, v TEXT)", "CREATE UNIQUE INDEX u ON t (v)", _FILL, "INSERT OR REPLACE INTO t SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0", "DROP INDEX u", "SELECT k, v FROM t"],
        "SELECT CAST(CASE n_regionkey WHEN 0 THEN n_nationkey + 100 ELSE n_nationkey END AS BIGINT) AS k, n_name AS v FROM nation")
_script("partitioned_table", ["CREATE TABLE t (k INTEGER, size INTEGER) PARTITION BY RANGE(size) (PARTITION small VALUES LESS THAN (10), PARTITION middle VALUES LESS THAN (30), PARTITION big VALUES LESS THAN MAXVALUE)", "INSERT INTO t SELECT p_partkey, p_size FROM part",
        "UPDATE t SET size = 40 WHERE size = 7", "DELETE FROM t WHERE size = 12", "SELECT k, size FROM t WHERE size = 40 OR size < 15"],
        "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(s AS BIGINT) AS size FROM (SELECT p_partkey, CASE p_size WHEN 7 THEN 40 ELSE p_size END AS s FROM part WHERE p_size <> 12) WHERE s = 40 OR s < 15")
_script("hash_partitioned_lookup", ["CREATE TABLE t (k INTEGER, v TEXT) PARTITION BY HASH(k) PARTITIONS 4", "INSERT INTO t SELECT c_custkey, c_name FROM customer", "SELECT k, v FROM t WHERE k = 7"], "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey = 7")
_script("vacuum_keeps_rows", [_N, _FILL, "DELETE FROM t WHERE k < 10", "UPDATE t SET v = LOWER(v) WHERE k > 20", "VACUUM t", "SELECT k, v FROM t"], "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey > 20 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey >= 10")
_script("time_travel_before_delete", ["CREATE TABLE t AS SELECT n_nationkey AS k FROM nation", "DELETE FROM t WHERE k < 10", "SELECT (SELECT COUNT(*) FROM t) AS now_rows, COUNT(*) AS all_rows FROM t AS OF 'now'"],
        "SELECT COUNT(*) FILTER (WHERE n_nationkey >= 10) AS now_rows, COUNT(*) FILTER (WHERE n_nationkey >= 10) AS all_rows FROM nation")
_script("collection_documents", ["CREATE COLLECTION c", "INSERT INTO c (data) SELECT JSON_OBJECT('name', n_name, 'region', n_regionkey) FROM nation", "SELECT JSON_EXTRACT(data, '$.name') AS name, CAST(JSON_EXTRACT(data, '$.region') AS INTEGER) AS region FROM c WHERE JSON_EXTRACT(data, '$.region') = '1'"],
        "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey = 1")
_script("procedure_out", ["CREATE PROCEDURE p (IN least INTEGER, OUT n INTEGER) BEGIN SET n = (SELECT COUNT(*) FROM nation WHERE n_nationkey >= least); END", "CALL p(10)"], "SELECT CAST(COUNT(*) AS INTEGER) AS n FROM nation WHERE n_nationkey >= 10")
_script("policy_on_update", ["CREATE TABLE t AS SELECT c_custkey AS k, c_nationkey AS n FROM customer", "CREATE POLICY a ON t FOR ALL USING (n = 3)", "ALTER TABLE t ENABLE ROW LEVEL SECURITY", "UPDATE t SET k = k + 1000000", "ALTER TABLE t DISABLE ROW LEVEL SECURITY", "SELECT k FROM t"],
        "SELECT CASE c_nationkey WHEN 3 THEN c_custkey + 1000000 ELSE c_custkey END AS k FROM customer", user="ann")
_script("savepoint_release", [_N, "BEGIN", _FILL, "SAVEPOINT a", "DELETE FROM t WHERE k < 5", "RELEASE SAVEPOINT a", "COMMIT", "SELECT k FROM t"], "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey >= 5")


def _refused(spark: SparkSession, sf_dir: str, statements: list[str], tried: list[str]) -> DataFrame:
    """Of the statements tried which ones the engine refuses."""
    engine = Engine(spark, sf_dir)
    for s in statements:
        engine.sql(s)
    rows = []
    for i, s in enumerate(tried):
        try:
            engine.sql(s)
            rows.append((i, False))
        except ValueError:
            rows.append((i, True))
    return spark.createDataFrame(rows, "place long, refused boolean")


@_frame("SELECT * FROM (VALUES (0::BIGINT, true), (1::BIGINT, true), (2::BIGINT, true), (3::BIGINT, true), (4::BIGINT, true), (5::BIGINT, false), (6::BIGINT, true), (7::BIGINT, true), (8::BIGINT, true)) AS x(place, refused)")
def refused_statements(spark, sf_dir):
    """NOT NULL, UNIQUE, CHECK, PRIMARY KEY, FOREIGN KEY, RESTRICT, a second BEGIN, MERGE."""
    made = ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "CREATE TABLE c (k INTEGER REFERENCES p(k) ON DELETE RESTRICT, v TEXT NOT NULL UNIQUE, n INTEGER CHECK (n > 0))", "INSERT INTO p SELECT r_regionkey FROM region", "INSERT INTO c SELECT n_regionkey, n_name, n_nationkey + 1 FROM nation"]
    tried = ["INSERT INTO c VALUES (1, NULL, 1)", "INSERT INTO c SELECT 1, n_name, 1 FROM nation", "UPDATE c SET n = 0", "INSERT INTO p VALUES (1)", "INSERT INTO c VALUES (77, 'new', 1)", "BEGIN", "BEGIN", "DELETE FROM p WHERE k = 1", "MERGE INTO c USING p ON c.k = p.k WHEN MATCHED THEN DELETE"]
    return _refused(spark, sf_dir, made, tried)


@_frame("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation WHERE n_nationkey > 20")
def foreign_csv(spark, sf_dir):
    """A foreign table over CSV files with a header; the filter is pushed to the reader."""
    path = new_path(spark, "csv")
    parquet.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).write.option("header", "true").csv(path)
    engine = Engine(spark, sf_dir)
    engine.sql(f"CREATE FOREIGN TABLE f (k INTEGER, v TEXT) WRAPPER 'csv' OPTIONS (file '{path}')")
    return engine.sql("SELECT k, v FROM f WHERE k > 20")


@_frame("SELECT doc_id FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' license ')")
def fulltext_index(spark, sf_dir):
    """CREATE FULLTEXT INDEX writes postings, which a search reads."""
    engine = Engine(spark, sf_dir)
    engine.sql("CREATE FULLTEXT INDEX f ON documents (text)")
    return engine.search_text("f", "License").select("doc_id").distinct()


@_frame("""SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 6 HOUR AS session_end, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Beyond the dialect: runs of a user's events without a pause of six hours."""
    (events,) = _t(spark, sf_dir, "events")
    out = streams.sessions(events.withColumn("ts", F.col("ts").cast("string")), "ts", "6 hours", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@_frame("SELECT column_name, n FROM (VALUES ('n_nationkey', 25::BIGINT), ('n_name', 25::BIGINT), ('n_regionkey', 25::BIGINT)) AS x(column_name, n)")
def analyze_columns(spark, sf_dir):
    found = Engine(spark, sf_dir)
    found.sql("SELECT * FROM nation")
    return found.sql("ANALYZE TABLE nation").select("column_name", F.col("row_count").cast("long").alias("n"))


_dialect("functions_text_more", "SELECT n_nationkey, UNICODE(n_name) AS u, LENGTH(LPAD(n_name, 15, 'é')) AS pl, PRINTF('%d of %s: %f', n_nationkey + 0.7, n_name, n_regionkey) AS p, n_name REGEXP '[[:digit:]]{2}$' AS d, REGEXP_REPLACE(n_name, '(?P<a>[0-9])', '<$1>') AS r FROM nation",
         "SELECT n_nationkey, CAST(unicode(n_name) AS BIGINT) AS u, CAST(15 AS BIGINT) AS pl, printf('%d of %s: %f', n_nationkey, n_name, CAST(n_regionkey AS DOUBLE)) AS p, regexp_matches(n_name, '[0-9]{2}$') AS d, regexp_replace(n_name, '([0-9])', '<\\1>', 'g') AS r FROM nation")
_dialect("functions_math_more", "SELECT c_custkey, SQUARE(c_nationkey) AS s, CUBE(c_nationkey) AS c, ABS_VAL(c_acctbal) AS a, POWER_INT(2, c_nationkey) AS p, FLOOR(c_acctbal * 1e300) AS f, TRUNCATE(c_acctbal, 1) AS t, ROUND(TAN(c_nationkey), 9) AS tn, ROUND(ATAN(c_acctbal), 9) AS at, ROUND(ASIN(c_nationkey / 30), 9) AS si, MAX(c_nationkey, 7) AS mx, (c_nationkey > 5) + 1 AS tr, 1 < c_nationkey < 2 AS ch, c_nationkey << -1 AS sh FROM customer",
         "SELECT c_custkey, CAST(c_nationkey * c_nationkey AS INTEGER) AS s, CAST(c_nationkey * c_nationkey * c_nationkey AS INTEGER) AS c, abs(c_acctbal) AS a, CAST(2 ** c_nationkey AS BIGINT) AS p, floor(c_acctbal * 1e300) AS f, sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10 AS t, round(tan(c_nationkey), 9) AS tn, round(atan(c_acctbal), 9) AS at, round(asin(c_nationkey / 30), 9) AS si, greatest(c_nationkey, 7) AS mx, CAST(c_nationkey > 5 AS INTEGER) + 1 AS tr, CAST(c_nationkey > 1 AS INTEGER) < 2 AS ch, CAST(NULL AS BIGINT) AS sh FROM customer")
_dialect("functions_json_more", "SELECT event_id, '' || JSON_KEYS(props) AS k, JSON_OBJECT(event_type, value, 'user', user_id) ->> '$.user' AS u, JSON_SET(props, '$.t', event_type) ->> '$.t' AS t, JSON_VALID(JSON_PRETTY(props)) AS v, JSON_MINIFY(JSON_PRETTY(props)) = JSON_MINIFY(props) AS m FROM events",
         "SELECT event_id, '[k]' AS k, CAST(user_id AS VARCHAR) AS u, event_type AS t, true AS v, true AS m FROM events")
_dialect("functions_datetime_more", "SELECT o_orderkey, DATE(REPLACE(DATE(o_orderdate), '-', '/')) AS d, HOUR('10:20:30') AS h, MINUTE('10:20') AS m, YEAR('2024-05') AS y, STRFTIME('%Y-%j', o_orderdate) AS f FROM orders",
         "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(10 AS BIGINT) AS h, CAST(20 AS BIGINT) AS m, CAST(2024 AS BIGINT) AS y, strftime(o_orderdate, '%Y-%j') AS f FROM orders")
_dialect("functions_session", "SELECT n_nationkey, VERSION() AS v, @@autocommit AS a, DATABASE() AS d, ZEROBLOB(0) AS z, IS_TRUE(n_regionkey) AS t, IS_FALSE(n_regionkey) AS f, IS_UNKNOWN(NULLIF(n_regionkey, 1)) AS u FROM nation",
         "SELECT n_nationkey, '8.0.0' AS v, 1 AS a, 'main' AS d, '' AS z, n_regionkey <> 0 AS t, n_regionkey = 0 AS f, n_regionkey = 1 AS u FROM nation")
_dialect("recursive_union_two_bases", "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT n_nationkey FROM nation WHERE n_nationkey = 4 UNION SELECT (r.k * 2) % 25 FROM r) SELECT k FROM r",
         "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey IN (3, 4) UNION SELECT (r.k * 2) % 25 FROM r) SELECT k FROM r")
_dialect("set_operations_in_cte", "WITH u AS (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) SELECT k, COUNT(*) AS n FROM u GROUP BY k",
         "SELECT k, LEAST(a, b) AS n FROM (SELECT c_nationkey AS k, COUNT(*) AS a FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, COUNT(*) AS b FROM supplier GROUP BY 1) USING (k)")
_dialect("order_by_window", "SELECT n_name, n_regionkey AS r FROM nation ORDER BY ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC), r LIMIT 12",
         "SELECT n_name, r FROM (SELECT n_name, n_regionkey AS r, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS o FROM nation) ORDER BY o, r LIMIT 12")
_dialect("order_by_subquery", "SELECT c_custkey FROM customer ORDER BY (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 15",
         "SELECT c_custkey FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY n DESC, c_custkey LIMIT 15")
_dialect("table_hints_and_locks", "SELECT n_nationkey FROM nation USE INDEX (a, b) WHERE n_regionkey = 2 FOR UPDATE", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["flagship_revenue_by_nation"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
