"""The registered queries of the engine's operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions.text import STOP, tokens, without_tags
from docquill.operators.find import find
from docquill.operators.filters import match
from docquill.operators.pipeline import aggregate
from docquill.operators.search import search_index, text_index, text_search, vector_search
from docquill.operators.updates import delete_rows, update_rows
from docquill.plans import database_queries
from docquill.plans.sql import select

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _filter(name: str, on: str, query: dict[str, Any], columns: str, where: str) -> None:
    """A filter with a projection; both reach the scan."""
    _add(name, lambda spark, d: match(table(spark, d, on), query).select(*columns.split(", ")), f"SELECT {columns} FROM {on} WHERE {where}")


def _pipeline(name: str, on: str, stages: list[dict[str, Any]], sql: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return then(aggregate(table(spark, d, on), stages, lambda n: table(spark, d, n), KEYS[on]))

    _add(name, run, sql)


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return select(spark, text, lambda n: table(spark, d, n))

    _add(name, run, oracle or text)


def _rounded(*names: str, places: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*(F.round(c, places).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


def _flat_id(df: DataFrame) -> DataFrame:
    return df.select("_id.*", *(c for c in df.columns if c != "_id"))


# --- filters --------------------------------------------------------------------------------------

ORD, CUST, PART = "o_orderkey, o_orderstatus, o_totalprice", "c_custkey, c_mktsegment", "p_partkey, p_size"
_filter("filter_all", "orders", {}, ORD, "true")
_filter("filter_eq", "orders", {"o_orderstatus": "F"}, ORD, "o_orderstatus = 'F'")
_filter("filter_eq_number", "part", {"p_size": {"$eq": 15.0}}, PART, "p_size = 15")
_filter("filter_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, ORD, "o_orderstatus <> 'F'")
_filter("filter_gt", "part", {"p_size": {"$gt": 40}}, PART, "p_size > 40")
_filter("filter_gte", "part", {"p_size": {"$gte": 40}}, PART, "p_size >= 40")
_filter("filter_lt", "part", {"p_size": {"$lt": 10}}, PART, "p_size < 10")
_filter("filter_lte", "part", {"p_size": {"$lte": 10}}, PART, "p_size <= 10")
_filter("filter_range", "orders", {"o_totalprice": {"$gt": 1000, "$lte": 200000.5}}, ORD, "o_totalprice > 1000 AND o_totalprice <= 200000.5")
_filter("filter_in", "customer", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY", "BUILDING"]}}, CUST, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_in_mixed", "part", {"p_size": {"$in": [1, 7.0, "7", None]}}, PART, "p_size IN (1, 7)")
_filter("filter_in_empty", "part", {"p_size": {"$in": []}}, PART, "false")
_filter("filter_exists", "customer", {"c_acctbal": {"$exists": True}}, CUST, "c_acctbal IS NOT NULL")
_filter("filter_not_exists", "customer", {"nickname": {"$exists": False}}, CUST, "true")
_filter("filter_missing_field", "customer", {"nickname": {"$ne": "x"}}, CUST, "false")
_filter("filter_regex", "part", {"p_type": {"$regex": "^[E-L].*(GE|MY)$"}}, "p_partkey, p_type", "regexp_matches(p_type, '^[E-L].*(GE|MY)$')")
_filter("filter_regex_i", "customer", {"c_mktsegment": {"$regex": "build", "$options": "i"}}, CUST, "regexp_matches(c_mktsegment, 'build', 'i')")
_filter("filter_and", "orders", {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 50000}}]}, ORD, "o_orderstatus = 'O' AND o_totalprice < 50000")
_filter("filter_or", "orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gte": 300000}}]}, ORD, "o_orderstatus = 'P' OR o_totalprice >= 300000")
_filter(
    "filter_nested_and_or", "orders", {"o_orderdate": {"$lt": "1996-01-01"}, "$or": [{"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 100000}}]}, {"o_orderpriority": {"$regex": "^1"}}]},
    ORD, "o_orderdate < TIMESTAMP '1996-01-01' AND ((o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority LIKE '1%')",
)
_filter("filter_date_range", "orders", {"o_orderdate": {"$gte": "1995-01-01", "$lt": "1995-07-01T00:00:00Z"}}, ORD, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01'")
_filter("filter_cross_type_low", "part", {"p_size": {"$lt": "abc"}}, PART, "p_size IS NOT NULL")
_filter("filter_cross_type_high", "part", {"p_size": {"$gt": "abc"}}, PART, "false")
_filter("filter_cross_type_bool", "orders", {"o_orderdate": {"$gt": True}}, ORD, "o_orderdate IS NOT NULL")

# --- find, sort, limits ---------------------------------------------------------------------------


def _find(name: str, on: str, columns: str, sql: str, **options: Any) -> None:
    _add(name, lambda spark, d: find(table(spark, d, on), key=KEYS[on], **options).select(*columns.split(", ")), sql)


_find("find_sort_limit", "orders", ORD, f"SELECT {ORD} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", sort={"o_totalprice": -1}, limit=20)
_find("find_sort_multi", "part", "p_partkey, p_size, p_brand", "SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_brand NULLS FIRST, p_size DESC, p_partkey LIMIT 50", sort=[("p_brand", 1), ("p_size", -1)], limit=50)
_find("find_skip_limit", "part", PART, f"SELECT {PART} FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 15", sort={"p_size": 1}, skip=15, limit=10)
_find("find_skip", "supplier", "s_suppkey", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 7", skip=7)
_find("find_limit_zero", "part", PART, f"SELECT {PART} FROM part WHERE false", limit=0)
_find("find_filtered_top_k", "orders", ORD, f"SELECT {ORD} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 5", query={"o_orderstatus": "F"}, sort={"o_totalprice": 1}, limit=5)
_find("find_one", "customer", "c_custkey, c_name", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1", query={"c_mktsegment": "BUILDING"}, limit=1)
_add("point_get", lambda spark, d: match(table(spark, d, "orders"), {"o_orderkey": 7}).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
_pipeline("count_matching", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
_pipeline("count_empty", "orders", [{"$match": {"o_orderstatus": "nothing"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE false")

# --- groups ---------------------------------------------------------------------------------------

FLAG = '"_id"'
_pipeline("flagship", "lineitem", [{"$match": {"l_quantity": {"$gte": 10}}}, {"$group": {"_id": "$l_returnflag", "total": {"$sum": "$l_extendedprice"}}}, {"$sort": {"total": -1}}, {"$limit": 2}], 'SELECT l_returnflag AS "_id", round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 ORDER BY total DESC LIMIT 2', _rounded("total", places=2))
_pipeline("group_sum", "lineitem", [{"$group": {"_id": "$l_returnflag", "q": {"$sum": "$l_quantity"}}}], f"SELECT l_returnflag AS {FLAG}, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
_pipeline("group_sum_literal", "lineitem", [{"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}], f"SELECT l_returnflag AS {FLAG}, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1")
_pipeline("group_sum_text", "lineitem", [{"$group": {"_id": "$l_returnflag", "n": {"$sum": "$l_linestatus"}}}], f"SELECT l_returnflag AS {FLAG}, 0.0::DOUBLE AS n FROM lineitem GROUP BY 1")
_pipeline("group_avg", "lineitem", [{"$group": {"_id": "$l_linestatus", "a": {"$avg": "$l_discount"}}}], f"SELECT l_linestatus AS {FLAG}, round(avg(l_discount), 8) AS a FROM lineitem GROUP BY 1", _rounded("a", places=8))
_pipeline("group_avg_all_rows", "orders", [{"$group": {"_id": None, "a": {"$avg": "$o_totalprice"}, "n": {"$count": {}}}}], 'SELECT round(avg(o_totalprice), 4) AS a, count(*) AS n FROM orders', lambda df: _rounded("a")(df.drop("_id")))
_pipeline("group_min_max", "part", [{"$group": {"_id": "$p_brand", "lo": {"$min": "$p_retailprice"}, "hi": {"$max": "$p_name"}}}], f"SELECT p_brand AS {FLAG}, min(p_retailprice) AS lo, max(p_name) AS hi FROM part GROUP BY 1")
_pipeline("group_count", "events", [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}], f"SELECT event_type AS {FLAG}, count(*) AS n FROM events GROUP BY 1")
_pipeline("group_count_filtered", "events", [{"$match": {"value": {"$gt": 50}}}, {"$group": {"_id": "$event_type", "n": {"$count": {}}}}], f"SELECT event_type AS {FLAG}, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
_pipeline("group_first_last", "orders", [{"$sort": {"o_totalprice": 1}}, {"$group": {"_id": "$o_orderstatus", "a": {"$first": "$o_orderkey"}, "z": {"$last": "$o_orderkey"}}}], f"SELECT o_orderstatus AS {FLAG}, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS a, last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS z FROM orders GROUP BY 1")
_pipeline("group_first_desc", "part", [{"$sort": {"p_type": -1}}, {"$group": {"_id": "$p_brand", "a": {"$first": "$p_partkey"}}}], f"SELECT p_brand AS {FLAG}, first(p_partkey ORDER BY p_type DESC, p_partkey) AS a FROM part GROUP BY 1")
_pipeline("group_push", "nation", [{"$sort": {"n_name": 1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}], f"SELECT n_regionkey AS {FLAG}, string_agg(n_name, ',' ORDER BY n_name, n_nationkey) AS names FROM nation GROUP BY 1", lambda df: df.withColumn("names", F.array_join("names", ",")))
_pipeline("group_missing_key", "nation", [{"$group": {"_id": "$nothing", "n": {"$count": {}}}}], f"SELECT true AS {FLAG}, count(*) AS n FROM nation", lambda df: df.withColumn("_id", F.col("_id").isNull()))
_pipeline("group_compound_key", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "q": {"$sum": "$l_quantity"}}}], "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2", _flat_id)
_pipeline("group_expression_key", "lineitem", [{"$group": {"_id": {"$multiply": ["$l_linenumber", 10]}, "n": {"$count": {}}}}], f"SELECT (l_linenumber * 10)::DOUBLE AS {FLAG}, count(*) AS n FROM lineitem GROUP BY 1")
_pipeline("group_sum_expression", "lineitem", [{"$group": {"_id": "$l_returnflag", "revenue": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}}], f"SELECT l_returnflag AS {FLAG}, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1", _rounded("revenue", places=2))
_pipeline("group_empty_input", "orders", [{"$match": {"o_orderstatus": "nothing"}}, {"$group": {"_id": None, "n": {"$sum": "$o_totalprice"}}}], 'SELECT 0.0::DOUBLE AS n WHERE false', lambda df: df.drop("_id"))
_pipeline("group_distinct", "part", [{"$group": {"_id": "$p_brand"}}], f"SELECT DISTINCT p_brand AS {FLAG} FROM part")

# --- projection, unwinding, expressions -----------------------------------------------------------

_pipeline("project_include", "part", [{"$project": {"p_partkey": 1, "p_brand": True}}], "SELECT p_partkey, p_brand FROM part")
_pipeline("project_exclude", "nation", [{"$project": {"n_name": 0}}], "SELECT n_nationkey, n_regionkey FROM nation")
_pipeline("project_computed", "part", [{"$project": {"p_partkey": 1, "double_size": {"$multiply": ["$p_size", 2]}, "tag": "x"}}], "SELECT p_partkey, (p_size * 2)::DOUBLE AS double_size, 'x' AS tag FROM part")
_pipeline("add_fields", "part", [{"$addFields": {"a": {"$add": ["$p_size", 1]}, "b": {"$multiply": ["$a", 2]}}}, {"$project": {"p_partkey": 1, "a": 1, "b": 1}}], "SELECT p_partkey, (p_size + 1)::DOUBLE AS a, ((p_size + 1) * 2)::DOUBLE AS b FROM part")
_pipeline("add_fields_nested", "part", [{"$addFields": {"m.size": "$p_size", "m.brand": "$p_brand"}}, {"$match": {"m.size": {"$gt": 25}}}, {"$project": {"p_partkey": 1, "m.size": 1}}], 'SELECT p_partkey, p_size AS "m.size" FROM part WHERE p_size > 25')
_pipeline("arithmetic", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "x": {"$add": ["$l_tax", {"$subtract": ["$l_quantity", 3]}, {"$divide": ["$l_linenumber", 2]}]}}}], "SELECT l_orderkey, l_linenumber, round(l_tax + (l_quantity - 3) + l_linenumber / 2, 6) AS x FROM lineitem", _rounded("x", places=6))
_pipeline("arithmetic_not_a_number", "part", [{"$project": {"p_partkey": 1, "x": {"$add": ["$p_size", "$p_name"]}}}], "SELECT p_partkey, NULL::DOUBLE AS x FROM part")
_pipeline("divide_by_zero", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "x": {"$divide": ["$l_quantity", "$l_discount"]}}}], "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END, 6) AS x FROM lineitem", _rounded("x", places=6))


def _worded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"))


_add("unwind", lambda s, d: aggregate(_worded(s, d), [{"$unwind": "$words"}, {"$group": {"_id": "$doc_id", "n": {"$count": {}}}}]), f"SELECT doc_id AS {FLAG}, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) FROM documents) GROUP BY 1")
_add("unwind_group", lambda s, d: aggregate(_worded(s, d), [{"$unwind": "$words"}, {"$group": {"_id": "$words", "n": {"$count": {}}}}, {"$sort": {"n": -1}}, {"$limit": 30}]), f"SELECT w AS {FLAG}, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30")
_add(
    "unwind_preserve", lambda s, d: aggregate(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).when(F.col("p_size") % 3 == 1, F.array().cast("array<string>")).alias("tags")), [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}]),
    "SELECT p_partkey, unnest([p_brand, p_type]) AS tags FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 <> 0",
)
_pipeline("unwind_scalar", "nation", [{"$unwind": "$n_name"}, {"$project": {"n_nationkey": 1, "n_name": 1}}], "SELECT n_nationkey, n_name FROM nation")

# --- joins ----------------------------------------------------------------------------------------

_REGION = {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}
_ORDERS = {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}
_pipeline("lookup", "region", [{"$lookup": _REGION}], "SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2", lambda df: df.withColumn("nations", F.array_join("nations.n_name", ",")))
_pipeline("lookup_empty", "customer", [{"$lookup": _ORDERS}, {"$project": {"c_custkey": 1, "orders": 1}}], "SELECT c_custkey, count(o_orderkey)::INT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda df: df.select("c_custkey", F.size("orders").alias("n")))
_pipeline("lookup_unwind", "customer", [{"$lookup": _ORDERS}, {"$unwind": "$orders"}, {"$project": {"c_custkey": 1, "orders.o_orderkey": 1}}], 'SELECT c_custkey, o_orderkey AS "orders.o_orderkey" FROM customer JOIN orders ON o_custkey = c_custkey')
_pipeline("lookup_unwind_preserve", "customer", [{"$lookup": _ORDERS}, {"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}}, {"$group": {"_id": "$c_mktsegment", "spent": {"$sum": "$orders.o_totalprice"}, "n": {"$count": {}}}}], f"SELECT c_mktsegment AS {FLAG}, round(coalesce(sum(o_totalprice), 0), 2) AS spent, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", _rounded("spent", places=2))
_pipeline("lookup_absent_field", "region", [{"$lookup": {**_REGION, "localField": "nothing"}}, {"$addFields": {"x": 1}}], "SELECT r_regionkey, r_name, 0 AS n, 1 AS x FROM region", lambda df: df.withColumn("n", F.size("nations")).drop("nations"))
_pipeline("project_mode", "nation", [{"$project": {"n_name": 0, "n_nationkey": 1, "twice": {"$multiply": ["$n_regionkey", 2]}}}], "SELECT n_nationkey, (n_regionkey * 2)::DOUBLE AS twice FROM nation")
_pipeline("group_first_both_ways", "orders", [{"$sort": {"o_orderpriority": -1, "o_totalprice": 1}}, {"$group": {"_id": "$o_orderstatus", "a": {"$first": "$o_orderkey"}, "z": {"$last": "$o_orderkey"}}}], f"SELECT o_orderstatus AS {FLAG}, first(o_orderkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS a, last(o_orderkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS z FROM orders GROUP BY 1")
_pipeline("lookup_twice", "customer", [{"$lookup": {"from": "nation", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"}, {"$lookup": {"from": "region", "localField": "n.n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$group": {"_id": "$r.r_name", "balance": {"$sum": "$c_acctbal"}}}], f"SELECT r_name AS {FLAG}, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", _rounded("balance", places=2))

# --- SQL ------------------------------------------------------------------------------------------

_sql("sql_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice >= 150000")
_sql("sql_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A_G%'")
_sql("sql_between_in", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
_sql("sql_is_null", "SELECT count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL")
_sql("sql_order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 5")
_sql("sql_aggregates", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 8) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem")
_sql("sql_group_having", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING avg(l_quantity) > 25 ORDER BY l_suppkey")
_sql("sql_inner_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000")
_sql("sql_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
_sql("sql_right_join", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
_sql("sql_full_join", "SELECT n.n_name, s.s_suppkey FROM nation n FULL JOIN supplier s ON n.n_nationkey = s.s_nationkey")
_sql("sql_semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_sql("sql_anti_join", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 48", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
_sql("sql_three_way_join", "SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
_sql("sql_distinct_count", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
_sql("sql_with_subquery", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM (SELECT * FROM big WHERE s > 500000) t")
_sql("sql_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey AS k FROM customer")
_sql("sql_not_forms", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_size NOT BETWEEN 20 AND 30 AND p_type NOT LIKE 'S%' AND NOT (p_brand = 'Brand#2')")
_sql("sql_global_aggregate_empty", "SELECT count(*) AS n, sum(p_size) AS s, max(p_name) AS hi FROM part WHERE p_size < 0")
_sql("sql_intersect_except", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
_add("sql_unaliased_aggregates", lambda s, d: select(s, "SELECT sum(l_quantity), sum(l_linenumber), sum(l_quantity) FROM lineitem", lambda n: table(s, d, n)).toDF("a", "b", "c"), "SELECT sum(l_quantity) AS a, sum(l_linenumber)::BIGINT AS b, sum(l_quantity) AS c FROM lineitem")
_sql("sql_window", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", None)

# --- updates --------------------------------------------------------------------------------------


def _update(name: str, on: str, query: dict[str, Any], update: dict[str, Any], columns: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, then: Callable[[DataFrame], DataFrame] = lambda df: df, source: str | None = None) -> None:
    """columns: the result's columns and the SQL of each."""
    sql = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source or on}"
    _add(name, lambda s, d: then(update_rows(prepare(table(s, d, on)), query, update)).select(*columns), sql)


_C, _B = {"c_custkey": "c_custkey"}, "c_mktsegment = 'BUILDING'"
_update("update_set", "customer", {"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "HOUSES", "grade": 3}}, {**_C, "c_mktsegment": f"CASE WHEN {_B} THEN 'HOUSES' ELSE c_mktsegment END", "grade": f"CASE WHEN {_B} THEN 3 END"})
_update("update_unset", "customer", {"c_mktsegment": "BUILDING"}, {"$unset": {"c_acctbal": ""}}, {**_C, "c_acctbal": f"CASE WHEN {_B} THEN NULL ELSE c_acctbal END"})
_update("update_inc", "part", {"p_size": {"$lt": 10}}, {"$inc": {"p_size": 5}}, {"p_partkey": "p_partkey", "p_size": "CASE WHEN p_size < 10 THEN p_size + 5 ELSE p_size END"})
_update("update_mul", "part", {"p_size": {"$lt": 10}}, {"$mul": {"p_retailprice": 1.5}}, {"p_partkey": "p_partkey", "p_retailprice": "CASE WHEN p_size < 10 THEN p_retailprice * 1.5 ELSE p_retailprice END"})
_update("update_min", "part", {}, {"$min": {"p_size": 20}}, {"p_partkey": "p_partkey", "p_size": "least(p_size, 20)"})
_update("update_max", "part", {}, {"$max": {"p_size": 20}}, {"p_partkey": "p_partkey", "p_size": "greatest(p_size, 20)"})
_update("update_rename", "customer", {}, {"$rename": {"c_name": "full_name"}}, {**_C, "c_name": "NULL::VARCHAR", "full_name": "c_name"})
_update("update_current_date", "nation", {"n_nationkey": 3}, {"$currentDate": {"seen": True}}, {"n_nationkey": "n_nationkey", "seen": "n_nationkey = 3"}, then=lambda df: df.withColumn("seen", F.coalesce(F.abs(F.unix_millis(F.to_timestamp("seen")) - F.unix_millis(F.current_timestamp())) < 3_600_000, F.lit(False))))


def _tagged(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.array("p_brand", "p_type", F.lit("x"), "p_brand").alias("tags"))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ","))


_P, _T = {"p_partkey": "p_partkey"}, "p_brand || ',' || p_type || ',x,' || p_brand"
_update("update_push", "part", {"p_partkey": {"$lt": 50}}, {"$push": {"tags": "new"}}, {**_P, "tags": f"{_T} || CASE WHEN p_partkey < 50 THEN ',new' ELSE '' END"}, _tagged, _joined)
_update("update_pull", "part", {}, {"$pull": {"tags": "x"}}, {**_P, "tags": "p_brand || ',' || p_type || ',' || p_brand"}, _tagged, _joined)
_update("update_add_to_set", "part", {}, {"$addToSet": {"tags": "x"}}, {**_P, "tags": _T}, _tagged, _joined)
_update("update_add_to_set_new", "part", {}, {"$addToSet": {"tags": "y"}}, {**_P, "tags": f"{_T} || ',y'"}, _tagged, _joined)
_update("update_pop_last", "part", {}, {"$pop": {"tags": 1}}, {**_P, "tags": "p_brand || ',' || p_type || ',x'"}, _tagged, _joined)
_update("update_pop_first", "part", {}, {"$pop": {"tags": -1}}, {**_P, "tags": "p_type || ',x,' || p_brand"}, _tagged, _joined)
_update("update_several", "part", {"p_brand": "Brand#11"}, {"$inc": {"p_size": 1}, "$set": {"p_type": "T"}}, {**_P, "p_size": "CASE WHEN p_brand = 'Brand#11' THEN p_size + 1 ELSE p_size END", "p_type": "CASE WHEN p_brand = 'Brand#11' THEN 'T' ELSE p_type END"})
_add("delete_matching", lambda s, d: delete_rows(table(s, d, "orders"), {"o_orderstatus": "F"}).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'")

# --- search ---------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP) + "], w))"


def _tf_idf(rows: str, words: list[str], limit: int) -> str:
    terms = " UNION ALL ".join(f"SELECT '{w}' AS term" for w in words)
    return f"""
WITH d AS ({rows}), n AS (SELECT count(*) AS n FROM d WHERE len(t) > 0),
p AS (SELECT k, term, count(*) AS tf, any_value(l) AS l FROM (SELECT k, unnest(t) AS term, len(t) AS l FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS ({terms})
SELECT k, round(sum(tf / l * (ln(n / df) + 1)), 9) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY k ORDER BY score DESC, k LIMIT {limit}"""


def _scored(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.round("_score", 9).alias("score"))


_DOCS = f"SELECT doc_id AS k, {_TOKENS.format('text')} AS t FROM documents"
_add("text_search", lambda s, d: _scored(text_search(table(s, d, "documents"), ["text"], "erin", 10, ("doc_id",)), "doc_id"), _tf_idf(_DOCS, ["erin"], 10))
_add("text_search_multi", lambda s, d: _scored(text_search(table(s, d, "documents"), ["text"], "Tion, hand THE tion under erin", 20, ("doc_id",)), "doc_id"), _tf_idf(_DOCS, ["tion", "hand", "tion", "under", "erin"], 20))


def _indexed_search(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    n = docs.where(F.size(tokens(F.col("text"))) > 0).count()
    return _scored(search_index(text_index(docs, ["text"], ["doc_id"]), n, "mentation une tion", 15, ("doc_id",)), "doc_id")


_add("text_search_index", _indexed_search, _tf_idf(_DOCS, ["mentation", "une", "tion"], 15))
_PAGES = "SELECT page_id AS k, " + _TOKENS.format("regexp_replace(html, '<[^>]*>', ' ', 'g')") + " AS t FROM pages"
_add(
    "blob_search", lambda s, d: _scored(text_search(table(s, d, "pages").select("page_id", without_tags(F.col("html")).alias("text")), ["text"], "nicht erin tion", 10, ("page_id",)), "page_id"),
    _tf_idf(_PAGES, ["nicht", "erin", "tion"], 10),
)
_add("extract_html", lambda s, d: table(s, d, "pages").select("page_id", F.size(tokens(without_tags(F.col("html")))).alias("n")), f"SELECT k AS page_id, len(t)::INT AS n FROM ({_PAGES})")

_VECTOR = [round(((k * 37) % 19 - 9) / 10, 2) for k in range(64)]
_V = "[" + ", ".join(map(str, _VECTOR)) + "]::DOUBLE[]"
for _metric, _distance, _similarity in (
    ("cosine", f"list_cosine_distance(embedding::DOUBLE[], {_V})", "1 - x / 2"),
    ("euclidean", f"list_distance(embedding::DOUBLE[], {_V})", "1 / (1 + x)"),
    ("dot_product", f"-list_inner_product(embedding::DOUBLE[], {_V})", "1 / (1 + exp(x))"),
):
    _add(
        f"vector_{_metric}",
        lambda s, d, m=_metric: vector_search(table(s, d, "embeddings"), "embedding", _VECTOR, 10, m, ("vec_id",)).select("vec_id", F.round("_distance", 6).alias("distance"), F.round("_similarity", 6).alias("similarity")),
        f"SELECT vec_id, round(x, 6) AS distance, round({_similarity}, 6) AS similarity FROM (SELECT vec_id, {_distance} AS x FROM embeddings) ORDER BY x, vec_id LIMIT 10",
    )

# --- mixed documents ------------------------------------------------------------------------------


def _props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "event_type", F.parse_json("props").alias("doc"))


_K = "(props->>'k')::BIGINT"
_add("variant_filter", lambda s, d: match(_props(s, d), {"doc.k": {"$gte": 50}}).select("event_id"), f"SELECT event_id FROM events WHERE {_K} >= 50")
_add("variant_cross_type", lambda s, d: match(_props(s, d), {"doc.k": {"$lt": "a"}}).select("event_id"), f"SELECT event_id FROM events WHERE {_K} IS NOT NULL")
_add("variant_sort", lambda s, d: find(_props(s, d), sort={"doc.k": -1}, limit=25, key=("event_id",)).select("event_id"), f"SELECT event_id FROM events ORDER BY {_K} DESC NULLS LAST, event_id LIMIT 25")
_add(
    "variant_group", lambda s, d: aggregate(_props(s, d), [{"$group": {"_id": "$event_type", "total": {"$sum": "$doc.k"}, "hi": {"$max": "$doc.k"}}}], key=("event_id",)).withColumn("hi", F.try_variant_get("hi", "$", "bigint")),
    f"SELECT event_type AS {FLAG}, sum({_K})::DOUBLE AS total, max({_K}) AS hi FROM events GROUP BY 1",
)

# --- databases ------------------------------------------------------------------------------------

for _name, (_build, _oracle) in database_queries.ALL.items():
    _add(_name, database_queries.query(_build), _oracle)
_filter("filter_scan", "lineitem", {"l_shipdate": {"$gte": "1995-03-01", "$lt": "1995-03-08"}}, "l_orderkey, l_linenumber", "l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-03-08'")
_pipeline("filter_regex_scan", "lineitem", [{"$match": {"l_returnflag": {"$regex": "^[AN]$"}, "l_linestatus": {"$regex": "o", "$options": "i"}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE regexp_matches(l_returnflag, '^[AN]$') AND regexp_matches(l_linestatus, 'o', 'i')")
