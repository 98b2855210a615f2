"""Registered queries that build a database, change it, and return what it then holds, each beside its SQL.

A database lies in a folder of its own below ``spark.checkpoint.dir``, which all executors reach.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.engine import Engine
from docquill.errors import DocquillError, TransactionConflict, UniqueViolation
from docquill.operators.pipeline import aggregate

Build = Callable[[SparkSession, str, Engine], DataFrame]


def scratch(spark: SparkSession) -> Engine:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise DocquillError("set spark.checkpoint.dir to a folder that all executors reach")
        base = f"file://{tempfile.gettempdir()}/docquill"
    return Engine(spark, f"{base.rstrip('/')}/db-{uuid.uuid4().hex}")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _with(*tables: str) -> Callable[[Build], Build]:
    """Loads tables as collections of the same names first."""

    def wrap(build: Build) -> Build:
        def run(spark: SparkSession, d: str, db: Engine) -> DataFrame:
            for t in tables:
                db.append_df(t, _table(spark, d, t))
            return build(spark, d, db)

        return run

    return wrap


def _raises(kind: type[Exception], step: Callable[[], Any]) -> bool:
    try:
        step()
    except kind:
        return True
    return False


# --- writes ---------------------------------------------------------------------------------------


@_with("part")
def _insert(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.insert("part", {"p_partkey": -1, "p_brand": "new"})
    db.insert_many("part", [{"p_partkey": -2, "p_brand": "new"}, {"p_partkey": -3, "_id": 5}])
    return db.find_df("part").select("p_partkey", "p_brand", F.col("_version").alias("version"))


@_with("part")
def _insert_ids(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.insert_many("part", [{"p_partkey": -1}, {"p_partkey": -2}])
    ids = F.col("_id")
    return db.find_df("part").agg(F.count(ids).alias("n"), F.count_distinct(ids).alias("ids"), F.min(ids).alias("lo"), F.max(ids).alias("hi"))


def _sql_insert(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.sql("CREATE TABLE t (k INT, name TEXT, x DOUBLE)")
    db.sql("INSERT INTO t (k, name, x) VALUES (1, 'it''s', 1.5), (2, NULL, -2), (3, 'x', 0.5)")
    db.sql("INSERT INTO t (k, name) VALUES (4, 'y')")
    return db.sql_df("SELECT k, name, x FROM t WHERE name IS NULL OR k > 1")


@_with("part")
def _sql_update(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.sql("UPDATE part SET p_retailprice = p_retailprice * 1.5, p_type = 'T' WHERE p_brand = 'Brand#2' AND p_size > 10")
    return db.sql_df("SELECT p_partkey, p_retailprice, p_type FROM part")


@_with("orders")
def _sql_delete(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.sql("DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 1000")
    return db.sql_df("SELECT o_orderkey FROM orders")


def _sql_ddl(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    for text in ("CREATE TABLE a (x INT)", "CREATE TABLE b (x INT)", "CREATE TABLE c (x INT)", "CREATE INDEX i ON a (x)", "CREATE UNIQUE INDEX u ON b (x)", "CREATE INDEX xy ON b (x, y)", "DROP TABLE c"):
        db.sql(text)
    rows = [(t["table"], i["name"], i["unique"]) for t in db.sql("SHOW TABLES") for i in db.list_indexes(t["table"])]
    return spark.createDataFrame(rows, "name string, index_name string, is_unique boolean")


@_with("part")
def _update(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.update("part", {"p_size": {"$lt": 10}}, {"$inc": {"p_size": 100}, "$set": {"grade": "small"}})
    db.update("part", {"p_size": {"$gt": 105}}, {"$mul": {"p_size": 2}})
    return db.find_df("part").select("p_partkey", "p_size", "grade", F.col("_version").alias("version"))


@_with("nation")
def _one_row_writes(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    counts = [db.update_one("nation", {"n_regionkey": 1}, {"$set": {"seen": True}}), db.delete_one("nation", {"n_regionkey": 2}), db.delete("nation", {"n_regionkey": 99})]
    return spark.createDataFrame([(*counts, db.count("nation"), db.count("nation", {"seen": True}))], "updated int, deleted int, nothing int, n bigint, seen bigint")


@_with("customer")
def _unique_index(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.create_unique_index("customer", "c_custkey")
    again, inside = [{"c_custkey": 3}], [{"c_custkey": -1}, {"c_custkey": -1}]
    refused = [_raises(UniqueViolation, lambda docs=docs: db.insert_many("customer", docs)) for docs in (again, inside, [{"c_custkey": -1}], [{"c_name": "no key"}])]
    refused.append(_raises(UniqueViolation, lambda: db.update("customer", {"c_custkey": -1}, {"$set": {"c_custkey": 3}})))
    return spark.createDataFrame([(*refused, db.count("customer"))], "again boolean, inside boolean, fresh boolean, missing boolean, changed boolean, n bigint")


def _explicit_null(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.insert_many("n", [{"v": None}, {}, {"v": 3, "o": {}}, {"v": "x", "o": {"a": None}}, {"v": [1, None]}])
    tests = {"null": {"v": None}, "there": {"v": {"$exists": True}}, "missing": {"v": {"$exists": False}}, "not three": {"v": {"$ne": 3}}, "nested": {"o.a": None}, "above": {"v": {"$gt": 3}}}
    rows = [(name, ",".join(str(r["_id"]) for r in db.find("n", q, sort={"_id": 1}))) for name, q in tests.items()]
    return spark.createDataFrame(rows, "test string, ids string")


def _errors(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.insert("e", {"a": 1, "s": "x"})
    tests = {
        "operator": lambda: db.find("e", {"a": {"$size": 1}}), "direction": lambda: db.find("e", sort={"a": 2}), "stage": lambda: db.aggregate("e", [{"$nothing": 1}]),
        "accumulator": lambda: db.aggregate("e", [{"$group": {"_id": None, "x": {"$median": "$a"}}}]), "update": lambda: db.update("e", {}, {"$nothing": {"a": 1}}),
        "inc of text": lambda: db.update("e", {}, {"$inc": {"s": 1}}), "skip": lambda: db.find("e", skip=-1), "in": lambda: db.find("e", {"a": {"$in": 1}}),
        "collection": lambda: db.create_collection("e"), "index": lambda: db.drop_index("e", "none"), "procedure": lambda: db.call_procedure("none"), "fine": lambda: db.find("e"),
    }
    return spark.createDataFrame([(name, _raises(DocquillError, run)) for name, run in tests.items()], "test string, refused boolean")


# --- transactions, changes, administration --------------------------------------------------------


@_with("customer")
def _transaction(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    with db.transaction() as tx:
        tx.update("customer", {"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 10}})
        tx.update("customer", {"c_mktsegment": "MACHINERY"}, {"$inc": {"c_acctbal": -10}})
        tx.insert("log", {"note": "moved"})
    noted = db.count("log")
    return db.find_df("customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"), F.lit(noted).alias("noted"))


@_with("nation", "region")
def _rollback(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    tx = db.begin_tx()
    tx.delete("nation", {})
    tx.insert("region", {"r_regionkey": 99})
    tx.rollback()

    def broken() -> None:
        with db.transaction() as t:
            t.update("nation", {}, {"$set": {"n_name": "lost"}})
            t.update("region", {}, {"$push": {"r_name": "not an array"}})

    failed = _raises(DocquillError, broken)
    rows = db.find_df("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(db.find_df("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    return rows.withColumn("failed", F.lit(failed))


@_with("nation")
def _conflict(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    late, other = db.begin_tx(), db.begin_tx()
    late.update("nation", {"n_nationkey": 3}, {"$set": {"n_name": "late"}})
    other.update("nation", {"n_nationkey": 4}, {"$set": {"n_name": "other"}})
    db.update("nation", {"n_nationkey": 3}, {"$set": {"n_name": "first"}})
    refused, passed = _raises(TransactionConflict, late.commit), not _raises(TransactionConflict, other.commit)
    return db.find_df("nation").select("n_nationkey", "n_name", F.lit(refused).alias("refused"), F.lit(passed).alias("passed"))


def _written(db: Engine) -> None:
    db.update("orders", {"o_orderstatus": "P"}, {"$set": {"o_orderpriority": "none"}})
    db.delete("orders", {"o_orderstatus": "F"})


@_with("orders")
def _change_log(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    _written(db)
    log = db.changes("orders")
    return log.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("tokens"), F.min("token").alias("first"), F.count("document").alias("documents"))


@_with("orders")
def _watch(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    """Events of a stream over all collections, from before the load's last token on."""
    last = db.changes("orders").agg(F.max("token")).first()[0]
    stream, name = db.watch(None, {"orders": last - 1}), f"watched_{uuid.uuid4().hex}"
    db.insert("later", {"x": 1})
    _written(db)
    counts = stream.groupBy("collection", "operation").agg(F.count(F.lit(1)).alias("n"))  # the stream counts: the driver holds a row per kind of event
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{db.root}/_watch").start()
    query.processAllAvailable()
    query.stop()
    rows = [tuple(r) for r in spark.table(name).collect()]
    spark.catalog.dropTempView(name)
    return spark.createDataFrame(rows, "collection string, operation string, n bigint")


@_with("part")
def _compact(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.insert("part", {"p_partkey": -1, "p_size": 7})
    db.update("part", {"p_size": 7}, {"$set": {"p_size": 8}})
    kept = db.compact("part")["docs_kept"]
    return db.find_df("part").select("p_partkey", "p_size", F.lit(kept).cast("bigint").alias("kept"))


@_with("supplier")
def _backup(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.backup(f"{db.root}-copy")
    db.delete("supplier", {})
    again = Engine.restore(spark, f"{db.root}-copy", f"{db.root}-restored")
    left = db.count("supplier")
    return again.find_df("supplier").select("s_suppkey", "s_name", F.lit(left).cast("bigint").alias("left"))


_STEPS = [
    {"step": "find_one", "collection": "customer", "query": {"c_custkey": "$param.from"}, "as": "payer"},
    {"step": "if", "condition": {"$expr": {"$lt": ["$payer.c_acctbal", "$param.least"]}}, "then": [{"step": "abort", "message": "too little"}]},
    {"step": "update", "collection": "customer", "query": {"c_custkey": "$param.from"}, "update": {"$set": {"c_mktsegment": "PAYER"}}},
    {"step": "update", "collection": "customer", "query": {"c_custkey": "$param.to"}, "update": {"$inc": {"c_acctbal": 5}}},
    {"step": "return", "value": {"status": "ok"}},
]


@_with("customer")
def _procedure(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.create_procedure("pay", {"params": ["from", "to", "least"], "steps": _STEPS})
    status = db.call_procedure("pay", {"from": 1, "to": 2, "least": -1e9})["status"]
    aborted = _raises(DocquillError, lambda: db.call_procedure("pay", {"from": 3, "to": 4, "least": 1e9}))
    rows = db.find_df("customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("balance"))
    return rows.withColumn("status", F.lit(status)).withColumn("aborted", F.lit(aborted))


@_with("nation")
def _schedule(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.create_procedure("touch", {"steps": [{"step": "update", "collection": "nation", "query": {"n_nationkey": 1}, "update": {"$set": {"n_name": "touched"}}}]})
    db.create_procedure("fail", {"steps": [{"step": "abort", "message": "no"}]})
    db.create_schedule("often", "touch", every="5m")
    db.create_schedule("failing", "fail", cron="* * * * *")
    db.create_schedule("off", "touch", every="1s", enabled=False)
    db.scheduler().once()
    db.scheduler().once()
    name = db.find_one("nation", {"n_nationkey": 1})["n_name"]
    rows = [(s["name"], s["run_count"], s["last_status"], name) for s in db.list_schedules()]
    return spark.createDataFrame(rows, "name string, run_count int, last_status string, n_name string")


# --- objects and search ---------------------------------------------------------------------------


def _nation_texts(spark: SparkSession, d: str, db: Engine) -> None:
    rows = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()  # 25 nations at every scale
    for r in rows:
        body, kind = f"{r.n_name} lies in {r.r_name}, number k{r.n_nationkey}", ("text/plain", "text/html", "application/json")[r.n_nationkey % 3]
        data = {"text/plain": body, "text/html": f"<p>{body}</p>", "application/json": f'{{"a": ["{body}"], "n": 1}}'}[kind]
        db.put_object("even" if r.n_nationkey % 2 == 0 else "odd", f"dir/{r.n_nationkey:02d} file", data.encode(), kind, {"region": r.r_name})
    db.put_object("odd", "image", b"\x00", "image/png")


def _blob_search(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    _nation_texts(spark, d, db)
    return db.blobs.search("k3 k11 k4 nation lies lies", "odd", 8).select("bucket", "key", F.round("_score", 9).alias("score"))


def _blob_list(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    _nation_texts(spark, d, db)
    db.delete_object("odd", "dir/03 file")
    rows = [(o["bucket"], o["key"], o["size"], len(o["etag"]), o["metadata"].get("region")) for b in db.list_buckets() for o in db.list_objects(b, prefix="dir/0")]
    return spark.createDataFrame(rows, "bucket string, key string, size bigint, etag_digits int, region string")


@_with("documents")
def _text_search(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    """Stored postings, kept up by an update and a delete."""
    db.create_text_index("documents", ["text"])
    db.update("documents", {"lang": "de"}, {"$set": {"text": "tion under erin"}})
    db.delete("documents", {"lang": "es"})
    db.insert("documents", {"doc_id": -1, "text": "hand tion"})
    rows = db.text_search_df("documents", "Tion, hand THE tion erin").select(F.col("doc_id").alias("k"), F.round("_score", 9).alias("score"))
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("k"))


@_with("embeddings")
def _vector_search(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    db.create_vector_index("embeddings", "embedding", 64)
    vector = [round(((k * 37) % 19 - 9) / 10, 2) for k in range(64)]
    return spark.createDataFrame([(r["vec_id"], round(r["_distance"], 6)) for r in db.vector_search("embeddings", "embedding", vector, 10)], "vec_id bigint, distance double")


# --- pipelines over fields that differ by row -----------------------------------------------------


def _push_mixed(spark: SparkSession, d: str, db: Engine) -> DataFrame:
    """Values of several kinds, in an order that runs both ways."""
    v = F.when(F.col("p_size") > 25, F.to_json(F.struct("p_size"))).when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    df = _table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name", F.parse_json(v).alias("v"))
    group = {"_id": "$p_brand", "vs": {"$push": "$v"}, "a": {"$first": "$p_partkey"}, "z": {"$last": "$p_partkey"}}
    out = aggregate(df, [{"$sort": {"p_type": -1, "p_name": 1}}, {"$group": group}], key=("p_partkey",))
    return out.select("_id", "a", "z", F.array_join(F.transform("vs", lambda x: F.to_json(x)), ";").alias("vs"))


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 1 AND NOT list_contains(['in', 'the', 'of', 'and', 'to', 'a', 'is'], w))"


def _tf_idf(rows: str, words: list[str], limit: int | None, keys: str, where: str = "true") -> str:
    from docquill.functions.text import STOP

    rows = rows.replace("['in', 'the', 'of', 'and', 'to', 'a', 'is']", "[" + ", ".join(f"'{w}'" for w in STOP) + "]")
    terms = " UNION ALL ".join(f"SELECT '{w}' AS term" for w in words)
    return f"""
WITH d AS ({rows}), n AS (SELECT count(*) AS n FROM d WHERE len(t) > 0),
p AS (SELECT {keys}, term, count(*) AS tf, any_value(l) AS l FROM (SELECT {keys}, unnest(t) AS term, len(t) AS l FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS ({terms})
SELECT {keys}, round(sum(tf / l * (ln(n / df) + 1)), 9) AS score FROM q JOIN p USING (term) JOIN f USING (term), n WHERE {where} GROUP BY ALL ORDER BY score DESC, {keys}{f' LIMIT {limit}' if limit else ''}"""


_BODY = "n_name || ' lies in ' || r_name || ', number k' || n_nationkey"
_NATIONS = f"SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket, 'dir/' || lpad(n_nationkey::VARCHAR, 2, '0') || ' file' AS key, r_name, n_nationkey, {_BODY} AS body FROM nation JOIN region ON n_regionkey = r_regionkey"
_DOCS = f"""SELECT doc_id AS k, {_TOKENS.format("CASE WHEN lang = 'de' THEN 'tion under erin' ELSE coalesce(text, '') END")} AS t FROM documents WHERE lang IS NULL OR lang <> 'es'
UNION ALL SELECT -1, ['hand', 'tion']"""
_V = "[" + ", ".join(str(round(((k * 37) % 19 - 9) / 10, 2)) for k in range(64)) + "]::DOUBLE[]"

ALL: dict[str, tuple[Build, str | None]] = {
    "db_insert": (_insert, "SELECT p_partkey, p_brand, 1::BIGINT AS version FROM part UNION ALL VALUES (-1, 'new', 1), (-2, 'new', 1), (-3, NULL, 1)"),
    "db_insert_ids": (_insert_ids, "SELECT count(*) + 2 AS n, count(*) + 2 AS ids, 1::BIGINT AS lo, count(*) + 2 AS hi FROM part"),
    "db_sql_insert": (_sql_insert, "SELECT * FROM (VALUES (2, NULL, -2.0::DOUBLE), (3, 'x', 0.5), (4, 'y', NULL)) t(k, name, x)"),
    "db_sql_update": (_sql_update, "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' AND p_size > 10 THEN p_retailprice * 1.5 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_brand = 'Brand#2' AND p_size > 10 THEN 'T' ELSE p_type END AS p_type FROM part"),
    "db_sql_delete": (_sql_delete, "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000)"),
    "db_sql_ddl": (_sql_ddl, "SELECT * FROM (VALUES ('a', 'x', false), ('b', 'x', true), ('b', 'x_y', false)) t(name, index_name, is_unique)"),
    "db_update": (_update, "SELECT p_partkey, CASE WHEN p_size < 6 THEN p_size + 100 WHEN p_size < 10 THEN (p_size + 100) * 2 ELSE p_size END AS p_size, CASE WHEN p_size < 10 THEN 'small' END AS grade, CASE WHEN p_size < 6 THEN 2 WHEN p_size < 10 THEN 3 ELSE 1 END::BIGINT AS version FROM part"),
    "db_one_row_writes": (_one_row_writes, "SELECT 1 AS updated, 1 AS deleted, 0 AS nothing, count(*) - 1 AS n, 1::BIGINT AS seen FROM nation"),
    "db_unique_index": (_unique_index, "SELECT true AS again, true AS inside, false AS fresh, false AS missing, true AS changed, count(*) + 2 AS n FROM customer"),
    "db_explicit_null": (_explicit_null, "SELECT * FROM (VALUES ('null', '1'), ('there', '1,3,4,5'), ('missing', '2'), ('not three', '1,4,5'), ('nested', '4'), ('above', '4,5')) t(test, ids)"),
    "db_errors": (_errors, "SELECT unnest(['operator', 'direction', 'stage', 'accumulator', 'update', 'inc of text', 'skip', 'in', 'collection', 'index', 'procedure', 'fine']) AS test, test <> 'fine' AS refused"),
    "db_transaction": (_transaction, "SELECT c_custkey, round(c_acctbal + CASE c_mktsegment WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN -10 ELSE 0 END, 2) AS balance, 1 AS noted FROM customer"),
    "db_rollback": (_rollback, "SELECT n_nationkey AS k, n_name AS name, true AS failed FROM nation UNION ALL SELECT r_regionkey, r_name, true FROM region"),
    "db_conflict": (_conflict, "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'first' WHEN 4 THEN 'other' ELSE n_name END AS n_name, true AS refused, true AS passed FROM nation"),
    "db_change_log": (_change_log, """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders)
SELECT 'insert' AS operation, n, n AS tokens, 1::BIGINT AS first, n AS documents FROM c UNION ALL SELECT 'update', p, p, n + 1, 0 FROM c UNION ALL SELECT 'delete', f, f, n + p + 1, 0 FROM c"""),
    "db_watch": (_watch, """
SELECT 'orders' AS collection, 'insert' AS operation, 1::BIGINT AS n UNION ALL SELECT 'later', 'insert', 1
UNION ALL SELECT 'orders', 'update', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'orders', 'delete', count(*) FROM orders WHERE o_orderstatus = 'F'"""),
    "db_compact": (_compact, "SELECT p_partkey, CASE WHEN p_size = 7 THEN 8 ELSE p_size END AS p_size, (SELECT count(*) + 1 FROM part) AS kept FROM part UNION ALL SELECT -1, 8, count(*) + 1 FROM part"),
    "db_backup_restore": (_backup, 'SELECT s_suppkey, s_name, 0::BIGINT AS "left" FROM supplier'),
    "db_procedure": (_procedure, "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'PAYER' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN c_custkey = 2 THEN c_acctbal + 5 ELSE c_acctbal END, 2) AS balance, 'ok' AS status, true AS aborted FROM customer"),
    "db_schedule": (_schedule, "SELECT * FROM (VALUES ('often', 1, 'ok', 'touched'), ('failing', 1, 'error', 'touched'), ('off', 0, NULL, 'touched')) t(name, run_count, last_status, n_name)"),
    "db_blob_search": (_blob_search, _tf_idf(f"SELECT bucket, key, {_TOKENS.format('body')} AS t FROM ({_NATIONS})", ["k3", "k11", "k4", "nation", "lies", "lies"], 8, "bucket, key", "bucket = 'odd'")),
    "db_blob_list": (_blob_list, f"SELECT bucket, key, strlen(body) + [0, 7, 19][n_nationkey % 3 + 1] AS size, 8 AS etag_digits, r_name AS region FROM ({_NATIONS}) WHERE n_nationkey < 10 AND n_nationkey <> 3"),
    "db_text_search": (_text_search, _tf_idf(_DOCS, ["tion", "hand", "tion", "erin"], None, "k")),
    "db_vector_search": (_vector_search, f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], {_V}) AS x FROM embeddings) ORDER BY x, vec_id LIMIT 10"),
    "push_mixed": (_push_mixed, """
SELECT p_brand AS "_id", first(p_partkey ORDER BY p_type DESC, p_name, p_partkey) AS a, last(p_partkey ORDER BY p_type DESC, p_name, p_partkey) AS z,
  string_agg(CASE WHEN p_size > 25 THEN '{"p_size":' || p_size || '}' WHEN p_size > 10 THEN p_size::VARCHAR ELSE '"' || p_name || '"' END, ';' ORDER BY p_type DESC, p_name, p_partkey) AS vs
FROM part GROUP BY 1"""),
}


def query(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: build(spark, d, scratch(spark))
