import math

import pytest

from docquill.errors import InvalidQuery, InvalidUpdate
from docquill.functions.text import tokens
from docquill.operators.search import search_index, text_index, text_search, vector_search
from docquill.operators.updates import apply_update, delete_rows, update_rows
from pyspark.sql import functions as F


def one(spark, update, row=(1, 5, "a", ["x", None, "y", "x"]), schema="_id bigint, n bigint, s string, tags array<string>"):
    return apply_update(spark.createDataFrame([row], schema), update).first().asDict(True)


def test_updates(spark):
    assert one(spark, {"$set": {"s": "b", "deep.er": 1}})["deep"] == {"er": 1}
    assert one(spark, {"$unset": {"n": ""}})["n"] is None
    assert one(spark, {"$inc": {"n": 2, "m": 3}})["m"] == 3
    assert one(spark, {"$mul": {"n": 3, "m": 3}})["m"] == 0
    assert one(spark, {"$min": {"n": 3}})["n"] == 3 and one(spark, {"$max": {"n": 3}})["n"] == 5
    got = one(spark, {"$rename": {"s": "t"}})
    assert got["t"] == "a" and got["s"] is None
    assert one(spark, {"$currentDate": {"at": True}})["at"].endswith("Z")
    assert one(spark, {"$push": {"tags": "z"}})["tags"][-1] == "z"
    assert one(spark, {"$pull": {"tags": "x"}})["tags"] == [None, "y"]
    assert one(spark, {"$pull": {"tags": None}})["tags"] == ["x", "y", "x"]
    assert one(spark, {"$addToSet": {"tags": "x"}})["tags"] == ["x", None, "y", "x"]
    assert one(spark, {"$addToSet": {"tags": "q"}})["tags"][-1] == "q"
    assert one(spark, {"$pop": {"tags": 1}})["tags"] == ["x", None, "y"] and one(spark, {"$pop": {"tags": -1}})["tags"] == [None, "y", "x"]
    assert one(spark, {"$push": {"new": 1}})["new"] == [1]


@pytest.mark.parametrize("update", [{"$inc": {"s": 1}}, {"$push": {"n": 1}}, {"$pop": {"tags": 2}}, {"$what": {"n": 1}}, {"n": 1}, {}, {"$inc": {"n": "1"}}])
def test_bad_updates(spark, update):
    with pytest.raises(InvalidUpdate):
        one(spark, update)


def test_rows(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 1, None)], "_id bigint, _version bigint, n bigint")
    got = {r._id: (r._version, r.n) for r in update_rows(df, {"n": {"$gt": 5}}, {"$inc": {"n": 1}}).collect()}
    assert got == {1: (1, 5), 2: (2, 7), 3: (1, None)}
    assert [r._id for r in delete_rows(df, {"n": 5}).collect()] == [2, 3]


def test_text_search(spark):
    df = spark.createDataFrame([(1, "The quick fox", ["red"]), (2, "quick quick dog", []), (3, "", None)], "_id bigint, title string, tags array<string>")
    got = [(r._id, r._score) for r in text_search(df, ["title", "tags"], "quick red quick").collect()]
    idf, rare = math.log(2 / 2) + 1, math.log(2 / 1) + 1
    assert [i for i, _ in got] == [2, 1]
    assert got[0][1] == pytest.approx(2 * idf * 2 / 3) and got[1][1] == pytest.approx(2 * idf / 3 + rare / 3)
    again = [(r._id, r._score) for r in search_index(text_index(df, ["title", "tags"], ["_id"]), 2, "quick red quick").collect()]
    assert [i for i, _ in again] == [2, 1]
    assert spark.range(1).select(tokens(F.lit("É a B2 the x é-ü")).alias("t")).first().t == ["é", "b2", "é", "ü"]


def test_vector_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "_id bigint, e array<double>")
    got = [(r._id, round(r._distance, 6), round(r._similarity, 6)) for r in vector_search(df, "e", [1.0, 0.0], 5).collect()]
    assert got == [(1, 0.0, 1.0), (2, 1.0, 0.5), (3, 1.0, 0.5)]
    assert [r._id for r in vector_search(df, "e", [1.0, 0.0], 1, "euclidean").collect()] == [1]
    assert vector_search(df, "e", [1.0, 0.0], 1, "dot_product").first()._distance == -1.0
    with pytest.raises(InvalidQuery):
        vector_search(df, "e", [1.0], 1, dimension=2)
