import pytest
from pyspark.sql import functions as F

from docquill.errors import InvalidQuery
from docquill.operators.pipeline import aggregate

ORDERS = [(1, "done", "a", 10), (2, "done", "b", 20), (3, "open", "a", 30), (4, "done", "a", 40), (5, "open", None, None)]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(ORDERS, "_id bigint, status string, category string, amount bigint")


def run(df, *stages, **more):
    return [r.asDict(True) for r in aggregate(df, list(stages), **more).collect()]


def test_match_group_sort_limit(orders):
    got = run(orders, {"$match": {"status": "done"}}, {"$group": {"_id": "$category", "t": {"$sum": "$amount"}}}, {"$sort": {"t": -1}}, {"$limit": 1})
    assert got == [{"_id": "a", "t": 50.0}]


def test_accumulators(orders):
    got = run(orders, {"$sort": {"amount": -1}}, {"$group": {"_id": "$status", "n": {"$count": {}}, "a": {"$avg": "$amount"}, "f": {"$first": "$amount"}, "l": {"$last": "$category"}, "p": {"$push": "$amount"}, "lo": {"$min": "$amount"}, "hi": {"$max": "$amount"}}})
    by = {r["_id"]: r for r in got}
    assert by["done"] == {"_id": "done", "n": 3, "a": 70 / 3, "f": 40, "l": "a", "p": [40, 20, 10], "lo": 10, "hi": 40}
    assert by["open"]["p"] == [30, None] and by["open"]["l"] is None and by["open"]["a"] == 30.0


def test_sum_of_none_is_zero_and_empty_group_gives_no_row(orders):
    assert run(orders, {"$match": {"_id": 5}}, {"$group": {"_id": None, "s": {"$sum": "$amount"}, "a": {"$avg": "$amount"}}}) == [{"_id": None, "s": 0.0, "a": None}]
    assert run(orders, {"$match": {"_id": 99}}, {"$group": {"_id": None, "s": {"$sum": "$amount"}}}) == []
    assert run(orders, {"$match": {"_id": 99}}, {"$count": "n"}) == [{"n": 0}]


def test_compound_key_and_missing_key(orders):
    got = run(orders, {"$group": {"_id": {"s": "$status", "c": "$category"}, "n": {"$sum": 1}}})
    assert {(r["_id"]["s"], r["_id"]["c"]): r["n"] for r in got} == {("done", "a"): 2.0, ("done", "b"): 1.0, ("open", "a"): 1.0, ("open", None): 1.0}


def test_unwind(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "_id bigint, tags array<string>")
    assert [(r["_id"], r["tags"]) for r in run(df, {"$unwind": "$tags"})] == [(1, "x"), (1, "y")]
    kept = run(df, {"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}})
    assert sorted((r["_id"], r["tags"] or "") for r in kept) == [(1, "x"), (1, "y"), (2, ""), (3, "")]


def test_variant_unwind_and_group(spark):
    df = spark.createDataFrame([(1, '{"v":[1,null,"x"]}'), (2, '{"v":7}'), (3, '{"v":[]}'), (4, '{}'), (5, '{"v":null}')], "_id bigint, j string").select("_id", F.parse_json("j").alias("d"))
    got = run(df, {"$unwind": "$d.v"}, {"$project": {"_id": 1}})
    assert sorted(r["_id"] for r in got) == [1, 1, 1, 2]
    mixed = spark.createDataFrame([(1, "1"), (2, "1.0"), (3, '"a"'), (4, "null"), (5, '"a"')], "_id bigint, j string").select("_id", F.parse_json("j").alias("v"))
    got = sorted(r["n"] for r in run(mixed, {"$group": {"_id": "$v", "n": {"$count": {}}}}))
    assert got == [1, 1, 1, 2]


def test_push_of_mixed_values_and_mixed_directions(spark):
    rows = [(1, "a", 2, "1"), (2, "b", 1, '"x"'), (3, "a", 1, "null"), (4, None, 5, "[2]"), (5, "ab", 3, "2.5")]
    df = spark.createDataFrame(rows, "_id bigint, s string, n int, j string").select("_id", "s", "n", F.parse_json("j").alias("v"))
    for sort, ids in (({"s": -1, "n": 1}, [2, 5, 3, 1, 4]), ({"s": 1, "n": -1}, [4, 1, 3, 5, 2]), ({"v": -1, "s": 1}, [2, 4, 5, 1, 3]), ({"n": -1, "s": -1}, [4, 5, 1, 2, 3])):
        stages = [{"$sort": sort}, {"$group": {"_id": None, "p": {"$push": "$v"}, "i": {"$push": "$_id"}, "f": {"$first": "$_id"}, "l": {"$last": "$_id"}}}]
        got = aggregate(df, stages)
        assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()  # the order is the aggregates' alone
        row = got.first()
        assert row.i == ids and (row.f, row.l) == (ids[0], ids[-1])
        assert [x.toPython() for x in row.p] == [{1: 1, 2: "x", 3: None, 4: [2], 5: 2.5}[i] for i in ids]
        assert [r._id for r in aggregate(df, [{"$sort": sort}]).collect()] == ids


def test_lookup_of_fields_that_no_row_has(spark):
    left, right = spark.createDataFrame([(1, 10)], "_id bigint, item bigint"), spark.createDataFrame([(10, "pen")], "id bigint, name string")
    for local, foreign in (("nothing", "id"), ("item", "nothing"), ("nothing", "nothing")):
        spec = {"from": "items", "localField": local, "foreignField": foreign, "as": "found"}
        assert run(left, {"$lookup": spec}, tables=lambda n: right) == [{"_id": 1, "item": 10, "found": []}]
        assert run(left, {"$lookup": spec}, {"$unwind": "$found"}, tables=lambda n: right) == []


def test_lookup(spark):
    left = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "_id bigint, item bigint")
    right = spark.createDataFrame([(10, "pen"), (10, "ink")], "id bigint, name string")
    spec = {"from": "items", "localField": "item", "foreignField": "id", "as": "found"}
    got = {r["_id"]: [x["name"] for x in r["found"]] for r in run(left, {"$lookup": spec}, tables=lambda n: right)}
    assert got == {1: ["ink", "pen"], 2: [], 3: []}
    plan = aggregate(left, [{"$lookup": spec}, {"$unwind": "$found"}], lambda n: right)
    assert sorted(r.found.name for r in plan.collect()) == ["ink", "pen"]
    assert "collect_list" not in plan._jdf.queryExecution().executedPlan().toString()


def test_projections(orders):
    assert run(orders, {"$project": {"status": 1}}, {"$limit": 1})[0].keys() == {"_id", "status"}
    assert run(orders, {"$project": {"status": 1, "_id": 0}}, {"$limit": 1})[0].keys() == {"status"}
    assert run(orders, {"$project": {"status": 0}}, {"$limit": 1})[0].keys() == {"_id", "category", "amount"}
    got = run(orders, {"$addFields": {"x.y": {"$divide": ["$amount", 0]}, "z": {"$multiply": ["$amount", 2]}, "w": {"$add": ["$z", 1]}}}, {"$match": {"_id": 1}})[0]
    assert got["x"] == {"y": None} and got["z"] == 20.0 and got["w"] == 21.0


@pytest.mark.parametrize("stages", [[{"$nothing": 1}], [{"$group": {"x": {"$sum": 1}}}], [{"$group": {"_id": None, "x": {"$median": 1}}}], [{"$limit": -1}], [{"$unwind": "x"}], [{"$count": ""}], {}, [{"$sort": {"a": 2}}]])
def test_bad_pipelines(orders, stages):
    with pytest.raises(InvalidQuery):
        aggregate(orders, stages)
