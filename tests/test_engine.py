import io
import json
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docquill.engine import Engine
from docquill.errors import Aborted, DocquillError, InvalidQuery, TokenTooOld, TransactionConflict, UniqueViolation
from docquill.plans import schedules, sql
from docquill.plans.procedures import holds, resolve
from docquill.sources.blobs import DOCX, extract_text


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def test_documents(db):
    assert db.insert("users", {"name": "Vera", "age": 30, "city": "Riga", "_id": 77}) == 1
    assert db.insert_many("users", [{"name": "Odo", "age": 25}, {"name": "Ute", "address": {"zip": "1"}}]) == [2, 3]
    assert db.get("users", 2) == {"_id": 2, "_version": 1, "name": "Odo", "age": 25}
    assert db.find("users", {"age": {"$gt": 20}}, sort={"age": 1})[0]["name"] == "Odo"
    assert db.count("users") == 3 and db.find_one("users", {"address.zip": "1"})["name"] == "Ute"
    assert db.update("users", {"name": "Odo"}, {"$inc": {"age": 1}, "$set": {"tags": ["a"]}}) == 1
    assert db.get("users", 2)["_version"] == 2 and db.get("users", 2)["tags"] == ["a"]
    assert db.update_one("users", {}, {"$set": {"seen": True}}) == 1 and db.get("users", 1)["seen"] is True
    assert db.delete_one("users", {}) == 1 and db.delete("users", {"name": "nobody"}) == 0
    assert db.list_collections() == ["users"]
    kept = db.compact("users")
    assert kept["docs_kept"] == 2 and db.count("users") == 2
    assert db.insert("users", {"name": "Zed"}) == 4
    with pytest.raises(DocquillError):
        db.create_collection("users")


def test_mixed_types_become_variant(db):
    db.insert("m", {"v": 1})
    db.insert_many("m", [{"v": "text"}, {"v": [1, 2]}, {"w": 2.5}, {"v": 1.0}])
    assert [d["_id"] for d in db.find("m", {"v": {"$lt": "z"}}, sort={"_id": 1})] == [1, 2, 3, 5]
    assert [d["_id"] for d in db.find("m", {"v": 1}, sort={"_id": 1})] == [1, 5]
    assert db.get("m", 3)["v"] == [1, 2]


def test_indexes(db):
    db.insert_many("u", [{"email": "a"}, {"email": "b"}, {"x": 1}, {"x": 2}])
    assert db.create_unique_index("u", "email") == "email" and db.create_composite_index("u", ["email", "x"]) == "email_x"
    with pytest.raises(UniqueViolation):
        db.insert_many("u", [{"email": "c"}, {"email": "c"}])
    with pytest.raises(UniqueViolation):
        db.update("u", {"email": "a"}, {"$set": {"email": "b"}})
    assert db.count("u") == 4
    db.create_text_index("u", ["email"])
    db.drop_index("u", "email_x")
    assert [i["name"] for i in db.list_indexes("u")] == ["email", "_text"]
    with pytest.raises(UniqueViolation):
        db.create_unique_index("u2", "k") and db.insert_many("u2", [{"k": 1}, {"k": 1}])


def test_search(db):
    db.insert_many("a", [{"t": "spark engine", "e": [1.0, 0.0]}, {"t": "other words", "e": [0.0, 1.0]}])
    with pytest.raises(InvalidQuery):
        db.text_search("a", "spark")
    db.create_text_index("a", ["t"])
    db.create_vector_index("a", "e", 2)
    assert db.text_search("a", "spark")[0]["_id"] == 1
    assert db.vector_search("a", "e", [0.1, 1.0], 1)[0]["_id"] == 2


def test_sql(db):
    assert db.sql("CREATE TABLE t (a INT, b TEXT)") == "ok"
    assert db.sql("INSERT INTO t (a, b) VALUES (1, 'it''s'), (2, NULL), (-3.5, 'x')") == {"ids": [1, 2, 3]}
    assert db.sql("SELECT b FROM t WHERE a = 1") == [{"b": "it's"}]
    assert db.sql("UPDATE t SET a = a * 10, b = 'n' WHERE a > 0 AND a < 2") == {"modified": 1}
    assert [r["a"] for r in db.sql("SELECT x.a FROM t x ORDER BY x.a")] == [-3.5, 2.0, 10.0]
    assert db.sql("WITH c AS (SELECT a FROM t) SELECT count(*) AS n FROM c JOIN t ON c.a = t.a") == [{"n": 3}]
    assert db.sql("DELETE FROM t WHERE b IS NULL") == {"deleted": 1}
    assert db.sql("SHOW TABLES") == [{"table": "t"}]
    db.sql("CREATE UNIQUE INDEX i ON t (a)")
    db.sql("DROP TABLE t")
    assert db.sql("SHOW TABLES") == []
    for bad in ("MERGE INTO t", "INSERT INTO t (a) VALUES (1, 2)", "DELETE t", "UPDATE t SET a"):
        with pytest.raises(InvalidQuery):
            db.sql(bad)
    assert sql.tables_in("SELECT * FROM a, b JOIN c ON 1=1 WHERE x IN (SELECT y FROM d)") == ["a", "b", "c", "d"]


def test_transactions(db):
    db.insert_many("acc", [{"n": 1, "b": 100}, {"n": 2, "b": 0}])
    with db.transaction() as tx:
        tx.find("acc", {"n": 1})
        tx.update("acc", {"n": 1}, {"$inc": {"b": -40}})
        tx.update("acc", {"n": 2}, {"$inc": {"b": 40}})
        assert db.find_one("acc", {"n": 1})["b"] == 100
    assert [d["b"] for d in db.find("acc", sort={"n": 1})] == [60, 40]
    tx = db.begin_tx()
    tx.update("acc", {"n": 1}, {"$inc": {"b": 1}})
    db.update("acc", {"n": 1}, {"$inc": {"b": 5}})
    with pytest.raises(TransactionConflict):
        tx.commit()
    tx = db.begin_tx()
    tx.insert("acc", {"n": 3})
    tx.rollback()
    assert db.count("acc") == 2
    with pytest.raises(Exception), db.transaction() as tx:
        tx.insert("acc", {"n": 4})
        tx.update("acc", {"n": 1}, {"$push": {"b": 1}})
    assert db.count("acc") == 2


def test_changes(db, spark, tmp_path):
    db.insert("c", {"x": 1})
    stream = db.watch("c", 0)
    db.insert_many("c", [{"x": 2}, {"x": 3}])
    db.update("c", {"x": 3}, {"$set": {"x": 4}})
    db.delete("c", {"x": 1})
    seen = [(r.token, r.operation, r.doc_id) for r in db.changes("c").collect()]
    assert seen == [(1, "insert", 1), (2, "insert", 2), (3, "insert", 3), (4, "update", 3), (5, "delete", 1)]
    assert json.loads(db.changes("c").first().document)["x"] == 1
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 5
    assert db.changes("c", 3).count() == 2
    db.compact("c")
    with pytest.raises(TokenTooOld):
        db.changes("c", 1)


def test_blobs(db):
    db.create_bucket("b")
    meta = db.put_object("b", "dir/one file.html", b"<p>Hello <b>spark</b></p>", "text/html", {"k": "v"})
    db.put_object("b", "two.json", b'{"a": ["spark spark", {"b": "x"}], "n": 1}', "application/json")
    db.put_object("b", "raw", b"\x00", "image/png")
    assert len(meta["etag"]) == 8 and db.get_object("b", "dir/one file.html")[0].startswith(b"<p>")
    assert [o["key"] for o in db.list_objects("b")] == ["dir/one file.html", "raw", "two.json"] and len(db.list_objects("b", prefix="t")) == 1
    assert [r["key"] for r in db.search("spark")] == ["two.json", "dir/one file.html"]
    odd = "a+b*c~d_e-f.g%20/é (1)!'"
    db.put_object("b", odd, b"peculiar", "text/plain")
    assert [r["key"] for r in db.search("peculiar")] == [odd] and db.get_object("b", odd)[0] == b"peculiar"
    db.delete_object("b", odd)
    db.create_bucket("empty")
    assert db.search("spark", bucket="empty") == []
    db.delete_object("b", "raw")
    with pytest.raises(DocquillError):
        db.head_object("b", "raw")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:t>Some</w:t><w:t>words</w:t></w:document>')
    assert extract_text(buf.getvalue(), DOCX) == "Some words"
    assert extract_text(b"%PDF", "application/pdf") is None and extract_text(b"", "image/png") is None and extract_text(b"\xff", "text/plain") is None


def test_procedures(db):
    db.insert_many("acc", [{"id": "A", "b": 500}, {"id": "B", "b": 200}])
    steps = [
        {"step": "find_one", "collection": "acc", "query": {"id": "$param.from"}, "as": "s"},
        {"step": "if", "condition": {"$expr": {"$lt": ["$s.b", "$param.amount"]}}, "then": [{"step": "abort", "message": "insufficient funds"}]},
        {"step": "update", "collection": "acc", "query": {"id": "$param.from"}, "update": {"$inc": {"b": -150}}},
        {"step": "update", "collection": "acc", "query": {"id": "$param.to"}, "update": {"$inc": {"b": 150}}},
        {"step": "return", "value": {"status": "ok", "old": "$s.b"}},
    ]
    db.create_procedure("transfer", {"params": ["from", "to", "amount"], "steps": steps})
    assert db.call_procedure("transfer", {"from": "A", "to": "B", "amount": 150}) == {"status": "ok", "old": 500}
    assert [d["b"] for d in db.find("acc", sort={"id": 1})] == [350, 350]
    with pytest.raises(Aborted):
        db.call_procedure("transfer", {"from": "A", "to": "B", "amount": 9999})
    assert [d["b"] for d in db.find("acc", sort={"id": 1})] == [350, 350]
    db.create_schedule("s", "transfer", every="5m", params={"from": "A", "to": "B", "amount": 150})
    assert db.scheduler().once() == ["s"] and db.get_schedule("s")["run_count"] == 1 and db.get_schedule("s")["last_status"] == "ok"
    assert db.scheduler().once() == []
    db.disable_schedule("s")
    db.delete_schedule("s")
    db.delete_procedure("transfer")
    assert db.list_procedures() == [] and db.list_schedules() == []
    assert holds({"$and": [{"$gt": [2, 1]}, {"$not": {"$eq": ["a", 1]}}]}, {}, {}) and resolve(["$x.y", "$z"], {}, {"x": {"y": 1}}) == [1, "$z"]


def test_schedules():
    at = datetime(2024, 3, 3, 3, 0, tzinfo=timezone.utc)  # a Sunday
    assert schedules.Cron("0 3 * * *").matches(at) and schedules.Cron("*/15 1-5 3 3 0").matches(at) and not schedules.Cron("0 3 3 3 1").matches(at)
    assert schedules.interval("2h") == timedelta(hours=2)
    entry = {"name": "x", "cron": "0 3 * * *", "last_run": (at - timedelta(seconds=30)).isoformat()}
    assert not schedules.due(entry, at) and schedules.due({**entry, "last_run": None}, at)
    for bad in ("* * * *", "61 * * * *", "a * * * *"):
        with pytest.raises(InvalidQuery):
            schedules.Cron(bad)
    for bad in ({"cron": "* * * * *", "every": "5m"}, {}, {"every": "5x"}):
        with pytest.raises(InvalidQuery):
            schedules.validated(bad)


def test_backup(db, spark, tmp_path):
    db.insert("x", {"a": 1})
    db.backup(f"file://{tmp_path}/copy")
    again = Engine.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/new")
    assert again.find("x") == db.find("x")
    with pytest.raises(DocquillError):
        db.backup(f"file://{tmp_path}/copy")


def test_append_frame(db, spark):
    db.insert("f", {"x": 1})
    db.append_df("f", spark.range(0, 100, 1, 7).select((F.col("id") * 2).alias("x"), F.lit("y").alias("s")))
    rows = db.find("f", sort={"_id": 1})
    assert [r["_id"] for r in rows] == list(range(1, 102)) and sorted(r["x"] for r in rows[1:]) == list(range(0, 200, 2))
    assert [r.token for r in db.changes("f").collect()] == list(range(1, 102))


def test_update_to_another_kind(db):
    db.insert_many("k", [{"v": 1}, {"v": 2}])
    assert db.update("k", {"v": 2}, {"$set": {"v": "two"}}) == 1
    assert [d["v"] for d in db.find("k", sort={"_id": 1})] == [1, "two"]


# --- commits ---


def _draft(db, name, step):
    from docquill.sources.collections import Draft

    draft = Draft(db.collection(name))
    step(draft)
    return draft


def test_a_refused_draft_leaves_the_winner_alone(db):
    db.insert("w", {"x": "start"})
    late = _draft(db, "w", lambda d: d.insert([{"x": "late"}]))
    assert db.insert("w", {"x": "winner"}) == 2
    own = db.collection("w")
    assert not own.publish(late)
    late.discard()
    assert [d["x"] for d in db.find("w", sort={"_id": 1})] == ["start", "winner"]
    assert [json.loads(r.document)["x"] for r in db.changes("w").collect()] == ["start", "winner"]
    assert not [n for n in own.files.names() if n.lstrip(".") in late.made]


def test_an_overtaken_writer_tries_again(db):
    db.insert("w", {"x": 0})
    runs = []

    def step(draft):
        if not runs:
            db.insert("w", {"x": 1})
        runs.append(draft.insert([{"x": 2}]))
        return runs[-1]

    assert db.collection("w").change(step) == [3] and runs == [[2], [3]]
    assert [(d["_id"], d["x"]) for d in db.find("w", sort={"_id": 1})] == [(1, 0), (2, 1), (3, 2)]
    assert [r.token for r in db.changes("w").collect()] == [1, 2, 3]


def test_only_one_of_many_creates_a_file(db):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: db.files.create(str(k).encode(), "once"), range(24)))
    assert won.count(True) == 1 and db.files.read("once").decode() == str(won.index(True))
    assert not [n for n in db.files.names() if n.startswith(".once")]


def test_transactions_of_two_collections_are_seen_whole_or_not_at_all(db, monkeypatch):
    from docquill.sources import collections

    db.insert("a", {"n": 1})
    db.insert("b", {"n": 1})
    tx = db.begin_tx()
    tx.update("a", {}, {"$inc": {"n": 1}})
    tx.update("b", {}, {"$inc": {"n": 1}})
    seen = []
    record = collections.Files.create

    def create(files, data, *parts):
        if data == b"committed":  # both manifests are there, the record isn't
            seen.append((db.find("a")[0]["n"], db.find("b")[0]["n"], db.changes("a").count()))
        return record(files, data, *parts)

    monkeypatch.setattr(collections.Files, "create", create)
    tx.commit()
    assert seen == [(1, 1, 1)]
    assert (db.find("a")[0]["n"], db.find("b")[0]["n"], db.changes("a").count()) == (2, 2, 2)

    # a transaction whose client is lost before its record is aborted by the next writer
    monkeypatch.setattr(collections, "PATIENCE", 0.2)
    lost = [_draft(db, name, lambda d: d.insert([{"n": 9}])) for name in ("a", "b")]
    assert all(d.own.publish(d, "lost-client") for d in lost)
    assert db.count("a") == db.count("b") == 1
    assert db.insert("a", {"n": 7}) == 2 and db.insert("b", {"n": 8}) == 2
    assert db.collection("a").decision("lost-client") == "aborted"
    assert [d["n"] for d in db.find("a", sort={"_id": 1})] == [2, 7] and [d["n"] for d in db.find("b", sort={"_id": 1})] == [2, 8]


def test_transactions_of_other_rows_both_succeed(db):
    db.insert_many("acc", [{"n": 1, "b": 0}, {"n": 2, "b": 0}])
    one, two = db.begin_tx(), db.begin_tx()
    one.update("acc", {"n": 1}, {"$inc": {"b": 1}})
    two.update("acc", {"n": 2}, {"$inc": {"b": 1}})
    one.commit()
    two.commit()
    assert [d["b"] for d in db.find("acc", sort={"n": 1})] == [1, 1]
    # one that read what the other changed is refused, though it writes elsewhere
    one, two = db.begin_tx(), db.begin_tx()
    assert one.find("acc", {"n": 1})[0]["b"] == 1
    one.insert("log", {"saw": 1})
    two.update("acc", {"n": 1}, {"$inc": {"b": 1}})
    two.commit()
    with pytest.raises(TransactionConflict):
        one.commit()
    assert db.count("log") == 0


def test_streams_see_published_events_only(db, spark, tmp_path):
    db.insert("s", {"x": 1})
    late = _draft(db, "s", lambda d: d.insert([{"x": "never"}]))
    db.insert("s", {"x": 2})
    assert not late.own.publish(late)
    q = db.watch("s", 0).writeStream.format("memory").queryName("published").option("checkpointLocation", str(tmp_path / "cp1")).start()
    every = db.watch(None).writeStream.format("memory").queryName("every").option("checkpointLocation", str(tmp_path / "cp2")).start()
    db.insert("new_one", {"y": 1})
    db.update("s", {"x": 2}, {"$set": {"x": 3}})
    for stream in (q, every):
        stream.processAllAvailable()
        stream.stop()
    assert sorted((r.token, r.operation) for r in spark.table("published").collect()) == [(1, "insert"), (2, "insert"), (3, "update")]
    assert sorted((r.collection, r.token, r.operation) for r in spark.table("every").collect()) == [("new_one", 1, "insert"), ("s", 3, "update")]
    # a client lost between commit and move: the next reader shows the events
    own = db.collection("s")
    own.files.move(own.manifest().changes[-1], f".{own.manifest().changes[-1]}")
    assert db.changes("s").count() == 3


def test_compaction_keeps_what_readers_use(db):
    db.insert("k", {"x": 1})
    db.insert("k", {"x": 2})
    before = db.table("k")
    db.compact("k")
    assert before.count() == 2 and db.count("k") == 2
    db.compact("k", retain=0)
    assert db.count("k") == 2 and len([n for n in db.collection("k").files.names() if n.startswith("d-")]) == 1


def test_updates_replace_only_folders_with_matches(db):
    db.insert("f", {"x": 1})
    db.insert("f", {"x": 2})
    first, second = db.collection("f").manifest().folders
    db.update("f", {"x": 2}, {"$inc": {"x": 10}})
    after = db.collection("f").manifest().folders
    assert first in after and second not in after and [d["x"] for d in db.find("f", sort={"_id": 1})] == [1, 12]
    db.delete("f", {"x": 1})
    assert first not in db.collection("f").manifest().folders and db.count("f") == 1


# --- explicit nulls, empty objects, stored postings ---


def test_explicit_nulls_and_empty_objects(db):
    db.insert_many("n", [{"v": None}, {"w": 1}, {"v": 3, "o": {}}, {"o": {"a": None}}])
    assert [d["_id"] for d in db.find("n", {"v": None})] == [1]
    assert [d["_id"] for d in db.find("n", {"v": {"$exists": True}}, sort={"_id": 1})] == [1, 3]
    assert [d["_id"] for d in db.find("n", {"v": {"$exists": False}}, sort={"_id": 1})] == [2, 4]
    assert db.get("n", 1) == {"_id": 1, "_version": 1, "v": None} and db.get("n", 3)["o"] == {}
    assert [d["_id"] for d in db.find("n", {"o.a": None})] == [4]
    assert db.update("n", {"w": 1}, {"$set": {"w": None, "z": None}}) == 1 and db.get("n", 2) == {"_id": 2, "_version": 2, "w": None, "z": None}
    assert db.update("n", {"v": 3}, {"$inc": {"v": 2}}) == 1 and db.get("n", 3)["v"] == 5
    with pytest.raises(Exception):
        db.update("n", {"v": None}, {"$inc": {"v": 2}})
    db.create_unique_index("n", "v")
    with pytest.raises(UniqueViolation):
        db.insert("n", {"v": None})  # a null is a value, a missing field is not
    assert db.insert("n", {"w": 2}) == 5


def test_postings_follow_every_write(db):
    db.insert_many("t", [{"s": "spark engine spark"}, {"s": "other words"}])
    db.create_text_index("t", ["s"])
    db.insert("t", {"s": "spark words"})
    ids = lambda q: [r["_id"] for r in db.text_search("t", q)]
    assert ids("spark") == [1, 3] and ids("words") == [2, 3] and ids("the nothing") == []
    db.update("t", {"_id": 1}, {"$set": {"s": "changed text"}})
    assert ids("spark") == [3] and ids("changed") == [1]
    db.delete("t", {"_id": 3})
    db.compact("t")
    assert ids("spark") == [] and ids("words") == [2]
    from docquill.operators.search import text_search

    db.insert_many("t", [{"s": f"words w{k} spark"} for k in range(5)])
    assert [(r["_id"], round(r["_score"], 9)) for r in db.text_search("t", "spark words w3")] == [(r._id, round(r._score, 9)) for r in text_search(db.table("t"), ["s"], "spark words w3").collect()]


def test_a_search_without_a_limit_is_a_dataframe(db, monkeypatch):
    from docquill import engine
    from docquill.operators.search import text_search

    db.insert_many("t", [{"s": f"w{k % 3} spark " * (k % 4)} for k in range(12)])
    db.create_text_index("t", ["s"])
    want = [(r["_id"], round(r["_score"], 9)) for r in text_search(db.table("t"), ["s"], "spark w1", 100).collect()]
    shown = lambda rows: [(r["_id"], round(r["_score"], 9)) for r in rows]
    assert len(want) == 9 and shown(db.text_search_df("t", "spark w1").collect()) == want == shown(db.text_search("t", "spark w1", 100))
    assert shown(db.text_search_df("t", "spark w1", 4).collect()) == want[:4] and db.text_search_df("t", "nothing").count() == 0
    monkeypatch.setattr(engine, "LISTED", 2)
    assert shown(db.text_search("t", "spark w1", 5)) == want[:5] and set(db.text_search("t", "spark w1", 5)[0]) == {"_id", "_version", "s", "_score"}


def test_postings_are_made_where_rows_lie(spark):
    from docquill.operators.search import row_postings, text_index

    rows = [(1, "b a1 b the b", ["b", None, "zz"]), (2, None, None), (3, "the a", []), (4, "\u00c4\u00e9 x \u00e4\u00e9 k9", ["k9"]), (5, "", ["one"])]
    df = spark.createDataFrame(rows, "_id bigint, s string, a array<string>")
    found = row_postings(df, ["s", "a"], ["_id"])
    key = lambda r: (r._id, r.term, r.tf, r.doc_len)
    assert sorted(map(key, found.collect())) == sorted(map(key, text_index(df, ["s", "a"], ["_id"]).collect()))
    assert "Exchange" not in found.sortWithinPartitions("term")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_vector_cells_are_exact(db, spark, monkeypatch, metric):
    """The index finds what a scan finds, through every kind of write; it reads a part of the cells."""
    import random

    from docquill.operators import search

    monkeypatch.setattr(search, "CELL_ROWS", 12)
    rng = random.Random(7)
    spots = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(10)]
    point = lambda k: [x + rng.gauss(0, 0.2) for x in spots[k % 10]]
    db.insert_many("v", [{"e": point(k)} for k in range(200)] + [{"e": [1.0]}, {"x": 1}, {"e": [0.0] * 4}])
    db.create_vector_index("v", "e", 4, metric)
    db.insert_many("v", [{"e": point(k)} for k in range(20)])
    db.update("v", {"_id": 5}, {"$set": {"e": [9.0, 9.0, 9.0, 9.0]}})
    db.delete("v", {"_id": {"$in": [7, 8]}})
    read = []
    where = search.distance
    monkeypatch.setattr(search, "distance", lambda *a: read.append(1) or where(*a))
    for q in [*spots[:3], [9.0, 9.0, 9.0, 8.0], [0.0] * 4]:
        got = [(r["_id"], round(r["_distance"], 9), round(r["_similarity"], 9)) for r in db.vector_search("v", "e", q, 7)]
        want = [(r._id, round(r._distance, 9), round(r._similarity, 9)) for r in search.vector_search(db.table("v"), "e", q, 7, metric).collect()]
        assert [g[1:] for g in got] == [w[1:] for w in want] and (metric == "cosine" and not any(q) or got == want)
    assert {r["_id"] for r in db.vector_search("v", "e", spots[0], 5, ef_search=1)} <= {r["_id"] for r in db.find("v")}
    with pytest.raises(InvalidQuery):
        db.vector_search("v", "e", [1.0], 1)
    db.create_vector_index("empty", "e", 2)
    db.insert_many("empty", [{"e": [1.0, 0.0]}, {"e": [0.0, 1.0]}])
    assert db.vector_search("empty", "e", [0.1, 1.0], 1)[0]["_id"] == 2
    db.compact("empty")
    assert db.collection("empty").manifest().vectors["_vec_e"] and db.vector_search("empty", "e", [0.1, 1.0], 1)[0]["_id"] == 2


def _pdf(*streams, extra=b""):
    parts = [b"%PDF-1.4\n1 0 obj<</Type/Catalog>>endobj\n", extra]
    for k, (head, body) in enumerate(streams, 2):
        parts.append(b"%d 0 obj<<%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (k, head, len(body), body))
    return b"".join([*parts, b"%%EOF"])


def test_pdf_text(db):
    import zlib

    plain = rb"BT /F1 12 Tf 72 700 Td (Quarterly \(draft\) r\351sum\351) Tj T* [(sp) -20 (ark) -300 (engine)] TJ ET q 1 0 0 1 0 0 cm Q BT <48 69> Tj ET"
    deflated = zlib.compress(b"BT 0 -14 Td (second page) ' ET")
    mapped = b"1 beginbfchar <0001> <03A9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    data = _pdf((b"", plain), (b"/Filter/FlateDecode ", deflated), (b"/Type/X/R<</A<</B 1>>>>", mapped), (b"", b"BT <0001000200030004> Tj ET"), (b"/Filter/DCTDecode ", b"BT (image) Tj ET"))
    assert extract_text(data, "application/pdf") == "Quarterly (draft) résumé spark engine Hi second page Ωabc"
    for bad in (b"", b"%PDF-1.4", b"not a pdf", data.replace(b"Catalog", b"Catalog/Encrypt 9 0 R"), data[: len(data) // 2], _pdf((b"/Filter/FlateDecode ", b"broken"))):
        text = extract_text(bad, "application/pdf")
        assert text is None or "Quarterly" in text
    db.put_object("docs", "a.pdf", data, "application/pdf")
    db.put_object("docs", "b.txt", b"another engine", "text/plain")
    assert {r["key"] for r in db.search("engine")} == {"a.pdf", "b.txt"} and [r["key"] for r in db.search("draft")] == ["a.pdf"]


def test_many_writers_at_once(db):
    from concurrent.futures import ThreadPoolExecutor

    db.insert("m", {"n": -1})
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda k: db.insert("m", {"n": k}), range(4)))
        list(pool.map(lambda k: db.update("m", {"n": k}, {"$inc": {"hits": 1}}), [-1] * 3))
    assert sorted(ids) == [2, 3, 4, 5] and sorted(d["n"] for d in db.find("m")) == [-1, 0, 1, 2, 3]
    assert db.get("m", 1)["hits"] == 3 and db.get("m", 1)["_version"] == 4
    assert [r.token for r in db.changes("m").collect()] == list(range(1, 9))
