"""Every registered query of the engine against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from docquill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rows = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in rows.fetchall())


def test_found_rows_do_not_pass_the_driver(spark, monkeypatch):
    kind, fetched = type(spark.range(1)), [0]
    collect = kind.collect

    def counted(df):
        rows = collect(df)
        fetched.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    df = catalogue.QUERIES["db_text_search"](spark, SF)
    assert max(fetched) < 20 < df.count()
    rows = [(-r.score, r.k) for r in collect(df)]
    assert rows == sorted(rows)


def test_watched_events_do_not_pass_the_driver(spark, monkeypatch):
    from pyspark.sql.streaming import DataStreamWriter

    begin, streams = DataStreamWriter.start, []
    monkeypatch.setattr(DataStreamWriter, "start", lambda *a, **more: streams.append(begin(*a, **more)) or streams[-1])
    df = catalogue.QUERIES["db_watch"](spark, SF)
    assert df.groupBy().sum("n").first()[0] > 500
    sunk = [p["sink"]["numOutputRows"] for q in streams for p in q.recentProgress]
    assert sunk and max(sunk) <= 4


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    """The entry works when their folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "docquill", tmp_path / "docquill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op1_') or k == 'pipeline' for k in q); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
