"""The pipeline stage by stage on the small tables, each stage against its rule on its own input."""

import os
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquill.llm import pipeline as corpus_pipeline
from docquill.llm import mixing
from docquill.llm.common import saved, shared_dir
from test_text_operators import FOREIGN
from tests_llm_rules import plain_hits, shingle_parts

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, docs, SF), shared_dir(spark))
        left = {r.doc_id: r.text for r in after.collect()}
        assert after.columns == columns and set(left.items()) <= set(texts.items())
        if name == "language_id":
            assert {i for i, t in texts.items() if any(c.isalpha() for c in t)} == set(left)
        elif name == "near_dedup":
            part = shingle_parts(texts)
            assert set(left) == {i for i, p in part.items() if i == p} and len(left) < len(texts)
        elif name == "decontaminate":
            assert set(left) == {i for i, t in texts.items() if not plain_hits(t, items)[1]} and len(left) < len(texts)
        else:  # the rows that the mix keeps, about as many as their probabilities say
            found = mixing.mix(docs).toPandas()
            assert set(left) == set(found["doc_id"][found["kept"]]) and len(left) < len(texts)
            assert found["tokens"][found["kept"]].sum() / found["tokens"].sum() == pytest.approx((found["prob"] * found["tokens"]).sum() / found["tokens"].sum(), abs=0.15)
        docs, texts = after, left
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    start = 0
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert set(got) == set(texts)
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}  # all stages as one run
    assert whole == got


def test_mix_stage_keeps_the_same_documents_for_few_and_many_cells(spark, monkeypatch):
    """A source without tokens, one that is tied to a language, shares that are halved ahead; few rounds."""
    for name, value in {"ROUNDS": 3, "NEAR": 0.05, "STEPS": 8}.items():
        monkeypatch.setattr(mixing, name, value)
    cells = [("a", "en", 30, 7), ("b", "en", 50, 3), ("c", "en", 40, 6), ("c", "fr", 3, 6), ("d", "fr", 60, 5), ("empty", "en", 40, 0), ("empty", "fr", 40, 0)]
    kinds = [(source, lang, size) for source, lang, n, size in cells for _ in range(n)]
    docs = spark.createDataFrame([(k, "tok " * n, lang, source, 4 * n) for k, (source, lang, n) in enumerate(kinds)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    few = {r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect()}
    monkeypatch.setattr(mixing, "mix", partial(mixing.mix, driver_cells=0))
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect()} == few and 0 < len(few) < len(kinds)


def test_language_stage_drops_foreign_and_junk_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = [(10_000 + k, t, "en", "src1", len(t)) for k, t in enumerate(FOREIGN)]
    left = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(docs.columns)), SF)
    left = {r.doc_id for r in left.select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}


def test_stages_stand_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some text here", "en", "a", 3), (2, "", "en", "a", 0), (3, "same words here", "en", "a", 5), (3, "same words here", "en", "a", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df.withColumn("id", F.lit("x")), SF).columns == [*df.columns, "id"]
        tokens = corpus_pipeline.token_ids(spark, df.withColumn("id", F.lit("x")), SF)
        assert tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and tokens.count() == df.count()
    rows.append((3, "other words stand here under the same id", "en", "a", 9))
    once = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted((str(r.doc_id), r.text or "") for r in once.collect()) == [("1", ""), ("2", ""), ("3", "other words stand here under the same id"), ("3", "same words here"), ("None", "some text here")]
