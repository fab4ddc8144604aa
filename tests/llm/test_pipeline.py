"""The pipeline's stages against plain versions, and the queries against DuckDB."""

import collections
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import langid, stages
from panelwright.llm.oracles import ORACLES
from panelwright.llm.queries import QUERIES

from . import brute
from .conftest import ordered

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    one = docs.filter("doc_id = 0").first().text
    spark.createDataFrame([("a", one)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_each_others_rows(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    got = stages.language_id(spark, docs, folder)
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert got.columns == docs.columns and ordered([tuple(r) for r in got.collect()]) == ordered(want)
    lines = stages.line_dedup_stage(spark, got, folder)
    kept = [x[3] for x in brute.spread([(r[0], r[1], r[3]) for r in want], 10)]
    assert sorted(brute.sha(r.text) for r in lines.collect()) == sorted(kept)
    own = [tuple(r) for r in lines.collect()]
    near = stages.near_dedup(spark, lines, folder).collect()
    comp = brute.linked([brute.fingerprint(r[1]) for r in own])
    best = {}
    for r, c in zip(own, comp, strict=True):
        key = (r[0] is None, r[0] or 0)
        best[c] = min(best.get(c, key), key)
    assert sorted(best.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in near)
    table = spark.createDataFrame(near, docs.schema)
    clean = stages.decontamination(spark, table, folder).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = brute.contamination([(r.doc_id, r.text) for r in near], items)
    assert len(clean) == len(near) - sum(x[5] for x in bad) < len(near)
    mix = stages.source_mix(spark, spark.createDataFrame(clean, docs.schema), folder)
    sizes = [len(brute.words(r.text)) for r in clean]
    taken = mix.agg(F.sum("taken")).first()[0]
    # Documents are drawn whole, and one of them is most of its source.
    assert 0 <= 1.5 * sum(sizes) - taken < max(sizes) / 2


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "shard"} <= set(out.columns) and out.count() > 0


def test_stages_on_an_empty_table(spark, empty, folder):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, folder).count() == 0


def test_stages_keep_clashing_columns(spark, clashing, folder):
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, clashing, folder).columns == clashing.columns


@data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert set(a) == set(b)
    cols = sorted(a)
    key = lambda d: sorted(map(tuple, d[cols].round(6).astype(str).to_numpy().tolist()))
    assert key(a) == key(b)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    return [(r.doc_id, r.text) for r in rows], items


def _components(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    comp, low = brute.linked(prints), {}
    for (i, _), c in zip(rows, comp, strict=True):
        low[c] = min(low.get(c, i), i)
    return [(i, f"{p:016x}", low[c]) for (i, _), p, c in zip(rows, prints, comp, strict=True)]


@data
@pytest.mark.parametrize(
    ("name", "plain"),
    [
        ("op4_passage_dedup", lambda rows, items: brute.passages(rows)),
        ("op6_suffix_dedup", lambda rows, items: brute.strings(rows)),
        ("op7_decontamination", lambda rows, items: brute.contamination(rows, items)),
        ("op8_simhash", lambda rows, items: _components(rows)),
    ],
)
def test_query_equals_a_plain_version(spark, texts, name, plain):
    assert ordered([tuple(r) for r in QUERIES[name](spark, DATA).collect()]) == ordered(plain(*texts))


@data
def test_language_query(spark, texts):
    """The query against profiles made letter by letter."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    v, codes = langid.letter_vectors(langid.DIM), langid.letter_table()

    def profile(t):
        kept, sym = [], 0
        for c in [0, *(int(codes[ord(x)]) for x in t or ""), 0]:
            if c or not kept or sym:
                kept.append(c)
            sym = c
        grams = collections.Counter(g for g in zip(kept, kept[1:], kept[2:], strict=False) if any(g))
        total = sum((n * (v[0][a] * v[1][b] * v[2][c]) for (a, b, c), n in grams.items()), np.zeros(langid.DIM))
        return total / max(np.linalg.norm(total), 1e-9)

    unit = {r.doc_id: profile(r.text) for r in rows}
    has = {r.doc_id: any(codes[ord(x)] for x in r.text or "") for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    names = sorted({r.lang for r in rows if r.lang is not None})
    protos = np.array([sum(unit[r.doc_id] for r in rows if r.lang == n and has[r.doc_id] and not held[r.doc_id]) for n in names])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    own = protos - protos.mean(axis=0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    for r in QUERIES["op1_language_id"](spark, DATA).collect():
        assert r.held_out == held[r.doc_id]
        if not has[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = unit[r.doc_id] - protos.mean(axis=0)
        cos = own @ (x / np.linalg.norm(x))
        assert abs(r.score - np.clip(cos.max(), 0, 1)) < 1e-4 and cos[names.index(r.lang_pred)] > cos.max() - 1e-4


@data
def test_lm_query(spark, texts):
    got = QUERIES["op2_lm_score"](spark, DATA).collect()
    assert len(got) == len(texts[0]) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0 for r in got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op5_chat_format"}))
def test_queries_on_odd_tables(spark, clashing, tmp_path, name):
    """Nulls, empty and very long texts, repeated rows and clashing columns, as the queries read them."""
    clashing.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [("a", None), (None, "one"), ("b", ""), ("b", "all sites have this line")]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == clashing.count()
