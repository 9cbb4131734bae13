"""The pipeline's stages on a small corpus, and the registered queries against their SQL."""

import collections
import os
import re
import sys
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tapewright.llm import mixing, queries

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import brute_rates, reference_components  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_stages_keep_the_columns_and_only_take_away(stages):
    columns = stages[0].columns
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() == after.select("doc_id").distinct().count()
    assert stages[-1].count() == stages[-2].count()


def test_quality_stage_agrees_with_the_labels(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    right = [(r.quality == 1) == (r.doc_id in kept) for r in labels.collect()]
    assert sum(right) / len(right) > 0.97


def test_leaks_are_gone(spark, sf_dir, stages):
    items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in stages[3].collect() if any(i in (r.text or "").lower() for i in items)]


def test_near_duplicates_match_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    wanted = {i for i, (_, root) in reference_components(rows).items() if i == root}
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == wanted


def test_decontamination_matches_brute_force(spark, sf_dir, stages):
    """Windows of twelve words with two substitutions at most, counted for all pairs of places."""
    items = [re.findall(r"\w+", (r.text or "").lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    code = {}
    number = lambda words: np.array([code.setdefault(w, len(code)) for w in words])
    windows = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(number(w), 12) for w in items if len(w) >= 12]), axis=0)
    assert all(len(w) >= 12 for w in items)

    def leaks(text):
        own = number(re.findall(r"[^\W_]+", (text or "").lower()))
        if len(own) < 12:
            return False
        own = np.lib.stride_tricks.sliding_window_view(own, 12)
        return any((windows[:, None, :] == own[None, k : k + 500, :]).sum(2).max() >= 10 for k in range(0, len(own), 500))

    kept = {r.doc_id for r in stages[3].select("doc_id").collect()}
    assert {r.doc_id for r in stages[2].collect() if not leaks(r.text)} == kept


def test_mixing_matches_brute_force(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mixing.mix(stages[3], labels, corpus_pipeline.TARGETS, most=1.0).toPandas()
    rate, best = brute_rates(out[out["tokens"] > 0], corpus_pipeline.TARGETS, 1.0)
    body = out[out["tokens"] > 0]
    p, t = body[[f"p_{d}" for d in corpus_pipeline.TARGETS]].to_numpy(), body["tokens"].to_numpy(float)
    mass = (p * t[:, None]).sum(0)
    wanted = mass[0] * np.array(list(corpus_pipeline.TARGETS.values())) / corpus_pipeline.TARGETS["clean"]
    off = ((p * (t * body["rate"].to_numpy())[:, None]).sum(0) - wanted) / t.sum()
    assert float((off**2 / (mass / t.sum())).sum()) <= best * 1.02 + 1e-9
    assert set(out[out["copies"] >= 1]["doc_id"]) == {r.doc_id for r in stages[4].select("doc_id").collect()}


def test_sharding_matches_brute_force(stages):
    """The ring walk again, from the rows themselves: each cell's bytes, heavy cells first, full shards passed over."""
    rows = stages[5].collect()
    texts = {r.doc_id: (r.text or "").encode() for r in stages[4].collect()}
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows)
    loads, counts = collections.Counter(), collections.Counter()
    for r in rows:
        loads[r.shard] += r["size"]
        counts[r.shard] += 1
    largest = max(r["size"] for r in rows)
    mean = sum(loads.values()) / corpus_pipeline.SHARDS
    assert max(loads.values()) <= mean * 1.0005 + largest
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


ODD = [(1, None), (2, ""), (3, " \n "), (4, "same words here"), (5, "same words here"), (5, "same words here"), (None, "no id"), (None, None), (6, "word " * 40_000), (7, "é ☃ 𝒳")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_bear_odd_rows_and_names(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    names = ["_gone", "_bad", "_node", "rate", "copies", "shard", "p_clean", "component_id", "_at", "_words", "seed", "score"]
    docs = spark.createDataFrame([(i, t, *("x" for _ in names)) for i, t in ODD], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name == "sharding":
        assert len(rows) == len(ODD)
    else:
        assert out.columns == docs.columns and len(rows) <= len(ODD)
        if name != "quality":
            assert sum(r.doc_id is None for r in rows) == 2
        if name == "near_duplicates":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 6, 7, None}
        if name == "decontamination":
            assert len(rows) == len(ODD)
    empty = stage(spark, docs.where("1 = 0"), sf_dir)
    assert empty.count() == 0 and empty.columns == out.columns


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert {(r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.shard, r.slot) for r in stages[-1].collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{file}')")
    found = queries.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    cursor = db.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == sorted(repr([r[k] for k in at]) for r in cursor.fetchall())
