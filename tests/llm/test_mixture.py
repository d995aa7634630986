"""The Pfair schedule and the mixture against their definitions."""

import os
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finweave.llm import mixture

TARGETS = "source string, target_weight double, max_repeats int, n_tokens string"


def deviation(weights, blocks):
    """The greatest distance in blocks of a source from its share, over all points of the schedule."""
    slots = mixture.schedule(weights, blocks)
    assert (np.sort(np.concatenate(slots)) == np.arange(blocks)).all()
    worst = 0.0
    for w, s in zip(weights, slots):
        share, n = w / sum(weights), np.arange(len(s))
        worst = max([worst, *(np.abs(n - share * s)), *(np.abs(n + 1 - share * (s + 1)))])  # just before and just after each block
    return worst


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60).map(float), st.floats(1e-3, 1.0)), min_size=1, max_size=8), st.integers(1, 3000))
def test_schedule_is_fair(weights, blocks):
    assert deviation(weights, blocks) < 1 + 1e-9


@pytest.mark.parametrize("weights", [(0.30103, 0.47712, 0.22185), (0.12345, 0.87655), (0.00001, 0.99999)])
def test_long_schedules_do_not_drift(weights):
    assert deviation(list(weights), 1_000_000) < 1 + 1e-6


def tokens(spark, sizes):
    rows = [(k * 1000 + i, s, n) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET", 7)
    monkeypatch.setattr(mixture, "GROUP", 3)
    sizes = {"big": [5 + k % 9 for k in range(600)], "small": [11] * 20, "tiny": [3] * 4, "other": [9] * 50}
    t = tokens(spark, sizes)
    targets = spark.createDataFrame([("Big", 5.0, 1, "x"), (" small ", 3.0, 3, "x"), ("TINY", 0.5, 9, "x"), ("absent", 2.0, 5, "x"), ("zero", 0.0, 1, "x"), (None, 1.0, 1, "x")], TARGETS)
    block = 50
    m = mixture.mix(t, targets, block)
    rows = m.collect()
    total = sum(r["n_tokens"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["n_tokens"]
    weights = {"big": 5, "small": 3, "tiny": 0.5}
    assert set(by) == set(weights)
    assert all(abs(by[s] - total * w / 8.5) <= 15 for s, w in weights.items())
    caps = {"big": 1, "small": 3, "tiny": 9}
    seen = defaultdict(list)
    for r in rows:
        seen[r["source"], r["doc_id"]].append(r["repeat"])
    assert all(sorted(x) == list(range(len(x))) and len(x) <= caps[s] for (s, _), x in seen.items())
    assert max(len(x) for x in seen.values()) > 1
    assert m.groupBy("slot").agg(F.countDistinct("source").alias("n")).where("n > 1").count() == 0
    done, ahead = defaultdict(int), 0
    for slot in sorted({r["slot"] for r in rows}):
        for r in rows:
            if r["slot"] == slot:
                done[r["source"]] += r["n_tokens"]
                ahead += r["n_tokens"]
        assert all(abs(done[s] - ahead * w / 8.5) < 2 * block for s, w in weights.items())
    report = {r["source"]: r for r in mixture.shares(m, t, targets).collect()}
    assert report["absent"]["tokens"] == 0 and report["big"]["actual_share"] == pytest.approx(by["big"] / total) and report["small"]["mean_repeats"] == pytest.approx(by["small"] / 220)
    assert {tuple(r) for r in mixture.mix(t, targets, block).collect()} == {tuple(r) for r in rows}


def test_wanted_size(spark):
    """A small source falls short of its share of a wanted size instead of making the mixture small."""
    t = tokens(spark, {"big": [10] * 900, "mid": [10] * 500, "tiny": [10] * 5})
    targets = spark.createDataFrame([("big", 5.0, 1, "x"), ("mid", 3.0, 2, "x"), ("tiny", 2.0, 2, "x")], TARGETS)
    assert mixture.mix(t, targets, 50).agg(F.sum("n_tokens")).first()[0] == 500
    m = mixture.mix(t, targets, 50, size=15_000)
    report = {r["source"]: r for r in mixture.shares(m, t, targets).collect()}
    assert {s: r["tokens"] for s, r in report.items()} == {"big": 7500, "mid": 4500, "tiny": 100}
    assert report["tiny"]["mean_repeats"] == 2 and report["tiny"]["actual_share"] == pytest.approx(100 / 12_100)
    early = sorted(m.collect(), key=lambda r: r["slot"])[:40]
    assert {r["source"] for r in early} == {"big", "mid", "tiny"}


def test_blocks_grow_with_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCKS", 20)
    t, targets = tokens(spark, {"a": [10] * 300, "b": [10] * 300}), spark.createDataFrame([("a", 1.0, 1, "x"), ("b", 1.0, 1, "x")], TARGETS)
    assert mixture.mix(t, targets, 10).select("slot").distinct().count() <= 22 and mixture.mix(t, targets, 10).count() == 600


def test_empty(spark):
    t, targets = tokens(spark, {"a": [1]}), spark.createDataFrame([("a", 1.0, 1, "x")], TARGETS)
    assert mixture.mix(t.limit(0), targets).count() == 0 and mixture.mix(t, targets.limit(0)).count() == 0
    assert mixture.shares(mixture.mix(t.limit(0), targets), t.limit(0), targets).first()["actual_share"] == 0.0
    assert [tuple(r) for r in mixture.mix(t, targets).collect()] == [(0, "a", 0, 0, 1)]


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Case Notes", "Hello world"), (2, "case-notes", None), (3, "case_notes", ""), (4, None, "x"), (5, "b", "word " * 50_000), (5, "b", "x <|endoftext|>")], "doc_id bigint, source string, text string")
    out = {(r["doc_id"], r["source"]): r["n_tokens"] for r in mixture.supply(df).where("n_tokens <> 50000").collect()}
    assert out[1, "case_notes"] == 2 and set(out) >= {(1, "case_notes"), (5, "b")} and (2, "case_notes") not in out
