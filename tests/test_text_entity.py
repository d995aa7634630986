"""Name and address normalisation, similarities, components, resolution and merging."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from finweave.functions import text
from finweave.operators import entity
from finweave.operators.components import connected_components

SCHEMA = "entity_id string, name string, address string, dob string, national_id string, account_numbers array<string>, risk_score double"


def one(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, want", [("Ángel García", "angel garcia"), ("Acme Corporation Ltd", "acme"), ("O'Brien  Inc", "obrien"), ("", ""), (None, ""), ("Łukasz", "ukasz"), ("李", "")])
def test_names(spark, raw, want):
    assert one(spark, text.entity_name, raw) == want
    assert one(spark, lambda c: text.entity_name(c, text.ascii_fold_exact), raw) == want


@pytest.mark.parametrize("raw, want", [("123 Main St.", "123 main street"), ("Flat 2, Park Ave", "flat 2 park avenue"), (None, ""), ("ﬁrst rd", "first road")])
def test_addresses(spark, raw, want):
    assert one(spark, lambda c: text.entity_address(c, text.ascii_fold_exact), raw) == want


def brute_similarity(a, b):
    def jac(x, y):
        return 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y)

    def grams(s):
        return {s[i : i + 2] for i in range(len(s) - 1)}

    na, nb = a["name"], b["name"]
    dice = 1.0 if na == nb == "" else 0.0 if "" in (na, nb) else float(na == nb) if min(len(na), len(nb)) < 2 else 2 * len(grams(na) & grams(nb)) / (len(grams(na)) + len(grams(nb)))
    name = 0.6 * jac(set(na.split()), set(nb.split())) + 0.4 * dice
    acc = jac(set(a["accounts"]), set(b["accounts"])) if a["accounts"] and b["accounts"] else 0.0
    same = lambda k: float(a[k] is not None and a[k] == b[k])
    return 0.35 * name + 0.20 * jac(set(a["address"].split()), set(b["address"].split())) + 0.15 * same("dob") + 0.20 * same("nid") + 0.10 * acc


def people(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append((
            f"e{k:03d}", r.choice(["John Smith", "Jon Smith", "J Smith", "Maria Lopez", "María López Ltd", "", None]), r.choice(["123 Main St", "123 Main Street", "9 Low Rd", None]),
            r.choice(["1980-01-15", "1990-02-02", None]), r.choice(["ABC123", " abc123", "XYZ", None]), r.choice([["A1"], ["A1", "A2"], [], None, ["A2"]]), float(r.randint(0, 100)),
        ))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.7])
def test_pairs_match_brute_force(spark, threshold):
    df = spark.createDataFrame(people(60, 7), SCHEMA)
    rows = [r.asDict() for r in entity.features(df).collect()]
    want = {(a["id"], b["id"]): s for a, b in itertools.combinations(sorted(rows, key=lambda r: r["id"]), 2) if (s := brute_similarity(a, b)) >= threshold - 1e-12}
    got = {(r[0], r[1]): r[2] for r in entity.similar_pairs(df, threshold).collect()}
    assert {k for k, s in want.items() if s > threshold + 1e-9} <= set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_two_missing_addresses_are_equal(spark):
    row = ("Maria", None, "1990-01-01", "N1", ["A"], 1.0)
    df = spark.createDataFrame([("a", *row), ("b", *row)], SCHEMA)
    assert entity.similar_pairs(df).first()["similarity"] == pytest.approx(1.0)


def test_thresholds():
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError):
            entity.check_threshold(bad)


def test_resolve_merge_network(spark):
    base = ("1980-01-15", "N1", ["A1"])
    rows = [("a", "John Smith", None, *base, 10.0), ("b", "John Smith", "", *base[:2], ["A1", "A2"], 80.0), ("c", "Someone Else", "x", None, None, None, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = entity.resolve(df)
    assert {tuple(r) for r in groups.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {tuple(r) for r in entity.network(groups).collect()} == {("a", "b"), ("b", "a")}
    merged = {r["group_id"]: r for r in entity.merge(df, groups).collect()}
    assert merged["a"]["accounts"] == "A1|A2" and merged["a"]["risk_score"] == 80.0 and merged["a"]["members"] == 2 and merged["c"]["accounts"] == ""
    assert entity.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(0, k) for k in range(100, 130)] + [(k, k + 1) for k in range(200, 240)] + [(None, 3), (5, None), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in parent}
    got = {tuple(x) for x in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
