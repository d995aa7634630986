"""Normalisation, quality rules and flags on small records."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from finweave.functions import rules

AT = datetime(2025, 7, 1, tzinfo=timezone.utc)
RAW = "transaction_id string, amount string, source_account string, destination_account string, timestamp string, currency string"
GOOD = ("TXN-001", "1500.0", "ACC-SRC001", "ACC-DST001", "2025-06-01T10:00:00Z", "USD")


def report(spark, *rows):
    return rules.validate(spark.createDataFrame(list(rows), RAW), rules.standard_rules(AT)).collect()


def failed(row):
    return [r["rule_id"] for r in row["results"] if not r["passed"]]


def test_good_record(spark):
    (row,) = report(spark, GOOD)
    assert row["quality_score"] == 100.0 and failed(row) == [] and row["errors"] == []


@pytest.mark.parametrize(
    "position, value, ids",
    [
        (0, None, ["DQ-001"]), (0, "  ", ["DQ-001"]), (1, None, ["DQ-002", "DQ-006", "DQ-009"]), (1, "abc", ["DQ-006", "DQ-009"]), (1, "NaN", ["DQ-006", "DQ-009"]), (1, "0", ["DQ-006"]), (1, "-5", ["DQ-006"]),
        (1, "15000000", ["DQ-009"]), (2, "x!", ["DQ-010"]), (2, "", ["DQ-003"]), (4, "2025-08-01T00:00:00Z", ["DQ-008"]), (4, "not a time", ["DQ-008"]), (4, "1748772000", []), (4, None, ["DQ-005", "DQ-008"]),
        (5, "XYZ", ["DQ-007"]), (5, "usd", []), (5, " USD", ["DQ-007"]), (5, None, ["DQ-007"]),
    ],
)
def test_rules(spark, position, value, ids):
    (row,) = report(spark, tuple(value if k == position else x for k, x in enumerate(GOOD)))
    assert failed(row) == ids
    assert row["quality_score"] == round(100 * (10 - len(ids)) / 10, 2)
    assert len(row["errors"]) == sum(i not in ("DQ-009", "DQ-010") for i in ids)


def test_message(spark):
    (row,) = report(spark, (None, *GOOD[1:]))
    assert row["errors"] == ["[DQ-001] Failed: Transaction ID must not be null or empty. (field=transaction_id)"]


def test_custom_rule(spark):
    own = rules.Rule("CUSTOM-001", "ERROR", "source_account", "No test accounts.", lambda: ~F.col("source_account").startswith("TEST"))
    rs = rules.add_rule(rules.standard_rules(AT), own)
    df = spark.createDataFrame([("T", "1", "TEST-001", "ACC-DST1", GOOD[4], "USD")], RAW)
    assert failed(rules.validate(df, rs).first()) == ["CUSTOM-001"]
    twice = rules.add_rule(rs, rules.Rule("CUSTOM-001", "ERROR", "source_account", "Other.", lambda: F.lit(True)))
    row = rules.validate(df, twice).first()
    assert len(row["results"]) == 12 and failed(row) == []


def test_callable_rule(spark):
    own = rules.callable_rule("CUSTOM-002", "WARNING", "amount", "Even.", lambda r: int(float(r["amount"])) % 2 == 0, ["amount"])
    out = rules.validate(spark.createDataFrame([GOOD, (GOOD[0], "x", *GOOD[2:]), (GOOD[0], "3", *GOOD[2:])], RAW), [own]).collect()
    assert [r["quality_score"] for r in out] == [100.0, 0.0, 0.0] and out[1]["errors"] == []
    assert [r["results"][0]["message"] for r in out] == ["OK", "Failed: could not convert string to float: 'x'", "Failed: Even."]


def test_enrichment(spark):
    e = spark.createDataFrame([("A", "Ann", True, None)], "entity_id string, name string, pep_flag boolean, risk_score double")
    out = rules.enrich_with_entity(spark.createDataFrame([("A",), ("B",), (None,)], "source string"), e, "source").collect()
    assert sorted((tuple(r["entity_context"]) for r in out), key=str) == sorted([("A", "Ann", True, 0.0, None, "retail"), *[(None, None, False, 0.0, None, "retail")] * 2], key=str)


def test_no_rules(spark):
    row = rules.validate(spark.createDataFrame([GOOD], RAW), []).first()
    assert row["quality_score"] == 0.0 and row["results"] == []


def test_normalize_record(spark):
    df = spark.createDataFrame([(" T1 ", "12.5", " usd\t", "wire", None), ("", "x", None, "", "later")], "txn_id string, amt string, ccy string, txn_type string, type string")
    a, b = rules.normalize_record(df).collect()
    assert (a["transaction_id"], a["amount"], a["currency"], a["transaction_type"]) == ("T1", 12.5, "USD", "wire")
    assert len(b["transaction_id"]) == 36 and b["amount"] is None and b["transaction_type"] == "later"


def test_record_flags(spark):
    rows = [(9500.0, "us", "IR"), (10000.0, "US", "us"), (None, None, "DE")]
    out = rules.record_flags(spark.createDataFrame(rows, "amount double, source_country string, destination_country string")).collect()
    names = ("flag_high_value", "flag_structuring_indicator", "flag_round_amount", "flag_cross_border", "flag_high_risk_country")
    assert [tuple(r[n] for n in names) for r in out] == [(False, True, False, True, True), (True, False, True, False, False), (False,) * 5]


def test_lake_flags_keep_nulls(spark):
    (row,) = rules.lake_flags(spark.createDataFrame([(None, "ir", None)], "amount double, source_country string, destination_country string")).collect()
    assert row["flag_high_value"] is None and row["flag_high_risk_country"] is None and row["flag_cross_border"] is False


@pytest.mark.parametrize("amount, score, flagged", [(1_500_000, 90, True), (500_000, 75, True), (50_000, 60, True), (10_000, 40, True), (9_500, 30, False), (500, 10, False), (None, 0, False)])
def test_tiers(spark, amount, score, flagged):
    row = rules.risk_tiers(spark.createDataFrame([(amount, False)], "amount bigint, flagged boolean")).first()
    assert (row["risk_score"], row["flagged"]) == (score, flagged)


def test_structuring_boost(spark):
    rows = [("A", "B", 9500, 90.0), ("B", "A", 9800, None), ("A", "B", 12000, 1.0), ("A", "B", 500, 1.0), ("C", "D", 9100, 10.0)]
    df = spark.createDataFrame(rows, "source_account string, destination_account string, amount int, risk_score double")
    out = rules.structuring_boost(df, "A").orderBy("amount").collect()
    assert [(r["amount"], r["risk_score"], r["flagged"]) for r in out] == [(9500, 100.0, True), (9800, 50.0, True)]
    assert rules.structuring_boost(df).count() == 3


def test_violations(spark):
    schema = "transaction_id string, source_account string, destination_account string, amount decimal(20,4), currency string, transaction_timestamp timestamp"
    df = spark.createDataFrame([(" ", "acc1", "ACC1", None, "EURO", None), ("T", "a", "b", None, None, datetime(2025, 1, 1))], schema)
    a, b = rules.ingestion_violations(df).collect()
    assert [v.split(": ")[1].split(" ")[0] for v in a["violations"]] == ["transaction_id", "amount", "currency", "timestamp", "source_account"]
    assert len(b["violations"]) == 2


def test_split_loses_null_verdicts_unless_safe(spark):
    schema = "transaction_id string, source_account string, destination_account string, amount decimal(20,4), currency string, transaction_timestamp timestamp, transaction_type string, is_pep boolean, flagged boolean"
    rows = [(i, s, "B", a, "USD", None, None, None, None) for i, s, a in (("1", "A", 1), ("2", None, 1), ("3", "B", 1))]
    from decimal import Decimal

    df = rules.lake_quality(rules.normalize_lake(spark.createDataFrame([(i, s, b, Decimal(a), *x) for i, s, b, a, *x in rows], schema)), AT)
    ids = lambda d: sorted(r["transaction_id"] for r in d.collect())
    assert [ids(x) for x in rules.split(df)] == [["1"], ["3"]]
    assert [ids(x) for x in rules.split(df, safe=True)] == [["1"], ["2", "3"]]
    assert df.where("transaction_id = '2'").first()["dq_score"] is None
