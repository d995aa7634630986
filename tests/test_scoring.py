"""Scores against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from finweave.functions import scoring

SCHEMA = "entity_id string, transaction_amount double, velocity_30d int, high_risk_country boolean, customer_type string, is_pep boolean, adverse_media_hits int, centrality_score double, layering_flag boolean"
LOW = ("ent-low", 500.0, 3, False, "retail", False, 0, 0.0, False)
HIGH = ("ent-high", 2_000_000.0, 150, True, "correspondent", True, 5, 0.85, True)


def scored(spark, *rows, schema=SCHEMA, **kw):
    return scoring.score_entities(spark.createDataFrame(list(rows), schema), **kw).collect()


def test_low_and_high(spark):
    low, high = scored(spark, LOW, HIGH)
    assert low["weighted_score"] == pytest.approx(1.235) and low["base_score"] == pytest.approx(2.0625) and low["risk_level"] == "LOW"
    assert high["weighted_score"] == pytest.approx(94.75) and high["base_score"] == pytest.approx(91.875) and high["risk_level"] == "CRITICAL"
    assert sum(high["contributing_factors"].values()) * 100 == pytest.approx(94.75)


def test_missing_features_take_defaults(spark):
    (row,) = scored(spark, ("x",), schema="entity_id string")
    assert row["weighted_score"] == pytest.approx(1.0) and row["base_score"] == pytest.approx((5 + 10) / 8)
    (null,) = scored(spark, ("x", *(None,) * 8))
    assert null["weighted_score"] == row["weighted_score"]


def test_country_as_text(spark):
    a, b = scored(spark, ("x", "ir"), ("y", "US"), schema="entity_id string, high_risk_country string")
    assert a["weighted_score"] - b["weighted_score"] == pytest.approx(15.0)


def test_weights(spark):
    (row,) = scored(spark, HIGH, weights={"PEP_STATUS": 0.0})
    assert row["weighted_score"] == pytest.approx(79.75)
    with pytest.raises(ValueError):
        scored(spark, HIGH, weights={"PEP_STATUS": 1.5})


@pytest.mark.parametrize("score, level", [(10, "LOW"), (29.9999, "LOW"), (30, "MEDIUM"), (45, "MEDIUM"), (60, "HIGH"), (65, "HIGH"), (80, "CRITICAL"), (85, "CRITICAL")])
def test_levels(spark, score, level):
    assert spark.range(1).select(scoring.level(F.lit(score))).first()[0] == level


def test_lake_score(spark):
    score = lambda *x: spark.range(1).select(scoring.lake_score(*x)).first()[0]
    no = F.lit(False)
    assert score(F.lit(9500), F.lit(0), no, F.lit("retail"), no, F.lit(True), no) == 14.0
    null = F.lit(None)
    assert score(null.cast("double"), null.cast("int"), null.cast("boolean"), null.cast("string"), null.cast("boolean"), null.cast("boolean"), null.cast("boolean")) == 4.0
    assert spark.range(1).select(scoring.level(F.lit(None).cast("double"), "LOW")).first()[0] == "LOW"


def test_json(spark):
    df = scoring.score_entities(spark.createDataFrame([HIGH], SCHEMA))
    out = json.loads(df.select(scoring.to_json(df, F.timestamp_seconds(F.lit(0)))).first()[0])
    assert out.pop("timestamp") == "1970-01-01T00:00:00.000000+00:00" and "timestamp" in json.loads(df.select(scoring.to_json(df)).first()[0])
    assert out["weighted_score"] == 94.75 and out["base_score"] == 91.88 and out["contributing_factors"]["VELOCITY"] == 0.1125


def test_at_least(spark):
    df = spark.createDataFrame([("LOW",), ("HIGH",), ("CRITICAL",), ("odd",), (None,)], "l string")
    assert df.where(scoring.at_least("l")).count() == 2
    assert df.where(scoring.at_least("l", "LOW")).count() == 5
    assert df.where(scoring.at_least("l", "none such")).count() == 2
