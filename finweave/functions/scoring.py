"""Risk scores as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.constants import FACTOR_WEIGHTS, HIGH_RISK_COUNTRIES, LEVELS

#: Features of a record with what stands for a missing one.
DEFAULTS = {
    "transaction_amount": 0.0, "velocity_30d": 0, "high_risk_country": False, "customer_type": "retail", "is_pep": False, "adverse_media_hits": 0,
    "centrality_score": 0.0, "layering_flag": False,
}


def _features(df: DataFrame) -> dict[str, Column]:
    types = dict(df.dtypes)
    out = {k: F.coalesce(F.col(k), F.lit(v)) if k in types else F.lit(v) for k, v in DEFAULTS.items()}
    if types.get("high_risk_country") == "string":
        out["high_risk_country"] = F.coalesce(F.upper("high_risk_country").isin(*HIGH_RISK_COUNTRIES), F.lit(False))
    out["transaction_amount"] = out["transaction_amount"].cast("double")
    out["velocity_30d"] = out["velocity_30d"].cast("int")
    return out


def _steps(c: Column, steps: list[tuple[float, float]], rest) -> Column:
    out = F.when(c >= steps[0][0], float(steps[0][1]))
    for least, value in steps[1:]:
        out = out.when(c >= least, float(value))
    return out.otherwise(rest)


def _kinds(c: Column, values: dict[str, float], rest: float) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.lower(c) == k, v) if out is None else out.when(F.lower(c) == k, v)
    return out.otherwise(rest)


def rounded(c: Column, digits: int = 4) -> Column:
    """Half up on the binary value, the same in any engine."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def level(score: Column, null_is: str | None = None) -> Column:
    out = F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 30, "MEDIUM")
    return F.when(score.isNull(), F.lit(null_is)).otherwise(out.otherwise("LOW"))


def base_score(df: DataFrame) -> Column:
    """Mean of eight step functions, at most 100."""
    f = _features(df)
    v = f["velocity_30d"]
    parts = [
        _steps(f["transaction_amount"], [(1_000_000, 100), (100_000, 75), (50_000, 55), (10_000, 35), (5_000, 15)], 5.0),
        _steps(v, [(200, 100), (100, 70), (50, 45), (20, 25)], F.greatest(F.lit(0.0), v * 0.5)),
        F.when(f["high_risk_country"], 100.0).otherwise(0.0),
        _kinds(f["customer_type"], {"correspondent": 80.0, "corporate": 40.0, "retail": 10.0}, 20.0),
        F.when(f["is_pep"], 100.0).otherwise(0.0),
        F.least(F.lit(100.0), f["adverse_media_hits"] * 20.0),
        f["centrality_score"] * 100.0,
        F.when(f["layering_flag"], 100.0).otherwise(0.0),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(100.0), total / 8.0)


def contributions(df: DataFrame, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """What each factor adds to the weighted score; weights may be overridden singly, must lie in [0, 1] and aren't normalised."""
    w = FACTOR_WEIGHTS | (weights or {})
    if bad := [k for k, x in w.items() if not 0 <= x <= 1 or k not in FACTOR_WEIGHTS]:
        raise ValueError(f"weights out of range or unknown: {bad}")
    f = _features(df)
    one = F.lit(1.0)
    return {
        "TRANSACTION_AMOUNT": F.least(one, f["transaction_amount"] / 1_000_000) * w["TRANSACTION_AMOUNT"],
        "VELOCITY": F.least(one, f["velocity_30d"] / 200) * w["VELOCITY"],
        "GEOGRAPHY": F.when(f["high_risk_country"], w["GEOGRAPHY"]).otherwise(0.0),
        "CUSTOMER_TYPE": _kinds(f["customer_type"], {"correspondent": 1.0, "corporate": 0.4, "retail": 0.1}, 0.2) * w["CUSTOMER_TYPE"],
        "PEP_STATUS": F.when(f["is_pep"], w["PEP_STATUS"]).otherwise(0.0),
        "ADVERSE_MEDIA": F.least(one, f["adverse_media_hits"] / 5) * w["ADVERSE_MEDIA"],
        "NETWORK_CENTRALITY": f["centrality_score"] * w["NETWORK_CENTRALITY"],
        "LAYERING_DETECTED": F.when(f["layering_flag"], w["LAYERING_DETECTED"]).otherwise(0.0),
    }


def weighted_score(df: DataFrame, weights: dict[str, float] | None = None) -> Column:
    """Sum of the contributions in the factors' order, times 100."""
    total = None
    for c in contributions(df, weights).values():
        total = c if total is None else total + c
    return total * 100


def score_entities(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add base_score, weighted_score, risk_level and contributing_factors. The level comes from the score before rounding. A missing or null feature takes its default."""
    exact = weighted_score(df, weights)
    factors = F.create_map(*(x for k, c in contributions(df, weights).items() for x in (F.lit(k), c)))
    return df.withColumns({"base_score": rounded(base_score(df)), "weighted_score": rounded(exact), "risk_level": level(exact), "contributing_factors": factors})


def to_json(df: DataFrame, at: Column | None = None) -> Column:
    """A scored row as a JSON object with two digits, four for the factors, half to even; ``at`` is the time of the scoring, by default now."""
    time = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp")
    factors = F.transform_values("contributing_factors", lambda _, v: F.bround(v, 4)).alias("contributing_factors")
    return F.to_json(F.struct("entity_id", F.bround("base_score", 2).alias("base_score"), F.bround("weighted_score", 2).alias("weighted_score"), "risk_level", factors, time))


def lake_score(amount: Column, velocity: Column, high_risk: Column, kind: Column, pep: Column, structuring: Column, high_value: Column) -> Column:
    """Points of the lake layer, at most 100; nulls count as 0, false or retail."""
    yes = lambda c, points: F.when(c, points).otherwise(0.0)
    total = (
        _steps(F.coalesce(amount.cast("double"), F.lit(0.0)), [(1_000_000, 25), (100_000, 18), (10_000, 10)], 3.0)
        + F.least(F.lit(15.0), F.coalesce(velocity, F.lit(0)) / 200 * 15)
        + yes(high_risk, 15.0)
        + _kinds(F.coalesce(kind, F.lit("retail")), {"correspondent": 10.0, "corporate": 4.0, "retail": 1.0}, 2.0)
        + yes(pep, 15.0)
        + (yes(structuring, 10.0) + yes(high_value, 10.0))
    )
    return rounded(F.least(F.lit(100.0), total))


def at_least(level_column: str, threshold: str = "HIGH") -> Column:
    """Whether a level reaches a threshold; an unknown threshold means HIGH, an unknown level ranks lowest."""
    rank = F.create_map(*(x for k, v in enumerate(LEVELS) for x in (F.lit(v), F.lit(k))))
    return F.coalesce(rank[F.col(level_column)], F.lit(0)) >= (LEVELS.index(threshold) if threshold in LEVELS else 2)
