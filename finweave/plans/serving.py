"""What the dashboard shows: filtered lists, counters and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.constants import LEVELS
from finweave.functions.scoring import rounded
from finweave.plans.adapter import ALERTS_SQL, CASES_SQL, VALID_SQL, alerts, as_of, cases, valid
from finweave.sources.tables import load


def filter_alerts(df: DataFrame, status: str | None = None, alert_type: str | None = None, min_risk: float | None = None) -> DataFrame:
    """Filters that are given hold together; those left out don't restrict."""
    for wanted, test in ((status, F.col("status") == status), (alert_type, F.col("alert_type") == alert_type), (min_risk, F.col("risk_score") >= min_risk)):
        df = df.where(test) if wanted is not None else df
    return df


def filter_transactions(df: DataFrame, flagged: str | None = None, min_amount: float | None = None) -> DataFrame:
    """Only the text ``true`` asks for flagged ones."""
    df = df.where("flagged") if flagged == "true" else df
    return df.where(F.col("amount") >= min_amount) if min_amount is not None else df


def response(df: DataFrame, name: str, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What a request for a list returns: its head (list, total, generatedAt), one row, and each row as JSON. The rows stay distributed; the head is counted from them."""
    time = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt")
    return df.agg(F.lit(name).alias("list"), F.count(F.lit(1)).alias("total")).select("list", "total", time), df.select(F.lit(name).alias("list"), F.to_json(F.struct("*")).alias("row"))


def alerts_response(spark: SparkSession, d: str) -> DataFrame:
    """The head of the list of open alerts above 20, as of the end of the data."""
    return response(alerts_filtered(spark, d), "alerts", as_of())[0]


def alerts_filtered(spark: SparkSession, d: str) -> DataFrame:
    return filter_alerts(alerts(spark, d), status="OPEN", min_risk=20).select("alert_id", "entity_id", "alert_type", "risk_score", "status", "created_at")


def transactions_filtered(spark: SparkSession, d: str) -> DataFrame:
    return filter_transactions(valid(spark, d, "currency"), flagged="true", min_amount=1000).select("transaction_id", "source_account_id", "destination_account_id", "amount", "currency", "transaction_timestamp")


def top_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Five alerts above 70, by id."""
    return alerts(spark, d).where("risk_score > 70").orderBy("alert_id").limit(5).select("alert_id", "entity_id", "alert_type", "risk_score", "status")


def alerts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Alerts a type with their share of all; the total is one row."""
    n = alerts(spark, d).groupBy("alert_type").agg(F.count(F.lit(1)).alias("alert_count"), F.lit(1).alias("one"))
    total = n.groupBy("one").agg(F.sum("alert_count").alias("total"))
    return n.join(F.broadcast(total), "one").select("alert_type", "alert_count", rounded(F.col("alert_count") / F.col("total"), 4).alias("share"))


def alert_trend(spark: SparkSession, d: str) -> DataFrame:
    """Alerts a day, and the height of their bar of at most 80, at least 4."""
    day = F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd")
    n = alerts(spark, d).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("alert_count")).withColumn("one", F.lit(1))
    top = n.groupBy("one").agg(F.max("alert_count").alias("top"))
    return n.join(F.broadcast(top), "one").select("day", "alert_count", F.greatest(F.lit(4.0), rounded(F.col("alert_count") / F.col("top") * 80, 4)).alias("bar"))


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the scoring history a level; levels without rows come out with 0."""
    counted = load(spark, d, "risk_scores_history").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    levels = spark.createDataFrame([(x,) for x in LEVELS], "risk_level string")
    return levels.join(counted, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def kpis(spark: SparkSession, d: str) -> DataFrame:
    """One row of counters over the tables, each from one aggregation."""
    one = F.lit(1).alias("one")
    parts = [
        alerts(spark, d).agg(F.count(F.lit(1)).alias("total_alerts"), F.count_if(F.col("status") == "OPEN").alias("open_alerts"), rounded(F.avg("risk_score").cast("double"), 2).alias("avg_risk_score"), one),
        load(spark, d, "entities").agg(F.count_if(F.col("risk_score") >= 80).alias("critical_entities"), one),
        valid(spark, d).agg(F.count(F.lit(1)).alias("transactions_monitored"), F.sum(F.when(F.col("flagged"), F.col("amount"))).cast("decimal(38,4)").alias("total_value_flagged"), one),
        cases(spark, d).agg(F.count_if(F.col("status").isin("IN_PROGRESS", "PENDING_INFO")).alias("cases_under_review"), F.count_if(F.col("status") == "CLOSED_SAR").alias("sars_filed"), one),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "one")
    return out.drop("one")


def scaled_scores(spark: SparkSession, d: str) -> DataFrame:
    """Entities' scores scaled to [0, 1] between the least and the greatest."""
    e = load(spark, d, "entities").select("entity_id", F.col("risk_score").cast("double").alias("x"), F.lit(1).alias("one"))
    ends = e.groupBy("one").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return e.join(F.broadcast(ends), "one").select("entity_id", F.when(F.col("high") > F.col("low"), rounded((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")), 6)).otherwise(0.0).alias("scaled"))


QUERIES = {f.__name__: f for f in (alerts_filtered, alerts_response, transactions_filtered, top_alerts, alerts_by_type, alert_trend, level_counts, kpis, scaled_scores)}

SQL = {
    "alerts_response": f"WITH {ALERTS_SQL} SELECT 'alerts' AS list, count(*) AS total, '2025-07-01T00:00:00.000Z' AS \"generatedAt\" FROM alerts WHERE status = 'OPEN' AND risk_score >= 20",
    "alerts_filtered": f"WITH {ALERTS_SQL} SELECT alert_id, entity_id, alert_type, risk_score, status, created_at FROM alerts WHERE status = 'OPEN' AND risk_score >= 20",
    "transactions_filtered": f"WITH {VALID_SQL} SELECT transaction_id, source_account_id, destination_account_id, amount, currency, transaction_timestamp FROM valid WHERE flagged AND amount >= 1000",
    "top_alerts": f"WITH {ALERTS_SQL} SELECT alert_id, entity_id, alert_type, risk_score, status FROM alerts WHERE risk_score > 70 ORDER BY alert_id LIMIT 5",
    "alerts_by_type": f"WITH {ALERTS_SQL}, n AS (SELECT alert_type, count(*) AS alert_count FROM alerts GROUP BY alert_type) SELECT alert_type, alert_count, floor(alert_count / CAST((SELECT sum(alert_count) FROM n) AS DOUBLE) * 10000 + 0.5) / 10000 AS share FROM n",
    "alert_trend": f"WITH {ALERTS_SQL}, n AS (SELECT strftime(timezone('UTC', created_at), '%Y-%m-%d') AS day, count(*) AS alert_count FROM alerts GROUP BY 1) SELECT day, alert_count, greatest(4.0::DOUBLE, floor(alert_count / CAST((SELECT max(alert_count) FROM n) AS DOUBLE) * 80 * 10000 + 0.5) / 10000) AS bar FROM n",
    "level_counts": "SELECT l.risk_level, count(h.risk_level) AS n FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) l(risk_level) LEFT JOIN risk_scores_history h ON h.risk_level = l.risk_level GROUP BY l.risk_level",
    "kpis": f"""WITH {CASES_SQL}, a AS (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE status = 'OPEN') AS open_alerts, floor(CAST(sum(risk_score) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_risk_score FROM alerts),
b AS (SELECT count(*) FILTER (WHERE risk_score >= 80) AS critical_entities FROM entities), c AS (SELECT count(*) AS transactions_monitored, CAST(sum(amount) FILTER (WHERE flagged) AS DECIMAL(38,4)) AS total_value_flagged FROM valid),
k AS (SELECT count(*) FILTER (WHERE status IN ('IN_PROGRESS', 'PENDING_INFO')) AS cases_under_review, count(*) FILTER (WHERE status = 'CLOSED_SAR') AS sars_filed FROM cases) SELECT * FROM a, b, c, k""",
    "scaled_scores": "WITH e AS (SELECT entity_id, CAST(risk_score AS DOUBLE) AS x FROM entities), r AS (SELECT min(x) AS low, max(x) AS high FROM e) SELECT entity_id, CASE WHEN high > low THEN floor((x - low) / (high - low) * 1000000 + 0.5) / 1000000 ELSE 0.0::DOUBLE END AS scaled FROM e, r",
}
