"""Record pipeline: normalise, check, flag, enrich and score, in the variants of the three layers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.constants import ACCOUNT_PATTERN, CURRENCIES, HIGH_RISK_COUNTRIES
from finweave.functions import rules, scoring
from finweave.operators.running import trailing_count
from finweave.operators.standing import standing_rows
from finweave.plans.adapter import NOW, RECORDS_SQL, VALID_SQL, records, valid
from finweave.sources.tables import load

AT = datetime(2025, 7, 1, tzinfo=timezone.utc)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Records of the record layer: text times, amounts as doubles."""
    return records(spark, d).withColumns({"amount": F.col("amount").cast("double"), "timestamp": F.date_format("transaction_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")}).drop("transaction_timestamp")


def normalize_l1(spark: SparkSession, d: str) -> DataFrame:
    """Records whose fields carry other names, brought to the canonical ones."""
    r = records(spark, d).select(F.col("transaction_id").alias("txn_id"), F.col("source_account").alias("src_acct"), F.col("destination_account").alias("dst_account"), F.col("amount").cast("string").alias("amt"), F.concat(F.lit(" "), "currency", F.lit("\t")).alias("ccy"), F.col("transaction_type").alias("txn_type"))
    return rules.normalize_record(r).select("transaction_id", "source_account", "destination_account", "amount", "currency", "transaction_type")


def normalize_l2(spark: SparkSession, d: str) -> DataFrame:
    return rules.normalize_ingested(records(spark, d)).select("transaction_id", "source_account", "destination_account", "currency", "transaction_type", "flagged")


def normalize_lake(spark: SparkSession, d: str) -> DataFrame:
    return rules.normalize_lake(records(spark, d)).select("transaction_id", "source_account", "destination_account", "currency", "transaction_type", "is_pep", "flagged")


FLAGS = ["flag_high_value", "flag_structuring_indicator", "flag_round_amount", "flag_cross_border", "flag_high_risk_country"]


def flags_l1(spark: SparkSession, d: str) -> DataFrame:
    return rules.record_flags(records(spark, d)).select("transaction_id", *FLAGS)


def flags_lake(spark: SparkSession, d: str) -> DataFrame:
    return rules.lake_flags(records(spark, d)).select("transaction_id", *FLAGS)


def tiers_l2(spark: SparkSession, d: str) -> DataFrame:
    return rules.risk_tiers(records(spark, d)).select("transaction_id", "amount", "risk_score", "flagged")


def structuring_boost(spark: SparkSession, d: str) -> DataFrame:
    return rules.structuring_boost(records(spark, d)).select("transaction_id", "amount", "risk_score", "flagged")


def dq_report_l1(spark: SparkSession, d: str) -> DataFrame:
    """Every rule's verdict on every record."""
    report = rules.validate(_raw(spark, d), rules.standard_rules(AT))
    return report.select("transaction_id", "quality_score", F.explode("results").alias("r")).select("transaction_id", "quality_score", "r.rule_id", "r.severity", "r.passed", "r.message", "r.field_path")


def dq_violations_l2(spark: SparkSession, d: str) -> DataFrame:
    return rules.ingestion_violations(rules.normalize_ingested(records(spark, d))).select("transaction_id", F.size("violations").alias("n_violations"), F.array_join("violations", "; ").alias("violations"))


def _lake(spark: SparkSession, d: str) -> DataFrame:
    return rules.lake_flags(rules.lake_quality(rules.normalize_lake(records(spark, d)), AT))


def dq_score_lake(spark: SparkSession, d: str) -> DataFrame:
    return _lake(spark, d).select("transaction_id", *(c for c in _lake(spark, d).columns if c.startswith("dq_") and c != "dq_score"), scoring.rounded(F.col("dq_score")).alias("dq_score"))


def silver(spark: SparkSession, d: str) -> DataFrame:
    return rules.split(_lake(spark, d))[0].select("transaction_id", "source_account", "destination_account", "amount", "currency")


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return rules.split(_lake(spark, d))[1].select("transaction_id", "source_account", "destination_account", "amount", "currency")


def quarantine_safe(spark: SparkSession, d: str) -> DataFrame:
    """With the rows that three-valued logic would lose."""
    return rules.split(_lake(spark, d), safe=True)[1].select("transaction_id", "source_account", "destination_account", "amount", "currency")


def summarise(report: DataFrame, top: int = 5) -> DataFrame:
    """One row: total_records, pass_rate (records without any failure), avg_quality_score, common_failures (rule ids, most frequent first, then in order of the rules)."""
    failed = F.filter("results", lambda r: ~r["passed"])
    totals = report.agg(
        F.count(F.lit(1)).alias("total_records"), F.coalesce(scoring.rounded(F.avg((F.size(failed) == 0).cast("double")), 4), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(scoring.rounded(F.avg("quality_score"), 2), F.lit(0.0)).alias("avg_quality_score"), F.lit(1).alias("one"),
    )
    often = report.select(F.explode(failed).alias("r")).groupBy("r.rule_id").count().orderBy(F.col("count").desc(), "rule_id").limit(top)  # a few rules
    names = often.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "rule_id"))), lambda x: x["rule_id"]), ",").alias("common_failures"), F.lit(1).alias("one"))
    return totals.join(F.broadcast(names), "one").drop("one")


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return summarise(rules.validate(_raw(spark, d), rules.standard_rules(AT)))


def velocity_30d(spark: SparkSession, d: str) -> DataFrame:
    """Of each standing transaction, those of its source account in the 30 days up to it."""
    return trailing_count(valid(spark, d), "source_account_id", "transaction_timestamp", "transaction_id").withColumnRenamed("n", "velocity_30d")


def _features(spark: SparkSession, d: str) -> DataFrame:
    v = velocity_30d(spark, d).select("transaction_id", "velocity_30d")
    rows = standing_rows(load(spark, d, "transactions"), "transaction_id", "created_at", ["transaction_id", "source_account_id", "destination_account_id", "amount", "currency", "transaction_timestamp", "transaction_type", "risk_score", "flagged"])
    r = rules.record_flags(records(spark, d, rows)).select(
        "transaction_id", F.col("amount").cast("double").alias("transaction_amount"), F.col("flag_high_risk_country").alias("high_risk_country"), "customer_type", "is_pep"
    )
    return r.join(v, "transaction_id", "left")


def score_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted and base score of every transaction, of the delivery that stands."""
    return scoring.score_entities(_features(spark, d)).select("transaction_id", "base_score", "weighted_score", "risk_level")


def lake_scored(df: DataFrame) -> DataFrame:
    """Silver rows with the lake score, its level and the automatic flag; velocity_30d is 0 where the column is missing."""
    velocity = F.col("velocity_30d") if "velocity_30d" in df.columns else F.lit(0)
    score = scoring.lake_score(F.col("amount"), velocity, F.coalesce("flag_high_risk_country", F.lit(False)), F.col("customer_type"), F.coalesce("is_pep", F.lit(False)), F.coalesce("flag_structuring_indicator", F.lit(False)), F.coalesce("flag_high_value", F.lit(False)))
    return df.withColumn("risk_score", score).withColumn("risk_level", scoring.level(F.col("risk_score"), "LOW")).withColumn("flagged", F.coalesce("flagged", F.lit(False)) | F.col("risk_level").isin("HIGH", "CRITICAL"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return lake_scored(rules.split(_lake(spark, d))[0])


def score_lake(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("transaction_id", "amount", "risk_score", "risk_level", "flagged")


def level_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def history_latest(spark: SparkSession, d: str) -> DataFrame:
    """Per source account the highest score and the level that goes with it, as rows for the scoring history."""
    return _scored(spark, d).groupBy("source_account").agg(F.max("risk_score").alias("score"), F.max_by("risk_level", "risk_score").alias("risk_level")).select(F.col("source_account").alias("entity_id"), "score", "risk_level", F.lit("{}").alias("contributing_factors"))


def high_risk_entities(spark: SparkSession, d: str) -> DataFrame:
    """Scores in the history at HIGH or above."""
    h = load(spark, d, "risk_scores_history").select("entity_id", F.col("score").alias("weighted_score"), "risk_level").distinct()
    return h.where(scoring.at_least("risk_level")).orderBy(F.col("weighted_score").desc(), "entity_id")


def pipeline(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Six stages in one projection: record_id, stage, is_valid, quality_score, errors, transformed fields, entity_context, risk_score, risk_level.

    Records are checked before their fields are renamed; those with errors stay at VALIDATION without flags or scores.
    """
    checked = rules.validate(raw, rules.standard_rules(as_of)).withColumn("is_valid", F.size("errors") == 0)
    ids = [F.col(c) for c in ("transaction_id", "id") if c in raw.columns]
    carried = checked.withColumn("record_id", F.coalesce(*ids, F.expr("uuid()")))
    held = ["record_id", "is_valid", "quality_score", "errors"]
    done = rules.record_flags(rules.normalize_record(carried.drop("results")))
    kind, pep = F.coalesce("customer_type", F.lit("retail")), F.coalesce("is_pep", F.lit(False))
    context = F.struct(F.col("source_account").alias("entity_id"), F.col("source_account").alias("name"), pep.alias("pep_flag"), F.lit(0.0).alias("risk_score"), F.coalesce("source_country", F.lit("")).alias("country"), kind.alias("customer_type"))
    scored = scoring.score_entities(done.withColumns({"transaction_amount": F.col("amount"), "high_risk_country": F.col("flag_high_risk_country")}))
    keep = lambda c, n: F.when(F.col("is_valid"), c).alias(n)
    return scored.select(
        *held, F.when(F.col("is_valid"), "OUTPUT").otherwise("VALIDATION").alias("stage"), "transaction_id", "source_account", "destination_account", "amount", "currency", "transaction_type",
        *(keep(F.col(f), f) for f in FLAGS), keep(context, "entity_context"), keep(F.col("weighted_score"), "risk_score"), keep(F.col("risk_level"), "risk_level"),
    )


def pipeline_records(spark: SparkSession, d: str) -> DataFrame:
    out = pipeline(_raw(spark, d).drop("risk_score"), AT)
    return out.select("record_id", "stage", "is_valid", "quality_score", F.array_join("errors", "; ").alias("errors"), "risk_score", "risk_level", *FLAGS)


def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the six stages from one aggregation."""
    ok = F.count_if("is_valid")
    return pipeline(_raw(spark, d).drop("risk_score"), AT).agg(
        F.count(F.lit(1)).alias("total_records"), F.count(F.lit(1)).alias("ingested"), ok.alias("validated"), F.count_if(~F.col("is_valid")).alias("validation_failed"), ok.alias("transformed"), ok.alias("enriched"),
        F.count_if(F.col("risk_score").isNotNull()).alias("scored"), F.count_if(F.col("stage") == "OUTPUT").alias("output"),
    )


def timed(stats: Callable[[], DataFrame]) -> dict:
    """The counters of a run with errors (none: they stay with their records), start_time, end_time and duration_seconds with four digits."""
    start, clock = datetime.now(timezone.utc), time.perf_counter()
    row = stats().first().asDict()
    return row | {"errors": [], "start_time": start.isoformat(), "end_time": datetime.now(timezone.utc).isoformat(), "duration_seconds": round(time.perf_counter() - clock, 4)}


@dataclass
class Totals:
    """Counters of the ingestion layer over all its runs, and how long the last one took."""

    counters: dict[str, int] = field(default_factory=dict)
    last_run_duration_ms: int = 0

    def add(self, stats: Callable[[], DataFrame]) -> dict[str, int]:
        clock = time.perf_counter()
        for k, n in stats().first().asDict().items():
            self.counters[k] = self.counters.get(k, 0) + n
        self.last_run_duration_ms = int((time.perf_counter() - clock) * 1000)
        return self.counters | {"last_run_duration_ms": self.last_run_duration_ms}


def ingest(df: DataFrame) -> DataFrame:
    """Ingestion layer in its order: normalise, tier, check."""
    return rules.ingestion_violations(rules.risk_tiers(rules.normalize_ingested(df)))


def ingestion_stats(spark: SparkSession, d: str) -> DataFrame:
    bad = F.size("violations") > 0
    return ingest(records(spark, d)).agg(F.count(F.lit(1)).alias("total_received"), F.count(F.lit(1)).alias("total_normalised"), F.count(F.lit(1)).alias("total_enriched"), F.count_if(~bad).alias("total_processed"), F.count_if(bad).alias("total_quarantined"), F.count_if(~bad).alias("total_output"), F.count_if(~bad & F.col("flagged")).alias("total_flagged"))


def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered transaction with the context of the entity that owns its source account."""
    accounts = load(spark, d, "accounts").select("account_id", "entity_id", F.col("country_code").alias("country"))
    owners = load(spark, d, "entities").select(F.col("entity_id").alias("owner"), "name", "pep_flag", "risk_score", F.when(F.col("entity_type") == "CORPORATE", "corporate").alias("customer_type"))
    by_account = accounts.join(owners, F.col("entity_id") == F.col("owner")).select(F.col("account_id").alias("entity_id"), "name", "pep_flag", "risk_score", "country", "customer_type")
    rows = load(spark, d, "transactions").select("transaction_id", "source_account_id")
    return rules.enrich_with_entity(rows, by_account, "source_account_id").select("transaction_id", "source_account_id", *(F.col(f"entity_context.{c}").alias(f"context_{c}") for c in ("name", "pep_flag", "risk_score", "country", "customer_type")))


QUERIES = {f.__name__: f for f in (
    enriched_records,
    normalize_l1, normalize_l2, normalize_lake, flags_l1, flags_lake, tiers_l2, structuring_boost, dq_report_l1, dq_violations_l2, dq_score_lake, silver, quarantine, quarantine_safe, quality_summary,
    velocity_30d, score_weighted, score_lake, level_distribution, history_latest, high_risk_entities, pipeline_records, pipeline_stats, ingestion_stats,
)}

_R = f"WITH {RECORDS_SQL}"
_HIGH = ", ".join(f"'{c}'" for c in HIGH_RISK_COUNTRIES)
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_L1_FLAGS = f"""coalesce(CAST(amount AS DOUBLE), 0) >= 10000 AS flag_high_value, coalesce(CAST(amount AS DOUBLE), 0) >= 9000 AND coalesce(CAST(amount AS DOUBLE), 0) < 10000 AS flag_structuring_indicator,
coalesce(CAST(amount AS DOUBLE), 0) > 0 AND coalesce(CAST(amount AS DOUBLE), 0) % 1000 = 0 AS flag_round_amount,
upper(coalesce(source_country, '')) <> '' AND upper(coalesce(destination_country, '')) <> '' AND upper(coalesce(source_country, '')) <> upper(coalesce(destination_country, '')) AS flag_cross_border,
upper(coalesce(source_country, '')) IN ({_HIGH}) OR upper(coalesce(destination_country, '')) IN ({_HIGH}) AS flag_high_risk_country"""
_LAKE_FLAGS = f"""amount >= 10000 AS flag_high_value, amount >= 9000 AND amount < 10000 AS flag_structuring_indicator, amount > 0 AND amount % 1000 = 0 AS flag_round_amount,
source_country IS NOT NULL AND destination_country IS NOT NULL AND source_country <> destination_country AS flag_cross_border, source_country IN ({_HIGH}) OR destination_country IN ({_HIGH}) AS flag_high_risk_country"""
_LAKE = f"""{RECORDS_SQL}, lake AS (SELECT transaction_id, trim(source_account) AS source_account, trim(destination_account) AS destination_account, amount, trim(upper(currency)) AS currency, transaction_timestamp,
upper(coalesce(transaction_type, 'UNKNOWN')) AS transaction_type, source_country, destination_country, customer_type, coalesce(is_pep, false) AS is_pep, coalesce(flagged, false) AS flagged FROM records),
checked AS (SELECT *, {_LAKE_FLAGS}, transaction_id IS NOT NULL AS dq_not_null_transaction_id, amount IS NOT NULL AS dq_not_null_amount, amount > 0 AS dq_positive_amount, source_account IS NOT NULL AS dq_not_null_source_account,
destination_account IS NOT NULL AS dq_not_null_dest_account, length(currency) = 3 AS dq_valid_currency, transaction_timestamp <= {NOW} AS dq_timestamp_not_future, amount < 10000000 AS dq_amount_within_limit,
source_account <> destination_account AS dq_no_self_transfer FROM lake)"""
_DQ = ["dq_not_null_transaction_id", "dq_not_null_amount", "dq_positive_amount", "dq_not_null_source_account", "dq_not_null_dest_account", "dq_valid_currency", "dq_timestamp_not_future", "dq_amount_within_limit", "dq_no_self_transfer"]
_GOOD = "dq_not_null_transaction_id AND dq_not_null_amount AND dq_positive_amount AND dq_no_self_transfer"
_ROW = "transaction_id, source_account, destination_account, amount, currency"
_CODES = ", ".join(f"'{c}'" for c in CURRENCIES)
_MESSAGES = [(r.rule_id, r.severity, r.field, r.description) for r in rules.standard_rules(AT)]
_CHECKS = [
    "coalesce(trim(transaction_id) <> '', false)", "amount IS NOT NULL", "coalesce(trim(source_account) <> '', false)", "coalesce(trim(destination_account) <> '', false)", "transaction_timestamp IS NOT NULL",
    "coalesce(amount > 0, false)", f"coalesce(upper(currency) IN ({_CODES}), false)", f"coalesce(date_trunc('second', transaction_timestamp) <= {NOW}, false)", "coalesce(amount <= 10000000, false)",
    f"(coalesce(source_account, '') = '' OR regexp_matches(source_account, '{ACCOUNT_PATTERN}')) AND (coalesce(destination_account, '') = '' OR regexp_matches(destination_account, '{ACCOUNT_PATTERN}'))",
]
_VERDICTS = f"{RECORDS_SQL}, verdicts AS (SELECT *, row_number() OVER () AS n, " + ", ".join(f"{c} AS p{k}" for k, c in enumerate(_CHECKS)) + " FROM records)"
_PASSED = " + ".join(f"CAST(p{k} AS INTEGER)" for k in range(10))
_SCORE = f"floor(({_PASSED}) * 10000 / 10.0 + 0.5) / 100"
_LONG = f"{_VERDICTS}, long AS (" + " UNION ALL ".join(
    f"SELECT n, transaction_id, {_SCORE} AS quality_score, '{i}' AS rule_id, '{s}' AS severity, p{k} AS passed, CASE WHEN p{k} THEN 'OK' ELSE 'Failed: {t}' END AS message, '{f}' AS field_path FROM verdicts" for k, (i, s, f, t) in enumerate(_MESSAGES)
) + ")"
_ERRORS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT p{k} THEN '[{i}] Failed: {t} (field={f})' END" for k, (i, s, f, t) in enumerate(_MESSAGES) if s == "ERROR") + "], lambda x: x IS NOT NULL), '; ')"
_OK = " AND ".join(f"p{k}" for k, (_, s, _, _) in enumerate(_MESSAGES) if s == "ERROR")
_KIND = "CASE lower(customer_type) WHEN 'correspondent' THEN {} WHEN 'corporate' THEN {} WHEN 'retail' THEN {} ELSE {} END"


def _weighted(amount: str, velocity: str, geo: str, pep: str) -> str:
    return f"""((least(1.0::DOUBLE, {amount} / 1000000) * 0.2::DOUBLE + least(1.0::DOUBLE, CAST({velocity} AS DOUBLE) / 200) * 0.15::DOUBLE + CASE WHEN {geo} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
+ {_KIND.format('1.0::DOUBLE', '0.4::DOUBLE', '0.1::DOUBLE', '0.2::DOUBLE')} * 0.1::DOUBLE + CASE WHEN {pep} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + 0.0::DOUBLE + 0.0::DOUBLE + 0.0::DOUBLE) * 100)"""


_LEVEL = "CASE WHEN {0} >= 80 THEN 'CRITICAL' WHEN {0} >= 60 THEN 'HIGH' WHEN {0} >= 30 THEN 'MEDIUM' ELSE 'LOW' END"
_VELOCITY = """counted AS (SELECT transaction_id, source_account_id, transaction_timestamp, count(*) OVER (PARTITION BY source_account_id ORDER BY transaction_timestamp
RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS velocity_30d FROM valid)"""
_STANDING = ", ".join(f"{c} DESC NULLS LAST" for c in ("created_at", "source_account_id", "destination_account_id", "amount", "currency", "transaction_timestamp", "transaction_type", "risk_score", "flagged"))
_FEATURES = f"""{VALID_SQL}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {_STANDING}) AS rn FROM transactions WHERE transaction_id IS NOT NULL) WHERE rn = 1),
{RECORDS_SQL.replace('FROM transactions t', 'FROM latest t')}, {_VELOCITY}, flags AS (SELECT *, {_L1_FLAGS} FROM records), f AS (SELECT transaction_id, coalesce(CAST(amount AS DOUBLE), 0) AS amount, flag_high_risk_country AS geo,
customer_type, coalesce(is_pep, false) AS pep FROM flags),
g AS (SELECT f.*, coalesce(c.velocity_30d, 0) AS v FROM f LEFT JOIN counted c ON c.transaction_id = f.transaction_id)"""
_BASE = f"""least(100.0::DOUBLE, (CASE WHEN amount >= 1000000 THEN 100 WHEN amount >= 100000 THEN 75 WHEN amount >= 50000 THEN 55 WHEN amount >= 10000 THEN 35 WHEN amount >= 5000 THEN 15 ELSE 5 END
+ CASE WHEN v >= 200 THEN 100 WHEN v >= 100 THEN 70 WHEN v >= 50 THEN 45 WHEN v >= 20 THEN 25 ELSE v * 0.5::DOUBLE END + CASE WHEN geo THEN 100 ELSE 0 END + {_KIND.format(80, 40, 10, 20)} + CASE WHEN pep THEN 100 ELSE 0 END) / 8.0::DOUBLE)"""
_POINTS = f"""floor(least(100.0::DOUBLE, CASE WHEN amount >= 1000000 THEN 25 WHEN amount >= 100000 THEN 18 WHEN amount >= 10000 THEN 10 ELSE 3 END + CASE WHEN coalesce(flag_high_risk_country, false) THEN 15 ELSE 0 END
+ {_KIND.format(10, 4, 1, 2)} + CASE WHEN is_pep THEN 15 ELSE 0 END + CASE WHEN coalesce(flag_structuring_indicator, false) THEN 10 ELSE 0 END + CASE WHEN coalesce(flag_high_value, false) THEN 10 ELSE 0 END) * 10000 + 0.5) / 10000"""
_SCORED = f"{_LAKE}, points AS (SELECT *, {_POINTS} AS points FROM checked WHERE {_GOOD}), scored AS (SELECT *, points AS risk_score, {_LEVEL.format('points')} AS risk_level FROM points)"
_STRIPPED = {c: _TRIM.format(c) for c in ("transaction_id", "source_account", "destination_account", "currency", "transaction_type")}

SQL = {
    "normalize_l1": f"{_R} SELECT {_STRIPPED['transaction_id']} AS transaction_id, {_STRIPPED['source_account']} AS source_account, {_STRIPPED['destination_account']} AS destination_account, CAST(amount AS DOUBLE) AS amount, upper({_STRIPPED['currency']}) AS currency, coalesce(nullif({_STRIPPED['transaction_type']}, ''), 'UNKNOWN') AS transaction_type FROM records",
    "normalize_l2": f"{_R} SELECT {_STRIPPED['transaction_id']} AS transaction_id, {_STRIPPED['source_account']} AS source_account, {_STRIPPED['destination_account']} AS destination_account, upper({_STRIPPED['currency']}) AS currency, upper({_STRIPPED['transaction_type']}) AS transaction_type, coalesce(flagged, false) AS flagged FROM records",
    "normalize_lake": f"WITH {_LAKE} SELECT transaction_id, source_account, destination_account, currency, transaction_type, is_pep, flagged FROM lake",
    "flags_l1": f"{_R} SELECT transaction_id, {_L1_FLAGS} FROM records",
    "flags_lake": f"{_R} SELECT transaction_id, {_LAKE_FLAGS} FROM records",
    "tiers_l2": f"{_R} SELECT transaction_id, amount, CAST(CASE WHEN amount IS NULL THEN 0 WHEN amount >= 1000000 THEN 90 WHEN amount >= 500000 THEN 75 WHEN amount >= 50000 THEN 60 WHEN amount >= 10000 THEN 40 WHEN amount >= 9000 THEN 30 ELSE 10 END AS DOUBLE) AS risk_score, CASE WHEN amount >= 10000 THEN true ELSE flagged END AS flagged FROM records",
    "structuring_boost": f"{_R} SELECT transaction_id, amount, CASE WHEN risk_score IS NULL THEN 50.0::DOUBLE ELSE least(100.0::DOUBLE, CAST(risk_score AS DOUBLE) + 20) END AS risk_score, true AS flagged FROM records WHERE amount >= 9000 AND amount < 10000",
    "dq_report_l1": f"WITH {_LONG} SELECT transaction_id, quality_score, rule_id, severity, passed, message, field_path FROM long",
    "dq_violations_l2": f"""WITH {RECORDS_SQL}, n AS (SELECT {_STRIPPED['transaction_id']} AS transaction_id, {_STRIPPED['source_account']} AS source_account, {_STRIPPED['destination_account']} AS destination_account, upper({_STRIPPED['currency']}) AS currency, amount, transaction_timestamp FROM records),
v AS (SELECT transaction_id, list_filter([CASE WHEN coalesce(transaction_id, '') = '' THEN 'VIOLATION: transaction_id is null or blank' END,
CASE WHEN amount IS NULL THEN 'VIOLATION: amount is null' WHEN amount <= 0 THEN 'VIOLATION: amount must be positive, got ' || CAST(amount AS VARCHAR) END, CASE WHEN coalesce(source_account, '') = '' THEN 'VIOLATION: source_account is null or blank' END,
CASE WHEN coalesce(destination_account, '') = '' THEN 'VIOLATION: destination_account is null or blank' END, CASE WHEN coalesce(length(currency), 0) <> 3 THEN 'VIOLATION: currency must be a 3-character ISO code, got ''' || coalesce(currency, 'null') || '''' END,
CASE WHEN transaction_timestamp IS NULL THEN 'VIOLATION: timestamp is null' END, CASE WHEN lower(source_account) = lower(destination_account) THEN 'VIOLATION: source_account and destination_account must differ' END], lambda x: x IS NOT NULL) AS v FROM n)
SELECT transaction_id, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, '; ') AS violations FROM v""",
    "dq_score_lake": f"WITH {_LAKE} SELECT transaction_id, {', '.join(_DQ)}, floor(({' + '.join(f'CAST({c} AS INTEGER)' for c in _DQ)}) / 9.0::DOUBLE * 100 * 10000 + 0.5) / 10000 AS dq_score FROM checked",
    "silver": f"WITH {_LAKE} SELECT {_ROW} FROM checked WHERE {_GOOD}",
    "quarantine": f"WITH {_LAKE} SELECT {_ROW} FROM checked WHERE NOT ({_GOOD})",
    "quarantine_safe": f"WITH {_LAKE} SELECT {_ROW} FROM checked WHERE NOT coalesce({_GOOD}, false)",
    "quality_summary": f"""WITH {_LONG}, per AS (SELECT n, bool_and(passed) AS clean, max(quality_score) AS q FROM long GROUP BY n), often AS (SELECT rule_id, count(*) AS c FROM long WHERE NOT passed GROUP BY rule_id ORDER BY c DESC, rule_id LIMIT 5)
SELECT count(*) AS total_records, floor(avg(CAST(clean AS INTEGER)) * 10000 + 0.5) / 10000 AS pass_rate, floor(avg(q) * 100 + 0.5) / 100 AS avg_quality_score, (SELECT string_agg(rule_id, ',' ORDER BY c DESC, rule_id) FROM often) AS common_failures FROM per""",
    "velocity_30d": f"WITH {VALID_SQL}, {_VELOCITY} SELECT transaction_id, source_account_id, transaction_timestamp, velocity_30d FROM counted",
    "score_weighted": f"WITH {_FEATURES}, s AS (SELECT transaction_id, {_BASE} AS b, {_weighted('amount', 'v', 'geo', 'pep')} AS w FROM g) SELECT transaction_id, floor(b * 10000 + 0.5) / 10000 AS base_score, floor(w * 10000 + 0.5) / 10000 AS weighted_score, {_LEVEL.format('w')} AS risk_level FROM s",
    "score_lake": f"WITH {_SCORED} SELECT transaction_id, amount, risk_score, risk_level, flagged OR risk_level IN ('HIGH', 'CRITICAL') AS flagged FROM scored",
    "level_distribution": f"WITH {_SCORED} SELECT risk_level, count(*) AS n FROM scored GROUP BY risk_level",
    "history_latest": f"WITH {_SCORED} SELECT source_account AS entity_id, max(risk_score) AS score, {_LEVEL.format('max(risk_score)')} AS risk_level, '{{}}' AS contributing_factors FROM scored GROUP BY source_account",
    "high_risk_entities": "SELECT DISTINCT entity_id, score AS weighted_score, risk_level FROM risk_scores_history WHERE risk_level IN ('HIGH', 'CRITICAL')",
    "pipeline_records": f"""WITH {_VERDICTS}, q AS (SELECT *, {_OK} AS ok, {_SCORE} AS quality_score, {_ERRORS} AS errors, {_L1_FLAGS} FROM (SELECT * REPLACE ({_TRIM.format('source_country')} AS source_country, {_TRIM.format('destination_country')} AS destination_country) FROM verdicts)), w AS (SELECT *, {_weighted('CAST(amount AS DOUBLE)', '0', 'flag_high_risk_country', 'coalesce(is_pep, false)')} AS w FROM q)
SELECT transaction_id AS record_id, CASE WHEN ok THEN 'OUTPUT' ELSE 'VALIDATION' END AS stage, ok AS is_valid, quality_score, errors, CASE WHEN ok THEN floor(w * 10000 + 0.5) / 10000 END AS risk_score, CASE WHEN ok THEN {_LEVEL.format('w')} END AS risk_level,
{', '.join(f'CASE WHEN ok THEN {f} END AS {f}' for f in FLAGS)} FROM w""",
    "pipeline_stats": f"""WITH {_VERDICTS}, q AS (SELECT {_OK} AS ok FROM verdicts) SELECT count(*) AS total_records, count(*) AS ingested, count(*) FILTER (WHERE ok) AS validated, count(*) FILTER (WHERE NOT ok) AS validation_failed, count(*) FILTER (WHERE ok) AS transformed,
count(*) FILTER (WHERE ok) AS enriched, count(*) FILTER (WHERE ok) AS scored, count(*) FILTER (WHERE ok) AS output FROM q""",
}
SQL["enriched_records"] = """SELECT t.transaction_id, t.source_account_id, e.name AS context_name, coalesce(e.pep_flag, false) AS context_pep_flag, coalesce(CAST(e.risk_score AS DOUBLE), 0.0) AS context_risk_score,
CASE WHEN e.entity_id IS NOT NULL THEN a.country_code END AS context_country, CASE WHEN e.entity_type = 'CORPORATE' THEN 'corporate' ELSE 'retail' END AS context_customer_type
FROM transactions t LEFT JOIN accounts a ON a.account_id = t.source_account_id LEFT JOIN entities e ON e.entity_id = a.entity_id"""
SQL["ingestion_stats"] = SQL["dq_violations_l2"].split("SELECT transaction_id, CAST(len(v)")[0].replace("amount, transaction_timestamp FROM records)", "amount, transaction_timestamp, CASE WHEN amount >= 10000 THEN true ELSE coalesce(flagged, false) END AS flagged FROM records)").replace("v AS (SELECT transaction_id, list_filter", "v AS (SELECT transaction_id, flagged, list_filter") + """
SELECT count(*) AS total_received, count(*) AS total_normalised, count(*) AS total_enriched, count(*) FILTER (WHERE len(v) = 0) AS total_processed, count(*) FILTER (WHERE len(v) = 0) AS total_output, count(*) FILTER (WHERE len(v) > 0) AS total_quarantined, count(*) FILTER (WHERE len(v) = 0 AND flagged) AS total_flagged FROM v"""
