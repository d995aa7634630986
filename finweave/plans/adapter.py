"""Tables the platform's queries run on: real ones, and alerts and cases derived from flagged transactions. Each has its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.constants import ALERT_STATUSES, ALERT_TYPES, CASE_STATUSES, PRIORITIES
from finweave.operators.standing import standing_rows
from finweave.session import attach
from finweave.sources.tables import load

#: What stands for now in the queries: the end of the data time.
AS_OF = "2025-07-01 00:00:00"
#: Columns every query on transactions needs; further ones are named by the query, so that the scan and the shuffle hold no others.
BASE = ["transaction_id", "created_at", "source_account_id", "destination_account_id", "amount", "transaction_timestamp", "status", "flagged"]
EXTRA = ["currency", "risk_score", "transaction_type"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def valid(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Standing transactions that keep the table's constraints: positive amount, two different accounts, a time; BASE and ``extra`` columns."""
    rows = standing_rows(load(spark, d, "transactions"), "transaction_id", "created_at", [*BASE, *sorted(extra)])
    return rows.where("amount > 0 and source_account_id <> destination_account_id and transaction_timestamp is not null")


def with_account(rows: DataFrame, spark: SparkSession, d: str, column: str, prefix: str, entity: bool = True, how: str = "inner") -> DataFrame:
    """Join an account side and its entity, hot accounts spread: prefix_account, prefix_country, prefix_entity_id, prefix_name, prefix_type, prefix_pep."""
    a = load(spark, d, "accounts").select(F.col("account_id").alias(column), F.col("account_number").alias(f"{prefix}_account"), F.col("country_code").alias(f"{prefix}_country"), F.col("entity_id").alias(f"{prefix}_entity_id"))
    if entity:
        e = load(spark, d, "entities").select(F.col("entity_id").alias(f"{prefix}_entity_id"), F.col("name").alias(f"{prefix}_name"), F.col("entity_type").alias(f"{prefix}_type"), F.col("pep_flag").alias(f"{prefix}_pep"))
        a = a.join(e, f"{prefix}_entity_id", how)
    return attach(rows, a, [column], how)


def letter(column: str, n: int, values: tuple[str, ...]) -> Column:
    """One of the values, chosen by the n-th character of an id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.ascii(F.substring(column, n, 1)) % len(values) + 1).cast("int"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """An alert for each flagged valid transaction, about the entity of its source account."""
    t = with_account(valid(spark, d, "risk_score", "transaction_type").where("flagged"), spark, d, "source_account_id", "s", entity=False)
    return t.select(
        F.concat(F.lit("AL-"), "transaction_id").alias("alert_id"), F.col("s_entity_id").alias("entity_id"), "transaction_id", letter("transaction_id", 1, ALERT_TYPES).alias("alert_type"),
        F.coalesce("risk_score", F.lit(50).cast("decimal(5,2)")).alias("risk_score"), letter("transaction_id", 2, ALERT_STATUSES).alias("status"),
        F.concat(F.lit("Flagged "), F.lower("transaction_type"), F.lit(" transfer")).alias("description"), F.lit("SYSTEM").alias("created_by"), "created_at", F.col("created_at").alias("updated_at"),
    )


def cases(spark: SparkSession, d: str) -> DataFrame:
    """A case for about every third alert."""
    a = alerts(spark, d).where(F.ascii(F.substring("transaction_id", 3, 1)) % 3 == 0)
    opened = F.col("created_at") + F.expr("interval 1 hour")
    status = letter("transaction_id", 5, CASE_STATUSES)
    return a.select(
        F.concat(F.lit("CA-"), "transaction_id").alias("case_id"), "alert_id",
        F.when(F.ascii(F.substring("transaction_id", 4, 1)) % 2 == 0, F.concat(F.lit("analyst_"), (F.ascii(F.substring("transaction_id", 4, 1)) % 5).cast("string"))).alias("assigned_to"),
        status.alias("status"), letter("transaction_id", 4, PRIORITIES).alias("priority"), F.lit(None).cast("string").alias("notes"), opened.alias("opened_at"),
        F.when(status.startswith("CLOSED"), opened + F.expr("interval 5 days")).alias("closed_at"),
    )


def records(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """All transactions as they came, or the given ``rows`` of them, as records of the bronze schema, with the countries of their accounts and the customer of the source."""
    t = (load(spark, d, "transactions") if rows is None else rows).select("transaction_id", "source_account_id", "destination_account_id", "amount", "currency", "transaction_timestamp", "transaction_type", "risk_score", "flagged")
    t = with_account(t, spark, d, "source_account_id", "s", how="left")
    t = with_account(t, spark, d, "destination_account_id", "t", entity=False, how="left")
    return t.select(
        "transaction_id", F.col("source_account_id").alias("source_account"), F.col("destination_account_id").alias("destination_account"), "amount", "currency", "transaction_timestamp", "transaction_type",
        F.col("s_country").alias("source_country"), F.col("t_country").alias("destination_country"),
        F.when(F.col("s_type") == "INDIVIDUAL", "retail").when(F.col("s_type") == "CORPORATE", "corporate").otherwise("correspondent").alias("customer_type"),
        F.col("s_pep").alias("is_pep"), "risk_score", "flagged",
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(n: int, values: tuple[str, ...]) -> str:
    return f"({_list(values)})[ascii(substr(transaction_id, {n}, 1)) % {len(values)} + 1]"


NOW = f"TIMESTAMPTZ '{AS_OF}+00'"
VALID_SQL = f"""standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC NULLS LAST,
{', '.join(f'{c} DESC NULLS LAST' for c in BASE[2:] + EXTRA)}) AS rn FROM transactions WHERE transaction_id IS NOT NULL) WHERE rn = 1),
valid AS (SELECT * FROM standing WHERE amount > 0 AND source_account_id <> destination_account_id AND transaction_timestamp IS NOT NULL)"""
ALERTS_SQL = f"""{VALID_SQL},
alerts AS (SELECT 'AL-' || t.transaction_id AS alert_id, s.entity_id, t.transaction_id, {_pick(1, ALERT_TYPES)} AS alert_type,
CAST(coalesce(t.risk_score, 50) AS DECIMAL(5,2)) AS risk_score, {_pick(2, ALERT_STATUSES)} AS status, 'Flagged ' || lower(t.transaction_type) || ' transfer' AS description,
'SYSTEM' AS created_by, t.created_at, t.created_at AS updated_at FROM valid t JOIN accounts s ON s.account_id = t.source_account_id WHERE t.flagged)"""
CASES_SQL = f"""{ALERTS_SQL},
cases AS (SELECT 'CA-' || transaction_id AS case_id, alert_id, CASE WHEN ascii(substr(transaction_id, 4, 1)) % 2 = 0 THEN 'analyst_' || CAST(ascii(substr(transaction_id, 4, 1)) % 5 AS VARCHAR) END AS assigned_to,
{_pick(5, CASE_STATUSES)} AS status, {_pick(4, PRIORITIES)} AS priority, CAST(NULL AS VARCHAR) AS notes, created_at + INTERVAL 1 HOUR AS opened_at,
CASE WHEN {_pick(5, CASE_STATUSES)} LIKE 'CLOSED%' THEN created_at + INTERVAL 1 HOUR + INTERVAL 5 DAY END AS closed_at
FROM alerts WHERE ascii(substr(transaction_id, 3, 1)) % 3 = 0)"""
RECORDS_SQL = """records AS (SELECT t.transaction_id, t.source_account_id AS source_account, t.destination_account_id AS destination_account, t.amount, t.currency, t.transaction_timestamp, t.transaction_type,
s.country_code AS source_country, x.country_code AS destination_country,
CASE e.entity_type WHEN 'INDIVIDUAL' THEN 'retail' WHEN 'CORPORATE' THEN 'corporate' ELSE 'correspondent' END AS customer_type, e.pep_flag AS is_pep, t.risk_score, t.flagged
FROM transactions t LEFT JOIN accounts s ON s.account_id = t.source_account_id LEFT JOIN accounts x ON x.account_id = t.destination_account_id LEFT JOIN entities e ON e.entity_id = s.entity_id)"""
