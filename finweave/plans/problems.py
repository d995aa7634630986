"""Queries of the general data problems, over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.operators import asof, eager, rawparse, rolling, units
from finweave.operators.standing import standing_rows
from finweave.session import materialize
from finweave.sources.tables import load

FIRST, LAST = date(2025, 1, 1), date(2025, 6, 30)
HEAVY_SHARE = 0.02


def _standing(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return standing_rows(load(spark, d, "transactions"), "transaction_id", "created_at", ["transaction_id", *columns])


def _account_states(spark: SparkSession, d: str) -> DataFrame:
    tx = _standing(spark, d, "source_account_id", "destination_account_id", "amount", "transaction_timestamp")
    return eager.states(eager.sides(tx), ["account_id", "side"], "amount", "transaction_timestamp")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Transactions by side joined with the accounts they name, known or not, as states and multiplicities; the heavy ones of the roll-up."""
    known = eager.multiplicities(load(spark, d, "accounts").select("account_id").distinct(), "account_id", [])
    activity = eager.join_rollup(_account_states(spark, d), known, "account_id", [], ["account_id", "side"], keep=True)
    return eager.heavy_accounts(materialize(activity, "p1-states"), HEAVY_SHARE)


def p1_account_activity(spark: SparkSession, d: str) -> DataFrame:
    return _account_states(spark, d).select("account_id", "side", "n", "total", "last_at")


def p1_entity_activity(spark: SparkSession, d: str) -> DataFrame:
    owners = eager.multiplicities(load(spark, d, "accounts"), "account_id", ["entity_id"])
    return eager.join_rollup(_account_states(spark, d), owners, "account_id", ["entity_id"], ["side"])


def _with_units(spark: SparkSession, d: str) -> DataFrame:
    tx = _standing(spark, d, "amount", "currency", "source_system", "remittance_text", "created_at")
    return units.with_units(tx, load(spark, d, "transactions"), load(spark, d, "currency_units"), load(spark, d, "source_systems"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.undeclared(_with_units(spark, d))


def p2_converted(spark: SparkSession, d: str) -> DataFrame:
    return _with_units(spark, d).select("transaction_id", "unit_code", "iso_currency", "amount_in_units", "amount_whole", "amount_usd")


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of(
        load(spark, d, "risk_scores_history"), load(spark, d, "entity_changes"), event_id="id", entity="entity_id", event_time="scoring_timestamp",
        valid_from="valid_from", known_at="recorded_at", tie="change_id", values=["risk_score", "pep_flag"],
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d).where("change_id is not null").select("id", "change_id")


def p4_attributes_then(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d).select("id", "entity_id", "scoring_timestamp", "change_id", "risk_score", "pep_flag")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return rawparse.classify(rawparse.tokenize(load(spark, d, "raw_transactions"), "record_id", "raw_record", "record_format"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("reason is not null").select(F.col("key").alias("record_id"), "reason")


def p5_bronze(spark: SparkSession, d: str) -> DataFrame:
    return rawparse.bronze(_records(spark, d))


def p5_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("reason is not null").select(F.col("key").alias("record_id"), "reason", "bad_field", F.col("at").alias("error_offset"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    tx = _standing(spark, d, "source_account_id", "transaction_timestamp", "amount")
    return rolling.daily_totals(tx, "source_account_id", "transaction_timestamp", "amount", FIRST, LAST)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    peaks = rolling.peak_days(_daily(spark, d), FIRST, LAST)
    return peaks.select(F.col("account").alias("source_account_id"), rolling.day_text("peak_7", FIRST).alias("peak7_day"), rolling.day_text("peak_30", FIRST).alias("peak30_day"))


def p6_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the trailing 7 and 30 days for every account and day, and the average a day of the window."""
    rows = rolling.trailing_totals(_daily(spark, d), FIRST, LAST)
    out = rows.select(F.col("account").alias("source_account_id"), rolling.day_text("d", FIRST).alias("day"), rolling.amount_of("hi_7", "lo_7").alias("total_7"), rolling.amount_of("hi_30", "lo_30").alias("total_30"))
    return out.withColumn("daily_average_7", F.col("total_7").cast("double") / 7).withColumn("daily_average_30", F.col("total_30").cast("double") / 30)


_STANDING = """standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC NULLS LAST, {ties}) AS rn
FROM transactions WHERE transaction_id IS NOT NULL) WHERE rn = 1)"""


def _ties(*columns: str) -> str:
    return _STANDING.format(ties=", ".join(f"{c} DESC NULLS LAST" for c in columns))


_STATES = f"""WITH {_ties('source_account_id', 'destination_account_id', 'amount', 'transaction_timestamp')},
sides AS (SELECT source_account_id AS account_id, 'source' AS side, amount, transaction_timestamp FROM standing
UNION ALL SELECT destination_account_id, 'destination', amount, transaction_timestamp FROM standing),
states AS (SELECT account_id, side, count(*) AS n, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4)) AS total, max(transaction_timestamp) AS last_at
FROM sides GROUP BY account_id, side)"""

_AS_OF = """WITH ev AS (SELECT DISTINCT id, entity_id, scoring_timestamp FROM risk_scores_history),
ch AS (SELECT DISTINCT change_id, entity_id, risk_score, pep_flag, valid_from, recorded_at FROM entity_changes),
best AS (SELECT ev.id, ev.entity_id, ev.scoring_timestamp, ch.change_id, ch.risk_score, ch.pep_flag,
row_number() OVER (PARTITION BY ev.id, ev.entity_id, ev.scoring_timestamp ORDER BY ch.valid_from DESC NULLS LAST, ch.recorded_at DESC NULLS LAST, ch.change_id DESC NULLS LAST) AS rn
FROM ev LEFT JOIN ch ON ch.entity_id = ev.entity_id AND ch.valid_from <= ev.scoring_timestamp AND ch.recorded_at <= ev.scoring_timestamp)"""

_DENSE = f"""WITH {_ties('source_account_id', 'transaction_timestamp', 'amount')},
usable AS (SELECT source_account_id, CAST(timezone('UTC', transaction_timestamp) AS DATE) AS day, amount FROM standing
WHERE source_account_id IS NOT NULL AND amount IS NOT NULL AND timezone('UTC', transaction_timestamp) >= DATE '2025-01-01' AND timezone('UTC', transaction_timestamp) < DATE '2025-07-01'),
daily AS (SELECT source_account_id, day, sum(amount) AS x FROM usable GROUP BY 1, 2),
grid AS (SELECT a.source_account_id, CAST(g.day AS DATE) AS day FROM (SELECT DISTINCT source_account_id FROM usable) a,
(SELECT unnest(generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-06-30', INTERVAL 1 DAY)) AS day) g),
filled AS (SELECT grid.source_account_id, grid.day, coalesce(x, 0) AS x FROM grid LEFT JOIN daily ON daily.source_account_id = grid.source_account_id AND daily.day = grid.day),
rolled AS (SELECT source_account_id, day, sum(x) OVER (PARTITION BY source_account_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total_7,
sum(x) OVER (PARTITION BY source_account_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS total_30 FROM filled)"""

_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_F = dict(zip(rawparse.FIELDS, range(1, len(rawparse.FIELDS) + 1)))
_CSV_VALUE = "nullif(CASE WHEN starts_with(f[{n}], '\"') THEN replace(substr(f[{n}], 2, length(f[{n}]) - 2), '\"\"', '\"') ELSE f[{n}] END, '')"
# numbers keep their text, other values are unquoted
_JSON_VALUE = """CASE WHEN json_type(j, '$.{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN regexp_extract(t, '"{name}"\\s*:\\s*([^,}}\\s]+)', 1) ELSE json_extract_string(j, '$.{name}') END"""


def _broken(name: str) -> str:
    """When a field of table ``v`` breaks the rules of its column."""
    wanted = "NUMBER" if name in ("amount", "risk_score") else "BOOLEAN" if name in ("is_pep", "flagged") else "VARCHAR"
    is_wanted = f"{name}_kind IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')" if wanted == "NUMBER" else f"{name}_kind = '{wanted}'"
    rules = [f"coalesce({name}_kind <> 'NULL' AND NOT ({is_wanted}), false)"]
    patterns = {"amount": "-?[0-9]{1,16}([.][0-9]{1,4})?", "risk_score": "-?[0-9]{1,16}([.][0-9]{1,4})?", "currency": "[A-Za-z]{3}", "source_country": "[A-Za-z]{2}", "destination_country": "[A-Za-z]{2}", "is_pep": "true|false", "flagged": "true|false"}
    if name in patterns:
        rules.append(f"coalesce(NOT regexp_full_match({name}, '{patterns[name]}'), false)")
    if name == "transaction_timestamp":
        rules.append(f"coalesce(NOT regexp_full_match({name}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR try_strptime({name}, '%Y-%m-%dT%H:%M:%S') IS NULL, false)")
    if _F[name] <= rawparse.REQUIRED:
        rules.append(f"{name} IS NULL")
    return " OR ".join(rules)


# DuckDB takes a comma before the closing brace, which JSON doesn't allow
_RECORDS = f"""WITH r AS (SELECT record_id, raw_record AS t, coalesce(record_format = 'json' OR record_format <> 'csv' AND starts_with(ltrim(raw_record), '{{'), starts_with(ltrim(raw_record), '{{')) AS is_json FROM raw_transactions),
x AS (SELECT *, CASE WHEN is_json AND json_valid(t) AND NOT regexp_matches(t, ',\\s*[}}]\\s*$') THEN CAST(t AS JSON) END AS j, CASE WHEN NOT is_json THEN regexp_extract_all(',' || t, ',{_FIELD}', 1) END AS f FROM r),
v AS (SELECT *, CASE WHEN t IS NULL THEN 'column_count' WHEN is_json AND j IS NULL OR NOT is_json AND NOT regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*') THEN 'broken_quoting'
WHEN is_json AND (json_type(j) <> 'OBJECT' OR list_sort(json_keys(j)) <> list_sort([{', '.join(f"'{n}'" for n in rawparse.FIELDS)}])) OR NOT is_json AND len(f) <> {len(rawparse.FIELDS)} THEN 'column_count' END AS shape,
{', '.join(f"CASE WHEN is_json THEN {_JSON_VALUE.format(name=n)} ELSE {_CSV_VALUE.format(n=k)} END AS {n}, json_type(j, '$.{n}') AS {n}_kind" for n, k in _F.items())} FROM x),
judged AS (SELECT *, coalesce(shape, CASE WHEN {' OR '.join(f'({_broken(n)})' for n in rawparse.FIELDS)} THEN 'invalid_value' END) AS reason FROM v)"""
_TYPED = {"amount": "CAST(amount AS DECIMAL(20,4))", "transaction_timestamp": "CAST(strptime(transaction_timestamp, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMPTZ)", "is_pep": "CAST(is_pep AS BOOLEAN)", "risk_score": "CAST(risk_score AS DOUBLE)", "flagged": "CAST(flagged AS BOOLEAN)"}

QUERIES = {f.__name__: f for f in (p1_found, p1_account_activity, p1_entity_activity, p2_found, p2_converted, p4_found, p4_attributes_then, p5_found, p5_bronze, p5_quarantine, p6_found, p6_trailing)}

SQL = {
    "p5_found": f"{_RECORDS} SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_bronze": f"{_RECORDS} SELECT record_id, {', '.join(f'{_TYPED.get(n, n)} AS {n}' for n in rawparse.FIELDS)} FROM judged WHERE reason IS NULL",
    "p1_found": f"""{_STATES} SELECT account_id, side FROM states JOIN (SELECT side AS s, sum(n) AS all_n FROM states GROUP BY side) ON s = side
WHERE account_id IS NOT NULL AND n >= 0.02 * all_n""",
    "p1_account_activity": f"{_STATES} SELECT account_id, side, n, total, last_at FROM states",
    "p1_entity_activity": f"""{_STATES} SELECT a.entity_id, s.side, CAST(sum(s.n) AS BIGINT) AS n, CAST(sum(s.total) AS DECIMAL(38,4)) AS total, max(s.last_at) AS last_at
FROM states s JOIN accounts a ON a.account_id = s.account_id GROUP BY a.entity_id, s.side""",
    "p4_found": f"{_AS_OF} SELECT id, change_id FROM best WHERE rn = 1 AND change_id IS NOT NULL",
    "p4_attributes_then": f"{_AS_OF} SELECT id, entity_id, scoring_timestamp, change_id, risk_score, pep_flag FROM best WHERE rn = 1",
    "p6_found": f"""{_DENSE}, p7 AS (SELECT source_account_id, day, row_number() OVER (PARTITION BY source_account_id ORDER BY total_7 DESC, day DESC) AS rn FROM rolled),
p30 AS (SELECT source_account_id, day, row_number() OVER (PARTITION BY source_account_id ORDER BY total_30 DESC, day DESC) AS rn FROM rolled)
SELECT p7.source_account_id, strftime(p7.day, '%Y-%m-%d') AS peak7_day, strftime(p30.day, '%Y-%m-%d') AS peak30_day
FROM p7 JOIN p30 ON p30.source_account_id = p7.source_account_id AND p30.rn = 1 WHERE p7.rn = 1""",
    "p6_trailing": f"""{_DENSE} SELECT source_account_id, strftime(day, '%Y-%m-%d') AS day, CAST(total_7 AS DECIMAL(34,4)) AS total_7, CAST(total_30 AS DECIMAL(34,4)) AS total_30,
CAST(total_7 AS DOUBLE) / 7 AS daily_average_7, CAST(total_30 AS DOUBLE) / 30 AS daily_average_30 FROM rolled""",
}
