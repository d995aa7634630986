"""Normalisation, quality rules and flags as Column expressions; each layer's variant keeps its own name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.constants import ACCOUNT_PATTERN, ALIASES, CURRENCIES, HIGH_RISK_COUNTRIES, HIGH_VALUE, MAX_AMOUNT, STRUCTURING_HIGH, STRUCTURING_LOW
from finweave.session import attach


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def holds(c: Column) -> Column:
    """A three-valued condition with null as false."""
    return F.coalesce(c, F.lit(False))


def filled(name: str) -> Column:
    return holds(F.col(name).isNotNull() & (strip(F.col(name).cast("string")) != ""))


# ---- normalisation -------------------------------------------------------------------------------------------------


def normalize_record(df: DataFrame) -> DataFrame:
    """Record layer: alias columns are renamed, the later alias wins; strings are stripped; a missing id becomes a UUID; amount becomes a double
    or null; currency is upper case; an empty type becomes UNKNOWN and keeps its case otherwise. Other columns pass through stripped."""
    sources: dict[str, list[str]] = {}
    for c in df.columns:
        sources.setdefault(ALIASES.get(c, c), []).append(c)
    out = {}
    for name, columns in sources.items():
        # a key that is absent from a record reads as null, so the last filled alias counts
        value = F.coalesce(*(F.col(c) for c in reversed(columns)))
        out[name] = strip(value) if all(t == "string" for n, t in df.dtypes if n in columns) else value
    if "transaction_id" in out:
        out["transaction_id"] = F.coalesce(F.nullif(out["transaction_id"], F.lit("")), F.expr("uuid()"))
    else:
        out["transaction_id"] = F.expr("uuid()")
    if "amount" in out:
        out["amount"] = out["amount"].try_cast("double")
    if "currency" in out:
        out["currency"] = F.upper(out["currency"])
    kind = out.get("transaction_type", F.lit(None).cast("string"))
    out["transaction_type"] = F.coalesce(F.nullif(kind, F.lit("")), F.lit("UNKNOWN"))
    return df.select(*(c.alias(n) for n, c in out.items()))


def normalize_ingested(df: DataFrame) -> DataFrame:
    """Ingestion layer: ids and accounts trimmed, currency and type trimmed and upper case, a null flag false; nulls stay null."""
    return df.withColumns(
        {c: strip(F.col(c)) for c in ("transaction_id", "source_account", "destination_account")}
        | {c: F.upper(strip(F.col(c))) for c in ("currency", "transaction_type")}
        | {"flagged": holds(F.col("flagged"))}
    )


def normalize_lake(df: DataFrame) -> DataFrame:
    """Lake layer: like the ingestion layer, with UNKNOWN for a null type, is_pep false for null, and ids as they are."""
    return df.withColumns({
        "currency": F.trim(F.upper("currency")), "transaction_type": F.upper(F.coalesce("transaction_type", F.lit("UNKNOWN"))), "is_pep": holds(F.col("is_pep")),
        "flagged": holds(F.col("flagged")), "source_account": F.trim("source_account"), "destination_account": F.trim("destination_account"),
    })


def enrich_with_entity(df: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    """Record layer: add ``entity_context`` from the entity whose id stands in column ``on``.

    Missing parts take defaults: no exposed person, score 0, retail; without an entity the struct holds defaults and null id, name and country.
    ``entities`` has unique entity_id and may lack the other columns. Hot entities are spread.
    """
    have = entities.columns
    part = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    context = entities.select(
        F.col("entity_id").alias(on),
        F.struct(
            F.nullif(F.col("entity_id"), F.lit("")).alias("entity_id"), text("name").alias("name"), part("pep_flag", False).alias("pep_flag"), part("risk_score", 0).cast("double").alias("risk_score"),
            text("country").alias("country"), part("customer_type", "retail").alias("customer_type"),
        ).alias("entity_context"),
    )
    null = F.lit(None).cast("string")
    missing = F.struct(null.alias("entity_id"), null.alias("name"), F.lit(False).alias("pep_flag"), F.lit(0.0).alias("risk_score"), null.alias("country"), F.lit("retail").alias("customer_type"))
    return attach(df, context, [on]).withColumn("entity_context", F.coalesce("entity_context", missing))


# ---- flags ---------------------------------------------------------------------------------------------------------


def record_flags(df: DataFrame) -> DataFrame:
    """Record layer: five flags that are never null; countries in any case, a null amount counts as 0."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    source, target = (F.upper(F.coalesce(c, F.lit(""))) for c in ("source_country", "destination_country"))
    return df.withColumns({
        "flag_high_value": amount >= HIGH_VALUE,
        "flag_structuring_indicator": (amount >= STRUCTURING_LOW) & (amount < STRUCTURING_HIGH),
        "flag_round_amount": (amount > 0) & (amount % 1000 == 0),
        "flag_cross_border": (source != "") & (target != "") & (source != target),
        "flag_high_risk_country": source.isin(*HIGH_RISK_COUNTRIES) | target.isin(*HIGH_RISK_COUNTRIES),
    })


def lake_flags(df: DataFrame) -> DataFrame:
    """Lake layer: the same five, null where their inputs are null, countries as written."""
    a, s, t = F.col("amount"), F.col("source_country"), F.col("destination_country")
    return df.withColumns({
        "flag_high_value": a >= HIGH_VALUE,
        "flag_structuring_indicator": (a >= STRUCTURING_LOW) & (a < STRUCTURING_HIGH),
        "flag_round_amount": (a > 0) & (a % 1000 == 0),
        "flag_cross_border": s.isNotNull() & t.isNotNull() & (s != t),
        "flag_high_risk_country": s.isin(*HIGH_RISK_COUNTRIES) | t.isin(*HIGH_RISK_COUNTRIES),
    })


def risk_tiers(df: DataFrame) -> DataFrame:
    """Ingestion layer: a risk score by the size of the amount; a flag is set from 10,000 on and never taken back."""
    a = F.col("amount")
    score = F.when(a.isNull(), 0.0)
    for least, value in ((1_000_000, 90.0), (500_000, 75.0), (50_000, 60.0), (10_000, 40.0), (9_000, 30.0)):
        score = score.when(a >= least, value)
    return df.withColumns({"risk_score": score.otherwise(10.0), "flagged": F.when(a >= HIGH_VALUE, True).otherwise(F.col("flagged"))})


def structuring_boost(df: DataFrame, account: str | None = None) -> DataFrame:
    """Transactions just under the threshold, of one account on either side or of all: flagged, and 20 points riskier (50 without a score)."""
    rows = df.where((F.col("amount") >= STRUCTURING_LOW) & (F.col("amount") < STRUCTURING_HIGH))
    if account is not None:
        rows = rows.where((F.col("source_account") == account) | (F.col("destination_account") == account))
    risk = F.col("risk_score").cast("double")
    return rows.withColumns({"flagged": F.lit(True), "risk_score": F.when(risk.isNull(), 50.0).otherwise(F.least(F.lit(100.0), risk + 20.0))})


# ---- quality -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A quality rule: who it is, how grave, and when a record passes. A null outcome fails."""

    rule_id: str
    severity: str
    field: str
    description: str
    passes: Callable[[], Column]
    #: What a failed record is told instead of the description, where it isn't null.
    says: Callable[[], Column] | None = None


def _number(name: str) -> Column:
    return F.col(name).cast("string").try_cast("double")


def _not_in_future(name: str, as_of: datetime) -> Column:
    text = F.col(name).cast("string")
    moment = F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))
    return moment <= F.lit(as_of)


def standard_rules(as_of: datetime) -> list[Rule]:
    """The ten rules of the record layer; ``as_of`` stands for now."""
    needed = ("transaction_id", "amount", "source_account", "destination_account", "timestamp")
    labels = ("Transaction ID", "Amount", "Source account", "Destination account", "Timestamp")
    a = lambda: _number("amount")
    account = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    return [
        *(Rule(f"DQ-{k:03d}", "ERROR", f, f"{label} must not be null or empty.", lambda f=f: filled(f)) for k, (f, label) in enumerate(zip(needed, labels), 1)),
        Rule("DQ-006", "ERROR", "amount", "Transaction amount must be greater than zero.", lambda: (a() > 0) & ~F.isnan(a())),
        Rule("DQ-007", "ERROR", "currency", "Currency must be a recognised ISO 4217 code.", lambda: F.upper("currency").isin(*CURRENCIES)),
        Rule("DQ-008", "ERROR", "timestamp", "Transaction timestamp must not be in the future.", lambda: _not_in_future("timestamp", as_of)),
        Rule("DQ-009", "WARNING", "amount", f"Amount must not exceed {MAX_AMOUNT:,}.", lambda: (a() <= MAX_AMOUNT) & ~F.isnan(a())),
        Rule(
            "DQ-010", "WARNING", "source_account", "Source and destination accounts must match expected format.",
            lambda: (account("source_account") | F.col("source_account").rlike(ACCOUNT_PATTERN)) & (account("destination_account") | F.col("destination_account").rlike(ACCOUNT_PATTERN)),
        ),
    ]


def callable_rule(rule_id: str, severity: str, field: str, description: str, check: Callable[[dict], bool], columns: list[str]) -> Rule:
    """A rule whose check is a Python function of a record. It gets Arrow batches, but is called once a record, so prefer an expression. An exception fails the record; its
    text is the message.
    """

    @F.pandas_udf("passed boolean, message string")
    def run(records: pd.DataFrame) -> pd.DataFrame:
        out = []
        for record in records.astype(object).where(records.notna(), None).to_dict("records"):
            try:
                out.append((bool(check(record)), None))
            except Exception as e:
                out.append((False, str(e)))
        return pd.DataFrame(out, columns=["passed", "message"])

    verdict = lambda: run(F.struct(*columns))
    return Rule(rule_id, severity, field, description, lambda: verdict()["passed"], lambda: verdict()["message"])


def add_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    """With one more rule; if its id is taken, both entries stay and both use the new check."""
    return [*(replace(r, passes=rule.passes, says=rule.says) if r.rule_id == rule.rule_id else r for r in rules), rule]


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``results`` (one struct a rule), ``quality_score`` (0 to 100, 0 without rules) and ``errors`` (texts of failed ERROR rules)."""
    if not rules:
        empty = F.array().cast("array<struct<rule_id:string,severity:string,passed:boolean,message:string,field_path:string,value:string>>")
        return df.withColumns({"results": empty, "quality_score": F.lit(0.0), "errors": F.array().cast("array<string>")})
    checked = df.withColumns({f"__passed_{k}": holds(r.passes()) for k, r in enumerate(rules)} | {f"__said_{k}": r.says() for k, r in enumerate(rules) if r.says})
    failed = lambda k, r: F.concat(F.lit("Failed: "), F.coalesce(F.col(f"__said_{k}"), F.lit(r.description))) if r.says else F.lit(f"Failed: {r.description}")
    value = lambda r: F.col(r.field).cast("string") if r.field in df.columns else F.lit(None).cast("string")
    results = F.array(*(
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(f"__passed_{k}").alias("passed"),
            F.when(F.col(f"__passed_{k}"), "OK").otherwise(failed(k, r)).alias("message"), F.lit(r.field).alias("field_path"), value(r).alias("value"),
        )
        for k, r in enumerate(rules)
    ))
    passed = sum((F.col(f"__passed_{k}").cast("int") for k in range(len(rules))), F.lit(0))
    errors = F.array_compact(F.array(*(F.when(~F.col(f"__passed_{k}"), F.concat(F.lit(f"[{r.rule_id}] "), failed(k, r), F.lit(f" (field={r.field})"))) for k, r in enumerate(rules) if r.severity == "ERROR")))
    return checked.withColumns({"results": results, "quality_score": F.floor(passed * 10000 / len(rules) + 0.5) / 100, "errors": errors}).drop(*(f"__{x}_{k}" for x in ("passed", "said") for k in range(len(rules))))


def ingestion_violations(df: DataFrame) -> DataFrame:
    """Ingestion layer: add ``violations``, the texts of the broken ones of seven rules."""
    blank = lambda c: F.coalesce(strip(F.col(c)) == "", F.lit(True))
    a, currency = F.col("amount"), F.col("currency")
    say = lambda when, *text: F.when(when, F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text)))
    return df.withColumn("violations", F.array_compact(F.array(
        say(blank("transaction_id"), "VIOLATION: transaction_id is null or blank"),
        F.when(a.isNull(), "VIOLATION: amount is null").when(a <= 0, F.concat(F.lit("VIOLATION: amount must be positive, got "), a.cast("string"))),
        say(blank("source_account"), "VIOLATION: source_account is null or blank"),
        say(blank("destination_account"), "VIOLATION: destination_account is null or blank"),
        say(F.coalesce(F.length(strip(currency)) != 3, F.lit(True)), "VIOLATION: currency must be a 3-character ISO code, got '", F.coalesce(currency, F.lit("null")), "'"),
        say(F.col("transaction_timestamp").isNull(), "VIOLATION: timestamp is null"),
        say(holds(F.lower("source_account") == F.lower("destination_account")), "VIOLATION: source_account and destination_account must differ"),
    )))


LAKE_CRITICAL = ("dq_not_null_transaction_id", "dq_not_null_amount", "dq_positive_amount", "dq_no_self_transfer")


def lake_quality(df: DataFrame, as_of: datetime) -> DataFrame:
    """Lake layer: nine dq_ columns, null where their inputs are null, and ``dq_score``, null if any of them is."""
    a = F.col("amount")
    flags = {
        "dq_not_null_transaction_id": F.col("transaction_id").isNotNull(), "dq_not_null_amount": a.isNotNull(), "dq_positive_amount": a > 0,
        "dq_not_null_source_account": F.col("source_account").isNotNull(), "dq_not_null_dest_account": F.col("destination_account").isNotNull(),
        "dq_valid_currency": F.length("currency") == 3, "dq_timestamp_not_future": F.col("transaction_timestamp") <= F.lit(as_of),
        "dq_amount_within_limit": a < MAX_AMOUNT, "dq_no_self_transfer": F.col("source_account") != F.col("destination_account"),
    }
    total = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    return df.withColumns(flags).withColumn("dq_score", total / len(flags) * 100)


def split(df: DataFrame, safe: bool = False) -> tuple[DataFrame, DataFrame]:
    """Silver and quarantine by the critical lake rules.

    As in three-valued logic a row whose verdict is null is in neither; with ``safe`` it goes to quarantine.
    """
    good = F.col(LAKE_CRITICAL[0])
    for c in LAKE_CRITICAL[1:]:
        good = good & F.col(c)
    good = holds(good) if safe else good
    return df.where(good), df.where(~good)
