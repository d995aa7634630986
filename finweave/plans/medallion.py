"""Landing files to bronze, silver, quarantine and gold, each layer written once and counted while it is written."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from finweave import schemas
from finweave.functions import rules
from finweave.plans.records import lake_scored
from finweave.session import materialize
from finweave.sources import lake


@dataclass
class Run:
    """Where a run reads and writes, for which day and as of when."""

    raw: str
    root: str
    batch_date: str
    at: datetime
    environment: str = "dev"
    raw_format: str = "json"

    @classmethod
    def today(cls, raw: str, root: str, at: datetime, batch_date: str = "", **rest) -> Run:
        """A run for a date, or for the day of ``at`` if the date is blank."""
        return cls(raw, root, batch_date or at.date().isoformat(), at, **rest)

    def path(self, layer: str) -> str:
        return f"{self.root}/{layer}/transactions"


def _write(df: DataFrame, run: Run, layer: str) -> int:
    """Append to a layer under its schema, exactly, counting on the way."""
    seen = Observation()
    lake.append(df.observe(seen, F.count(F.lit(1)).alias("n")), run.path(layer), schemas.LAYERS[layer])
    return seen.get["n"]


def ingest(spark: SparkSession, run: Run) -> dict[str, int]:
    """Landing files to bronze; records that don't parse go to the rejects with their text."""
    raw = lake.scan_raw(spark, run.raw, run.batch_date, run.raw_format)
    rows = lake.with_metadata(raw, run.batch_date, run.environment, F.lit(run.at))
    if schemas.CORRUPT not in rows.columns:
        return {"bronze": _write(rows, run, "bronze"), "rejected": 0}
    rows = materialize(rows, "landed")  # parsed once for both tables
    broken = F.col(schemas.CORRUPT).isNotNull()
    return {"bronze": _write(rows.where(~broken).drop(schemas.CORRUPT), run, "bronze"), "rejected": _write(rows.where(broken), run, "rejected")}


def transform(spark: SparkSession, run: Run, safe: bool = True) -> dict[str, int]:
    """Bronze to silver, clustered by time, and quarantine."""
    rows = rules.lake_flags(rules.lake_quality(rules.normalize_lake(lake.scan_batch(spark, run.path("bronze"), run.batch_date)), run.at))
    rows = rows.withColumns({"_transformation_timestamp": F.lit(run.at), "_environment": F.lit(run.environment)})
    good, bad = rules.split(materialize(rows, "checked"), safe)  # checked once for both tables
    return {"silver": _write(lake.clustered(good, "transaction_timestamp"), run, "silver"), "quarantine": _write(bad, run, "quarantine")}


def score(spark: SparkSession, run: Run, url: str = "") -> dict[str, int]:
    """Silver to gold; the latest score of each account goes to the history database if there is one."""
    rows = lake_scored(lake.scan_batch(spark, run.path("silver"), run.batch_date)).withColumns({"_scoring_timestamp": F.lit(run.at), "_environment": F.lit(run.environment)})
    n = _write(rows, run, "gold")
    gold = lake.scan_batch(spark, run.path("gold"), run.batch_date)
    latest = gold.groupBy("source_account").agg(F.max("risk_score").alias("score"), F.max_by("risk_level", "risk_score").alias("risk_level"))
    history = latest.select(F.col("source_account").alias("entity_id"), "score", "risk_level", F.lit(run.at).alias("scoring_timestamp"), F.lit("{}").alias("contributing_factors"))
    return {"gold": n, "history": history.count() if lake.append_history(history, url) else 0}


def run_all(spark: SparkSession, run: Run, url: str = "") -> dict[str, int]:
    return ingest(spark, run) | transform(spark, run) | score(spark, run, url)


def summary(counts: dict[str, int]) -> str:
    """What a job reports when it is done."""
    return "SUCCESS: " + ", ".join(f"{n} {k} rows" for k, n in counts.items())


__all__ = ["Run", "ingest", "transform", "score", "run_all", "summary"]
