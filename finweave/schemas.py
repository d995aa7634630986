"""Schemas of the platform's tables."""

from pyspark.sql import types as T

BRONZE = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("source_account", T.StringType()), T.StructField("destination_account", T.StringType()),
    T.StructField("amount", T.DecimalType(20, 4)), T.StructField("currency", T.StringType()), T.StructField("transaction_timestamp", T.TimestampType()),
    T.StructField("transaction_type", T.StringType()), T.StructField("source_country", T.StringType()), T.StructField("destination_country", T.StringType()),
    T.StructField("customer_type", T.StringType()), T.StructField("is_pep", T.BooleanType()), T.StructField("risk_score", T.DoubleType()), T.StructField("flagged", T.BooleanType()),
])
CORRUPT = "_corrupt_record"
BRONZE_SAFE = T.StructType([*BRONZE.fields, T.StructField(CORRUPT, T.StringType())])


_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _more(base: T.StructType, columns: str) -> T.StructType:
    """A schema with more columns, given as name and type; one that is there already takes the new type."""
    new = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    return T.StructType([f for f in base.fields if f.name not in new.names] + new.fields)


#: What the tables of the lake hold, exactly.
_LANDED = _more(BRONZE, "_ingestion_timestamp timestamp, _batch_date date, _environment string, _source_path string")
_CHECKED = _more(
    _LANDED,
    "dq_not_null_transaction_id boolean, dq_not_null_amount boolean, dq_positive_amount boolean, dq_not_null_source_account boolean, dq_not_null_dest_account boolean, dq_valid_currency boolean, "
    "dq_timestamp_not_future boolean, dq_amount_within_limit boolean, dq_no_self_transfer boolean, dq_score double, flag_high_value boolean, flag_structuring_indicator boolean, flag_round_amount boolean, "
    "flag_cross_border boolean, flag_high_risk_country boolean, _transformation_timestamp timestamp",
)
LAYERS = {
    "bronze": _LANDED, "rejected": _more(_LANDED, f"{CORRUPT} string"), "silver": _CHECKED, "quarantine": _CHECKED, "gold": _more(_CHECKED, "risk_level string, _scoring_timestamp timestamp"),
}
