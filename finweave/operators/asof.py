"""Point-in-time join of events with what was valid and already known then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finweave.operators.running import stretch
from finweave.session import attach, materialize

#: An entity's time line is cut into so many buckets that each holds about this many changes or events.
CHANGES_PER_BUCKET, EVENTS_PER_BUCKET = 32, 4096


def validity_intervals(changes: DataFrame, entity: str, valid_from: str, known_at: str, tie: str, values: list[str]) -> DataFrame:
    """Half-open intervals [start, end) in microseconds with the version that holds in them.

    A change can be seen from max(valid_from, known_at) on. In order of that time the holding version is the running
    maximum of (valid_from, known_at, tie). The scan has two levels, stretches inside an entity and entities over their stretches, days or less as the load demands,
    so one window partition holds a stretch of an entity or one row a stretch, never all changes of a hot entity.
    Exact copies collapse; changes with a null entity or time are never visible; end is null while open.
    """
    version = F.struct(F.unix_micros(valid_from).alias("v"), F.unix_micros(known_at).alias("k"), *(F.col(c) for c in [tie, *values]))
    seen = (
        changes.select(entity, valid_from, known_at, tie, *values)
        .where(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(known_at).isNotNull())
        .select(F.col(entity).alias("e"), F.greatest(F.unix_micros(valid_from), F.unix_micros(known_at)).alias("start"), version.alias("version"))
    )
    seen = seen.withColumn("day", F.floor(F.col("start") / stretch(seen, "e", F.col("start"))))
    in_day = Window.partitionBy("e", "day").orderBy("start", "version")
    scanned = (
        seen.withColumn("best", F.max("version").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.lead("start").over(in_day))
        .withColumn("first", F.min("start").over(Window.partitionBy("e", "day")))
    )
    last_of_day = scanned.where("next is null").select("e", "day", "best", "first")
    over_days = Window.partitionBy("e").orderBy("day")
    carried = last_of_day.select(
        "e",
        "day",
        F.max("best").over(over_days.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.lead("first").over(over_days).alias("after"),
    )
    return (
        scanned.join(carried, ["e", "day"])
        .select("e", "start", F.coalesce("next", "after").alias("end"), F.greatest("best", "before").alias("version"))
        .where("end is null or start < end")
    )


def as_of(events: DataFrame, changes: DataFrame, *, event_id: str, entity: str, event_time: str, valid_from: str, known_at: str, tie: str, values: list[str]) -> DataFrame:
    """Every distinct event with the change that holds at its time: event columns, ``tie`` and ``values``.

    Intervals are exploded into time buckets and met by an equi-join on entity and bucket; containment is tested half-open.
    The bucket width of an entity follows from its changes and events, so the exploded rows stay linear in the input and
    an entity with a third of all rows is spread over as many buckets as it needs. Events without a visible change come
    out with nulls, as do events with a null entity or time. Exact copies of an event count once.
    """
    ev = materialize(
        events.select(event_id, entity, event_time).distinct().select(event_id, entity, event_time, F.unix_micros(event_time).alias("__t")),
        "asof-events",
    )
    spans = materialize(validity_intervals(changes, entity, valid_from, known_at, tie, values), "asof-intervals")
    lo, hi = ev.agg(F.min("__t"), F.max("__t")).first()
    if lo is None:
        lo = hi = 0
    load = (
        ev.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("e")).agg((F.count(F.lit(1)) / EVENTS_PER_BUCKET).alias("x"))
        .unionAll(spans.groupBy("e").agg((F.count(F.lit(1)) / CHANGES_PER_BUCKET).alias("x")))
        .groupBy("e").agg(F.sum("x").alias("x")).where("x > 1")
        .select(F.col("e"), F.ceil((F.lit(hi - lo + 1)) / F.ceil("x")).cast("bigint").alias("width"))
    )
    widths = materialize(load, "asof-widths")
    n = widths.count()
    whole = F.lit(hi - lo + 1).cast("bigint")

    def bucket(t, width):
        return F.floor((t - F.lit(lo)) / F.coalesce(width, whole)).cast("bigint")

    right = (
        attach(spans.where((F.col("start") <= hi) & (F.col("end").isNull() | (F.col("end") > lo))), widths, ["e"], rows=n)
        .withColumn("__b", F.explode(F.sequence(
            bucket(F.greatest("start", F.lit(lo)), F.col("width")),
            bucket(F.least(F.coalesce(F.col("end") - 1, F.lit(hi)), F.lit(hi)), F.col("width")),
        )))
        .select(F.col("e").alias("__e"), "__b", "start", "end", "version")
    )
    left = attach(ev.withColumn("e", F.col(entity)), widths, ["e"], rows=n).withColumn("__b", bucket(F.col("__t"), F.col("width")))
    met = (left["e"] == right["__e"]) & (left["__b"] == right["__b"]) & (left["__t"] >= right["start"]) & (right["end"].isNull() | (left["__t"] < right["end"]))
    return left.join(right, met, "left").select(event_id, left[entity], event_time, *(F.col(f"version.{c}").alias(c) for c in [tie, *values]))
