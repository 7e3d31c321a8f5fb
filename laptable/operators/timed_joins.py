"""As-of, nearest and range joins between laps and timed provider tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.functions.groups import OrderedGroups, join_on

WEATHER_TOLERANCE_S = 600
DELETED_TIME_TOLERANCE_S = 0.002


def _merged(probes: DataFrame, updates: DataFrame, keys: list[str], at: str, update_at: str,
            values: list[str], sequence: str | None) -> DataFrame:
    """Probe rows and update rows in one table: the ordered log of each key."""
    order = F.col(sequence).cast("bigint") if sequence else F.lit(0).cast("bigint")
    rows = probes.select(
        *keys, F.col(at).alias("_at"), F.lit(True).alias("_probe"), F.lit(0).cast("bigint").alias("_seq"),
        F.struct(*probes.columns).alias("_row"),
    )
    news = updates.where(F.col(update_at).isNotNull()).select(
        *keys, F.col(update_at).alias("_at"), F.lit(False).alias("_probe"), order.alias("_seq"),
        F.struct(F.col(update_at).alias("_at"), *values).alias("_new"),
    )
    return rows.unionByName(news, allowMissingColumns=True)


def asof_backward(probes: DataFrame, updates: DataFrame, keys: list[str], at: str, update_at: str,
                  values: list[str], sequence: str | None = None, split: bool = False) -> DataFrame:
    """Each probe with the last update of its key at or before it. One shuffle of both sides;
    a probe without a time gets no update."""
    log = _merged(probes, updates, keys, at, update_at, values, sequence)
    groups = OrderedGroups(log, keys, ["_at", "_probe", "_seq"], split)
    out = groups.before(groups.df, last={"_latest": F.col("_new")}).where("_probe")
    known = F.col("_at").isNotNull()
    return out.select("_row.*", *[F.when(known, F.col("_latest")[v]).alias(v) for v in values])


def asof_nearest(probes: DataFrame, updates: DataFrame, keys: list[str], at: str, update_at: str,
                 values: list[str], tolerance_s: float | None = None, sequence: str | None = None,
                 split: bool = False) -> DataFrame:
    """Each probe with the update closest in time, the earlier one on a tie, within an
    optional tolerance. The forward side reads the log in reverse, so both sides are running
    values rather than open-ended frames."""
    log = _merged(probes, updates, keys, at, update_at, values, sequence)
    log = log.withColumns({"_back": -F.unix_micros("_at"), "_backseq": -F.col("_seq")})
    groups = OrderedGroups(log, keys, ["_at", "_probe", "_seq"], split)
    past = groups.finish(groups.before(groups.df, last={"_past": F.col("_new")}))
    reverse = OrderedGroups(past, keys, ["_back", "_probe", "_backseq"], groups.split)
    out = reverse.before(reverse.df, last={"_next": F.col("_new")}).where("_probe")
    micros = F.unix_micros("_at")
    to_past = micros - F.unix_micros(F.col("_past")["_at"])
    to_next = F.unix_micros(F.col("_next")["_at"]) - micros
    earlier = F.coalesce(to_past <= to_next, to_past.isNotNull())
    nearest = F.when(earlier, F.col("_past")).otherwise(F.col("_next"))
    distance = F.when(earlier, to_past).otherwise(to_next)
    usable = F.col("_at").isNotNull()
    if tolerance_s is not None:
        usable = usable & (distance <= int(tolerance_s * 1_000_000))
    return out.select("_row.*", *[F.when(usable, nearest[v]).alias(v) for v in values])


def weather_defaults() -> dict[str, Column]:
    """Without a weather sample numbers stay missing, rain reads dry and wind direction 0."""
    return {
        "rainfall": F.coalesce(F.col("rainfall").try_cast("double"), F.lit(0.0)) > 0,
        "wind_direction_deg": F.coalesce(F.col("wind_direction_deg").try_cast("double"), F.lit(0.0)),
    }


def stint_range_join(laps: DataFrame, stints: DataFrame, keys: list[str], bucket_laps: int = 64, source: DataFrame | None = None) -> DataFrame:
    """Stint of each lap; a later stint row wins where stints overlap. ``source`` may be a cheaper table that holds at least the lap
    numbers of ``laps``.

    An equi-join on (driver, block of laps) with the range as a residual filter. ``stints``:
    keys, stint_number, lap_start, lap_end, compound, tyre_age_at_start, stint_id (input order).
    """
    complete = stints.where(F.col("lap_start").isNotNull() & F.col("lap_end").isNotNull() & (F.col("lap_start") <= F.col("lap_end")))
    block = lambda c: F.floor(F.col(c) / bucket_laps)
    spread = complete.withColumn("_block", F.explode(F.sequence(block("lap_start"), block("lap_end"))))
    numbers = (laps if source is None else source).select(*keys, "lap_number").distinct().withColumn("_block", block("lap_number"))
    best = (
        numbers.join(spread, [*keys, "_block"])
        .where(F.col("lap_number").between(F.col("lap_start"), F.col("lap_end")))
        .groupBy(*keys, "lap_number")
        .agg(F.max_by(F.struct("stint_number", "lap_start", "compound", "tyre_age_at_start"), "stint_id").alias("_s"))
    )
    age = F.coalesce(F.col("_s.tyre_age_at_start").cast("double"), F.lit(0.0))
    found = F.col("_s").isNotNull()
    return join_on(laps, best, [*keys, "lap_number"]).withColumns(
        {
            "compound": F.col("_s.compound"),
            "stint": F.col("_s.stint_number").cast("double"),
            "tyre_life": F.when(found, age + F.col("lap_number") - F.col("_s.lap_start") + 1),
            "fresh_tyre": F.coalesce(found & (age == 0), F.lit(False)),
        }
    ).drop("_s")


# --- Fixed values: wording of the stewards' messages ---------------------------------------
DELETED_TIME = r"CAR (\d+) \((\w{3})\) TIME (\d+):(\d+\.\d+) DELETED"
DELETED_LAP = r"CAR (\d+) \((\w{3})\) LAP DELETED.*?LAP (\d+)"
DELETED_ANY = r"CAR (\d+) \((\w{3})\) (?:LAP|TIME [\d:.]+) DELETED"


def deleted_laps(laps: DataFrame, messages: DataFrame, split: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Add ``deleted``. ``source`` may be a cheaper table with the keys and times of ``laps``. A message names the lap by its time, by its number, or by being issued
    while the lap was in progress, in that order. ``laps``: session_key, driver_number,
    lap_number, lap_time_s, lap_start; ``messages``: session_key, date, message_id, message."""
    text = F.col("message")
    by_time, by_lap, in_progress = text.rlike(DELETED_TIME), text.rlike(DELETED_LAP), text.rlike(DELETED_ANY)
    found = messages.where(by_time | by_lap | in_progress).withColumns(
        {
            "how": F.when(by_time, "time").when(by_lap, "lap").otherwise("progress"),
            "driver_number": F.regexp_extract(text, r"CAR (\d+) \(", 1).try_cast("bigint"),
            "seconds": F.regexp_extract(text, DELETED_TIME, 3).try_cast("int") * 60
            + F.regexp_extract(text, DELETED_TIME, 4).try_cast("double"),
            "lap": F.regexp_extract(text, DELETED_LAP, 3).try_cast("double"),
        }
    )
    keys = ["session_key", "driver_number"]
    laps = laps.withColumn("driver_number", F.col("driver_number").cast("bigint"))
    key_laps = (laps if source is None else source.withColumn("driver_number", F.col("driver_number").cast("bigint"))).select(*keys, "lap_number", "lap_time_s", "lap_start")
    # Lap times within the tolerance fall into the message's bucket or a neighbouring one.
    slot = lambda c: F.floor(F.col(c) / (2 * DELETED_TIME_TOLERANCE_S))
    near = found.where("how = 'time'").select(
        *keys, "seconds", F.explode(F.array(slot("seconds") - 1, slot("seconds"), slot("seconds") + 1)).alias("_slot")
    )
    timed = (
        key_laps.where("lap_time_s is not null").withColumn("_slot", slot("lap_time_s"))
        .join(near, [*keys, "_slot"])
        .where(F.abs(F.col("lap_time_s") - F.col("seconds")) < DELETED_TIME_TOLERANCE_S)
        .select(*keys, "lap_number")
    )
    numbered = found.where("how = 'lap'").select(*keys, F.col("lap").alias("lap_number"))
    running = asof_backward(
        found.where("how = 'progress' and date is not null").select(*keys, "date"),
        key_laps, keys, "date", "lap_start", ["lap_number"], sequence="lap_number", split=split,
    ).where("lap_number is not null").select(*keys, "lap_number")
    marks = timed.unionByName(numbered).unionByName(running).distinct().withColumn("_deleted", F.lit(True))
    return join_on(laps.drop("deleted"), marks, [*keys, "lap_number"]).withColumn(
        "deleted", F.coalesce(F.col("_deleted"), F.lit(False))
    ).drop("_deleted")
