"""Lap-for-lap comparison of two providers' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.functions.coerce import number
from laptable.functions.groups import count_if, percentiles
from laptable.schema import LAP_KEYS, ROUND_LAP_KEYS

# --- Fixed values: tolerance per numeric column; columns compared as text -----------------
TOLERANCES = {
    "lap_time_s": 0.002,
    "sector1_s": 0.002,
    "sector2_s": 0.002,
    "sector3_s": 0.002,
    "position": 0.0,
    "tyre_life": 0.0,
    "stint": 0.0,
    "air_temp_c": 0.6,
    "track_temp_c": 0.6,
    "humidity_pct": 3.0,
    "wind_speed_ms": 1.5,
}
EXACT = [
    "compound", "team", "circuit", "round_number", "event_date", "track_status", "pit_in", "pit_out", "is_accurate", "deleted",
    "fresh_tyre", "rainfall",
]


def match_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Official rounds when both tables carry any, else event names."""
    for df in (left, right):
        if "round_number" not in df.columns or df.where(number("round_number").isNotNull()).isEmpty():
            return LAP_KEYS
    return ROUND_LAP_KEYS


class ProviderComparison:
    """Coverage and agreement of two lap tables. Rows without a complete key, and every row
    of a key that occurs more than once, are counted and left out."""

    def __init__(self, left: DataFrame, right: DataFrame, keys: list[str] | None = None, exclude_first_lap: bool = True):
        self.keys = keys or match_keys(left, right)
        self.exclude_first_lap = exclude_first_lap
        left, right = (df.withColumns({"season": number("season").cast("int"), "lap_number": number("lap_number")}) for df in (left, right))
        seasons = left.select("season").distinct().intersect(right.select("season").distinct())
        # A handful of seasons; without the broadcast each season's laps would meet in one task.
        self.left = left.join(F.broadcast(seasons), "season", "left_semi")
        self.right = right.join(F.broadcast(seasons), "season", "left_semi")

    def _complete(self) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(k).isNotNull()
        return out

    def _counted(self) -> Column:
        complete = self._complete()
        return complete & (F.col("lap_number") > 1) if self.exclude_first_lap else complete

    def _columns(self) -> list[str]:
        shared = [c for c in [*TOLERANCES, *EXACT, "event"] if c in self.left.columns and c in self.right.columns]
        return [c for c in shared if c not in self.keys]

    def _sides(self, columns: list[str]) -> DataFrame:
        """Both tables under each other: the keys, and a row's values of ``columns`` as ``l`` or ``r``, each side with its own types."""
        sides = [df.select(*self.keys, F.struct(F.lit(True).alias("_in"), *[F.col(c) for c in columns]).alias(s)) for df, s in ((self.left, "l"), (self.right, "r"))]
        return sides[0].unionByName(sides[1], allowMissingColumns=True)

    def merged(self) -> DataFrame:
        """Keys that one side at least has exactly once, with that side's values. Both sides share one aggregation, and a key of many
        copies collapses map-side."""
        rows = self._sides(self._columns()).where(self._counted())
        keyed = rows.groupBy(*self.keys).agg(
            *[F.count(s).alias(f"_n{s}") for s in ("l", "r")], *[F.any_value(s, ignoreNulls=True).alias(s) for s in ("l", "r")]
        )
        return keyed.where("_nl = 1 or _nr = 1").select(*self.keys, *[F.when(F.col(f"_n{s}") == 1, F.col(s)).alias(s) for s in ("l", "r")])

    def coverage(self) -> DataFrame:
        """One row: laps per side, shared and one-sided laps, and what was left out. Rows without a complete key are one group."""
        complete = self._complete()
        rows = self._sides([]).where(self._counted() | ~complete).select(*[F.when(complete, F.col(k)).alias(k) for k in self.keys], "l", "r")
        keyed = rows.groupBy(*self.keys).agg(F.count("l").alias("_nl"), F.count("r").alias("_nr"))
        left, right = complete & (F.col("_nl") == 1), complete & (F.col("_nr") == 1)

        def total(condition: Column, rows: str) -> Column:
            return F.coalesce(F.sum(F.when(condition, F.col(rows))), F.lit(0))

        left_out = [
            (f"{side}_{what}", total(condition(n), n)) for side, n in (("left", "_nl"), ("right", "_nr"))
            for what, condition in (("duplicate_key", lambda n: complete & (F.col(n) > 1)), ("missing_key", lambda n: ~complete))
        ]
        return keyed.agg(
            count_if(left).alias("left_laps"), count_if(right).alias("right_laps"), count_if(left & right).alias("shared"),
            count_if(left & ~right).alias("left_only"), count_if(right & ~left).alias("right_only"), *[c.alias(name) for name, c in left_out],
        )

    def agreement(self) -> DataFrame:
        """Per shared column: rows with both values and the share that agrees. One pass."""
        both = self.merged().where(F.col("l").isNotNull() & F.col("r").isNotNull())
        aggs, names = [], []
        for c in self._columns():
            a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
            if c in TOLERANCES:
                a, b = number(a), number(b)
                ok = F.abs(a - b) <= TOLERANCES[c]
            else:
                ok = a.cast("string") == b.cast("string")
            present = a.isNotNull() & b.isNotNull()
            names.append(c)
            aggs.append(F.struct(count_if(present).alias("both_present"), count_if(ok & present).alias("agree")).alias(c))
        long = both.agg(*aggs).unpivot([], names, "column", "r")
        return long.select("column", "r.both_present", (F.try_divide(F.col("r.agree"), F.col("r.both_present"))).alias("agree_share"))

    def lap_time_differences(self, split: bool = True) -> DataFrame:
        """One row: median and p99 of the absolute lap-time difference, laps over one second."""
        diff = self._differences().withColumn("_all", F.lit(0))
        points = percentiles(diff, ["_all"], "diff", {"median_s": 0.5, "p99_s": 0.99}, split)
        return points.join(diff.groupBy("_all").agg(count_if(F.col("diff") > 1).alias("over_1s")), "_all").drop("_all")

    def _differences(self) -> DataFrame:
        both = self.merged().where(F.col("l").isNotNull() & F.col("r").isNotNull())
        a, b = number(F.col("l.lap_time_s")), number(F.col("r.lap_time_s"))
        return both.select(*self.keys, a.alias("left_s"), b.alias("right_s"), F.abs(a - b).alias("diff")).where("diff is not null")

    def largest_differences(self, n: int = 10) -> DataFrame:
        return self._differences().orderBy(F.desc("diff"), *self.keys).limit(n)

    def events(self) -> DataFrame:
        """Events only one side has, by round when laps are matched on rounds."""
        from laptable.operators.splits import event_set_diff

        ids = ["season", "round_number"] if self.keys == ROUND_LAP_KEYS else ["season", "event"]
        left, right = (
            df.where(self._counted()).groupBy(*ids).agg(F.min("event").alias("event_name")) for df in (self.left, self.right)
        )
        pieces = [
            event_set_diff(a, b, ids).withColumn("side", F.lit(side)) for a, b, side in ((left, right, "left"), (right, left, "right"))
        ]
        return pieces[0].unionByName(pieces[1])
