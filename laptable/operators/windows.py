"""History windows for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.functions.groups import join_on
from laptable.operators.features import assert_no_leakage
from laptable.operators.lap_state import runs_of
from laptable.schema import RAW_TARGET, RUN_KEYS, TARGET


def history_windows(table: DataFrame, columns: list[str], history: int = 5, back_fill: bool = False,
                    split: bool = False) -> DataFrame:
    """Fixed-length ``history x columns`` windows per run of a next-lap table.

    Missing and infinite values take the last known value of the run, else 0. ``back_fill``
    first fills leading gaps with the run's first known value, which looks ahead and is
    therefore off by default.
    """
    assert_no_leakage(columns)
    clean = table.withColumns(
        {f"_x{i}": F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for i, c in enumerate(columns)}
    )
    runs = runs_of(clean, split)
    names = [f"_x{i}" for i in range(len(columns))]
    df = runs.before(runs.df, last={f"_p{i}": F.col(c) for i, c in enumerate(names)})
    fallback = {c: F.lit(0.0) for c in names}
    if back_fill:
        firsts = clean.groupBy(*RUN_KEYS).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("lap_number"))).alias(f"_f{c}") for c in names])
        df = join_on(df, firsts, RUN_KEYS)
        fallback = {c: F.coalesce(F.col(f"_f{c}"), F.lit(0.0)) for c in names}
    filled = F.array(*[F.coalesce(F.col(c), F.col(f"_p{i}"), fallback[c]).cast("float") for i, c in enumerate(names)])
    df = runs.with_halo(df.withColumn("_filled", filled), before=history - 1, after=0)
    frame = runs.window().rowsBetween(-(history - 1), 0)
    df = runs.core(df.withColumn("window", F.collect_list("_filled").over(frame)))
    out = df.where(F.size("window") == history)
    return out.select(*RUN_KEYS, "lap_number", "window", TARGET, RAW_TARGET, "rolling_median_5")


def walk_forward(table: DataFrame, context_length: int = 32, stride: int = 1, value: str = "lap_time_s",
                 target: str = RAW_TARGET, min_context: int = 4, split: bool = False) -> DataFrame:
    """Histories of at least ``min_context`` and at most ``context_length`` laps ending at
    every ``stride``-th lap, with the true next lap. A context never holds its target."""
    if context_length < 1 or stride < 1:
        raise ValueError("context_length and stride must be >= 1")
    missing = [c for c in [*RUN_KEYS, "lap_number", value, target] if c not in table.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    runs = runs_of(table, split)
    df = runs.before(runs.df, total={"_index": F.lit(1)})
    df = runs.with_halo(df, before=context_length - 1, after=0)
    frame = runs.window().rowsBetween(-(context_length - 1), 0)
    df = runs.core(df.withColumn("context", F.collect_list(F.col(value).cast("float")).over(frame)))
    past = F.col("_index") - (min_context - 1)
    finite = F.col(target).isNotNull() & ~F.isnan(target)
    return df.where((past >= 0) & (past % stride == 0) & finite).select(
        *RUN_KEYS, "lap_number", "context", F.col(target).alias("actual_next_s")
    )
