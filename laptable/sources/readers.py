"""Reading and writing lap tables, predictions and run records."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laptable.functions.coerce import nan_to_null
from laptable.operators.features import fill_defaults
from laptable.schema import LAP_SCHEMA


TYPES = {f.name: f.dataType for f in LAP_SCHEMA}


def _raw_tables(spark: SparkSession, paths: tuple[str, ...]) -> list[DataFrame]:
    return [spark.read.csv(p, header=True) if p.endswith(".csv") else spark.read.parquet(p) for p in paths]


def _typed(table: DataFrame, column: str) -> Column:
    """A column in its type of the lap schema. One that has it already stays a plain column, so that
    filters on it still reach the file."""
    kind, wanted = table.schema[column].dataType, TYPES.get(column)
    cell = F.col(f"`{column}`")
    if wanted is None or kind == wanted:
        return cell
    # A fraction in a whole-number column is a bad cell; a cast between numbers would cut it off.
    if wanted == T.IntegerType() and isinstance(kind, T.FractionalType):
        return F.when(cell == F.floor(cell), cell.cast("string").try_cast("double").try_cast(wanted)).alias(column)
    plain = isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)) or wanted == T.StringType()
    return (cell if plain else cell.cast("string")).try_cast(wanted).alias(column)


def scan_laps(spark: SparkSession, *paths: str, defaults: bool = False) -> DataFrame:
    """One lap table from parquet or CSV files or folders, each path typed by name from the lap
    schema, whatever types it was written with; no inference pass reads the data twice.

    A cell that does not fit its type is null (``bad_cells`` counts them), NaN is null, a column
    outside the schema keeps its type, and one that a path lacks is null there. With ``defaults``
    the optional columns that no path has are added.
    """
    tables = [t.select(*[_typed(t, c) for c in t.columns]) for t in _raw_tables(spark, paths)]
    laps = nan_to_null(union_sessions(tables))
    return fill_defaults(laps) if defaults else laps


def bad_cells(spark: SparkSession, *paths: str) -> DataFrame:
    """(column, rows, bad): cells with a value that ``scan_laps`` reads as null, per column of the lap
    schema found in a path. One aggregation over all paths; a NaN is a missing value, not a bad cell."""
    counts = []
    for table in _raw_tables(spark, paths):
        cells = []
        for c in (c for c in table.columns if c in TYPES):
            given = F.col(f"`{c}`")
            if table.schema[c].dataType in (T.DoubleType(), T.FloatType()):
                given = F.when(~F.isnan(given), given)
            bad = given.isNotNull() & _typed(table, c).isNull()
            cells.append(F.struct(F.lit(c).alias("column"), bad.cast("long").alias("bad")))
        if cells:
            counts.append(table.select(F.inline(F.array(*cells))))
    if not counts:
        return spark.createDataFrame([], "column string, rows long, bad long")
    return union_sessions(counts).groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.sum("bad").alias("bad"))


def union_sessions(tables: list[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def tier_counts(laps: DataFrame) -> DataFrame:
    """Laps and events per season and tier."""
    return laps.groupBy("season", "data_tier").agg(
        F.count(F.lit(1)).alias("laps"), F.count_distinct("event").alias("events")
    )


def write_laps(laps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per season, event and session. Adaptive execution deals the rows out by session
    and splits a session only where it is large."""
    keys = ["season", "event", "session"]
    laps.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_predictions(predictions: DataFrame, path: str, metrics: DataFrame | None = None, mode: str = "overwrite") -> None:
    predictions.write.mode(mode).parquet(f"{path}/predictions")
    if metrics is not None:
        metrics.write.mode(mode).json(f"{path}/metrics")


def table_fingerprint(df: DataFrame, history: int, rules: int) -> DataFrame:
    """Content hash of a table, independent of row order: rows, sum of row hashes, and the
    columns, history and rule version that decide what a feature table built from it holds."""
    columns = ",".join(f"{name}:{kind}" for name, kind in df.dtypes)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"),
    ).withColumns({"columns": F.lit(columns), "history": F.lit(history), "lap_validity_version": F.lit(rules)})


def cached_features(raw: DataFrame, folder: str, build, history: int, rules: int) -> DataFrame:
    """Feature table from a cache folder keyed by the fingerprint of ``raw``; built on a miss."""
    spark = raw.sparkSession
    key = table_fingerprint(raw, history, rules).select(F.sha2(F.to_json(F.struct("*")), 256)).first()[0]
    path = f"{folder}/features_{key[:24]}"
    # The marker is written after the table, so a build that was cut off is done again.
    marker = f"{path}_done"
    try:
        finished = not spark.read.parquet(marker).isEmpty()
    except AnalysisException:
        finished = False
    if not finished:
        build(raw).write.mode("overwrite").parquet(path)
        spark.createDataFrame([(key,)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(marker)
    return spark.read.parquet(path)
