"""Ordered windows and exact percentiles over groups of any size.

Spark evaluates a window (and an exact percentile) of one group in one task. That is the
right plan while every group is small: a driver's laps in a session are tens of rows. It
breaks when one group may hold a large part of the table. Which of the two holds is known from
what the group means, so callers say it: ``split=False`` (the default) for groups that are
small by nature, ``split=True`` for groups without a bound. No plan is chosen by counting.
``OrderedGroups`` offers the same operations either way:

* ``window()``        a window spec that sees every row of a group in order
* ``before()``        last non-null value / sum over all earlier rows of the group
* ``after()``         first non-null value over all later rows of the group
* ``with_halo()``     copies of a few neighbouring rows, so bounded frames are complete

With ``split=True`` the rows are range-partitioned by (group, order) and stored once, so a
large group is spread over many tasks, and only one small summary row per group and partition
crosses the cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.session import cut_lineage

#: Percentiles of unbounded groups first look for their ranks in 2 ** SLICE_BITS slices of distinct values.
SLICE_BITS = 10


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition in which a missing key matches a missing key."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join that keeps the key columns of the left side only."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def unpruned(df: DataFrame, unfiltered: bool = False) -> DataFrame:
    """The same rows; every column is needed here, so plans that read ``df`` share the shuffles below instead of each making its own
    with fewer columns. (A hash is never below the smallest number; behind a window or a count Spark cannot move the condition.)
    With ``unfiltered`` it has every row too: no later condition moves below it. (A random share is never below 0.)"""
    kept = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]) >= F.lit(-(2**63))
    return df.where(kept & (F.rand(1) >= 0) if unfiltered else kept)


class OrderedGroups:
    def __init__(self, df: DataFrame, keys: list[str], order: list[str], split: bool = False,
                 chunks: int | None = None):
        self.keys = list(keys)
        self.order = list(order)
        self.split = split
        if not split:
            self.df = df
            return
        if chunks is None:
            chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Exact copies are told apart by an arbitrary number, so they can be cut as well;
        # which copy gets which number makes no difference to any result.
        numbered = df.withColumn("_content", F.xxhash64(*df.columns)).withColumn(
            "_copy", F.monotonically_increasing_id()
        )
        self.order = self.order + ["_content", "_copy"]
        ranged = numbered.repartitionByRange(chunks, *self.keys, *self.order)
        self.df = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))

    @property
    def group(self) -> list[str]:
        return (["_chunk"] if self.split else []) + self.keys

    def window(self, descending: bool = False):
        order = [F.col(c).desc() if descending else F.col(c) for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*order)

    def before(self, df: DataFrame, last: dict[str, Column] | None = None,
               total: dict[str, Column] | None = None) -> DataFrame:
        """Add, per row, the last non-null value / the sum over all earlier rows of its group."""
        return self._reach(df, last or {}, total or {}, backward=False)

    def after(self, df: DataFrame, first: dict[str, Column]) -> DataFrame:
        """Add, per row, the first non-null value over all later rows of its group.

        It is ``before()`` on the reversed order, so every row is met once. The order should
        tell rows apart; of rows that tie in it, each sees the others before or after it.
        """
        return self._reach(df, first, {}, backward=True)

    def _reach(self, df: DataFrame, nearest: dict[str, Column], total: dict[str, Column], backward: bool) -> DataFrame:
        passed = self.window(descending=backward).rowsBetween(Window.unboundedPreceding, -1)
        local = {n: F.last(e, ignorenulls=True).over(passed) for n, e in nearest.items()}
        local |= {n: F.coalesce(F.sum(e).over(passed), F.lit(0)) for n, e in total.items()}
        out = df.withColumns(local)
        if not self.split:
            return out
        place, outermost = F.struct(*self.order), F.min_by if backward else F.max_by
        per_chunk = df.groupBy(*self.group).agg(
            *[outermost(F.when(e.isNotNull(), e), F.when(e.isNotNull(), place)).alias(f"_c_{n}")
              for n, e in nearest.items()],
            *[F.sum(e).alias(f"_c_{n}") for n, e in total.items()],
        )
        chunk = F.col("_chunk").desc() if backward else F.col("_chunk")
        chunks = Window.partitionBy(*(self.keys or [F.lit(1)])).orderBy(chunk)
        past = chunks.rowsBetween(Window.unboundedPreceding, -1)
        carried = per_chunk.select(
            *self.group,
            F.lag(F.lit(True)).over(chunks).alias("_continues"),
            *[F.last(f"_c_{n}", ignorenulls=True).over(past).alias(f"_c_{n}") for n in nearest],
            *[F.sum(f"_c_{n}").over(past).alias(f"_c_{n}") for n in total],
        ).where("_continues").drop("_continues")
        # At most one group continues into a chunk, so this side has one row per chunk.
        out = join_on(out, F.broadcast(carried), self.group)
        out = out.withColumns(
            {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in nearest}
            | {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in total}
        )
        return out.drop(*[f"_c_{n}" for n in [*nearest, *total]])

    def with_halo(self, df: DataFrame, before: int, after: int) -> DataFrame:
        """Add the ``before`` / ``after`` neighbouring rows of other chunks, marked ``_halo``."""
        if not self.split:
            return df
        chunks = Window.partitionBy(*self.keys).orderBy("_chunk")
        spans = (
            df.select(*self.group).distinct()
            .withColumns(
                {
                    "_next": F.array_compact(F.array(*[F.lead("_chunk", k).over(chunks) for k in range(1, before + 1)])),
                    "_past": F.array_compact(F.array(*[F.lag("_chunk", k).over(chunks) for k in range(1, after + 1)])),
                }
            )
            .where("size(_next) + size(_past) > 0")
        )
        # Only the first and the last group of a chunk can reach into another chunk.
        touching = join_on(df, F.broadcast(spans), self.group, "inner")
        ranked = touching.withColumns(
            {
                "_from_end": F.row_number().over(self.window(descending=True)),
                "_from_start": F.row_number().over(self.window()),
            }
        )
        copies = []
        for rank, bound, targets in (("_from_end", before, "_next"), ("_from_start", after, "_past")):
            copies.append(
                ranked.where(F.col(rank) <= bound)
                .withColumn("_chunk", F.explode(targets))
                .select(*df.columns, F.lit(True).alias("_halo"))
            )
        return df.withColumn("_halo", F.lit(False)).unionByName(copies[0]).unionByName(copies[1])

    def core(self, df: DataFrame) -> DataFrame:
        """Drop halo rows again."""
        return df.where(~F.col("_halo")).drop("_halo") if self.split else df

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop("_chunk", "_content", "_copy")


def _sliced(counted: DataFrame, group: list[str], value: str, one_group: bool) -> DataFrame:
    """Add ``_slice``, the number of the group's sketched bounds below the value, by bisection."""
    slices = 2**SLICE_BITS
    shares = F.expr(f"array({', '.join(f'{i / slices}D' for i in range(1, slices))})")
    bounds = counted.groupBy(*group).agg(F.percentile_approx(value, shares, 10 * slices).alias("_bounds"))
    steps = F.array(*[F.lit(2**k) for k in reversed(range(SLICE_BITS))])

    def further(at: Column, step: Column) -> Column:
        return at + F.when(F.get("_bounds", at + step - 1) < F.col(value), step).otherwise(0)

    joined = join_on(counted, F.broadcast(bounds) if one_group else bounds, group, "inner")
    return joined.withColumn("_slice", F.aggregate(steps, F.lit(0), further)).drop("_bounds")


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float],
                split: bool = False) -> DataFrame:
    """Exact linear-interpolation percentiles of ``value`` per group (nulls ignored).

    Without keys the whole table is one group and the result has one row, also when the table is
    empty. With ``split=True`` equal values are counted first and cut into slices of about as many
    distinct values each, at bounds from a mergeable quantile sketch per group, so neither the
    range of the values nor their crowding matters. The wanted ranks are found among the slices'
    counts, and only the slices that hold one are ordered. The sketch decides where the cuts lie,
    never the result.
    """
    present = df.where(F.col(value).isNotNull())
    if not split:
        return present.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(p)).alias(n) for n, p in points.items()]
        )
    group = keys or ["_all"]
    counted = (present if keys else present.withColumn("_all", F.lit(0))).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    counted = _sliced(counted, group, value, one_group=not keys)
    slices = Window.partitionBy(*group).orderBy("_slice")
    past = slices.rowsBetween(Window.unboundedPreceding, -1)
    sized = counted.groupBy(*group, "_slice").agg(F.sum("_n").alias("_in")).withColumns(
        {
            "_before": F.coalesce(F.sum("_in").over(past), F.lit(0)),
            "_rows": F.sum("_in").over(Window.partitionBy(*group)),
        }
    )
    position = {n: (F.col("_rows") - 1) * F.lit(float(p)) for n, p in points.items()}
    ranks = [f(x) for x in position.values() for f in (F.floor, F.ceil)]
    held = reduce(lambda a, b: a | b, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_in")) for r in ranks])
    near = join_on(counted, sized.where(held).drop("_in"), [*group, "_slice"], "inner")
    inside = Window.partitionBy(*group, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ordered = near.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))

    def at(rank):
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value)))

    aggs = [F.max("_rows").alias("_rows")]
    for name, x in position.items():
        aggs += [at(F.floor(x)).alias(f"_lo_{name}"), at(F.ceil(x)).alias(f"_hi_{name}")]
    picked = ordered.groupBy(*keys).agg(*aggs)

    def between(name, x):
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return picked.select(*keys, *[between(n, x).alias(n) for n, x in position.items()])
