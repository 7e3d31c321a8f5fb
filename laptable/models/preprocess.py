"""Train-only preprocessing: imputation, missing indicators, scaling and one-hot columns.

Fitting is two aggregations (numeric statistics, category counts); applying is a column
expression that yields one ``features`` array per row and runs inside the JVM.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.functions.groups import percentiles

MISSING = "missing"
MIN_FREQUENCY = 2
#: Up to so many columns a row is kept with its zeros.
DENSE_WIDTH = 2048


@dataclass
class Preprocessor:
    numeric: list[str]
    medians: list[float]
    indicators: list[str]
    means: list[float]
    stds: list[float]
    categories: dict[str, dict[str, list[str]]]

    @property
    def width(self) -> int:
        return len(self.means) + sum(len(c["frequent"]) + bool(c["infrequent"]) for c in self.categories.values())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        return cls(**json.loads(text))


def _values(numeric: list[str]) -> list[Column]:
    out = []
    for c in numeric:
        value = F.col(c).cast("double")
        out.append(F.when(~F.isnan(value), value).alias(c))
    return out


def numeric_medians(train: DataFrame, numeric: list[str], split: bool = True) -> DataFrame:
    """(feature, median). A feature's group has every training row, so it is split."""
    long = train.select(*_values(numeric)).unpivot([], numeric, "feature", "value")
    return percentiles(long, ["feature"], "value", {"median": 0.5}, split)


#: Where the first look takes the bounds of a median from, on both sides of the middle, and the accuracy of its sketch.
NEAR, SKETCH = 0.002, 10_000


def exact_medians(train: DataFrame, numeric: list[str]) -> dict[str, float]:
    """The exact median of every numeric column that has values, for tables that are cheap to read again.

    One pass sketches bounds on both sides of each median, another counts the rows below them and the equal values between them, so
    only values near the medians are shuffled. A column whose bounds miss its median takes the way of ``numeric_medians``.
    """
    names = {f"_v{i}": c for i, c in enumerate(numeric)}
    rows = train.select(*[value.alias(n) for n, value in zip(names, _values(numeric))])
    shares = F.array(F.lit(0.5 - NEAR), F.lit(0.5 + NEAR))
    sketched = rows.agg(*[F.percentile_approx(n, shares, F.lit(SKETCH)).alias(n) for n in names]).first()
    bounds = {n: list(sketched[n]) for n in names if sketched[n] is not None}
    if not bounds:
        return {}
    counts = rows.agg(*[F.count(n).alias(n) for n in bounds], *[F.count_if(F.col(n) < F.lit(low)).alias(f"{n}_") for n, (low, _) in bounds.items()]).first()
    ranks = {n: (counts[n] - 1) / 2 - counts[f"{n}_"] for n in bounds}  # of the median, among the values between the bounds
    inside = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.col(n).between(F.lit(low), F.lit(high)), F.col(n)).alias("v")) for n, (low, high) in bounds.items()])
    kept = rows.select(F.explode(F.filter(inside, lambda s: s["v"].isNotNull())).alias("s")).groupBy("s.n", "s.v").agg(F.count(F.lit(1)).alias("c"))
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("n"))
    ended = kept.withColumn("end", F.sum("c").over(Window.partitionBy("n").orderBy("v")))
    at = [F.min(F.when(F.col("end") > f(rank), F.col("v"))).alias(name) for f, name in ((F.floor, "low"), (F.ceil, "high"))]
    met = {r["n"]: r for r in ended.groupBy("n").agg(*at).collect() if ranks[r["n"]] >= 0 and r["high"] is not None}  # one row per column
    out = {names[n]: r["low"] if r["low"] == r["high"] else 0.5 * r["low"] + 0.5 * r["high"] for n, r in met.items()}
    missed = [names[n] for n in bounds if n not in met]
    return out | ({r["feature"]: r["median"] for r in numeric_medians(train, missed).collect()} if missed else {})


def category_counts(train: DataFrame, categorical: list[str]) -> DataFrame:
    """(feature, value, rows); a missing value is a category of its own."""
    texts = [level_text(c).alias(c) for c in categorical]
    return train.select(*texts).unpivot([], categorical, "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str], split: bool = True, reread: bool = False) -> Preprocessor:
    """``reread``: the rows are stored, so medians may read them again instead of shuffling them."""
    if reread and numeric:
        medians = exact_medians(train, numeric)
    else:
        medians = {r["feature"]: r["median"] for r in numeric_medians(train, numeric, split).collect()}  # one row per feature
    kept = [c for c in numeric if c in medians]
    aggs = []
    for c, value in zip(kept, _values(kept)):
        filled, gap = F.coalesce(value, F.lit(medians[c])), value.isNull().cast("double")
        aggs += [F.avg(filled).alias(f"m_{c}"), F.stddev_pop(filled).alias(f"s_{c}"), F.avg(gap).alias(f"g_{c}"), F.stddev_pop(gap).alias(f"h_{c}")]
    stats = train.agg(*aggs).first().asDict() if kept else {}
    indicators = [c for c in kept if stats[f"g_{c}"] > 0]
    means = [stats[f"m_{c}"] for c in kept] + [stats[f"g_{c}"] for c in indicators]
    stds = [stats[f"s_{c}"] for c in kept] + [stats[f"h_{c}"] for c in indicators]
    counts = category_counts(train, categorical) if categorical else None
    categories: dict[str, dict[str, list[str]]] = {c: {"frequent": [], "infrequent": []} for c in categorical}
    if counts is not None:
        # The vocabulary is part of the fitted model: one entry per coefficient.
        for r in sorted(counts.collect(), key=lambda r: (r["feature"], r["value"])):
            categories[r["feature"]]["frequent" if r["rows"] >= MIN_FREQUENCY else "infrequent"].append(r["value"])
    return Preprocessor(kept, [medians[c] for c in kept], indicators, means, [s if s > 1e-12 else 1.0 for s in stds], categories)


def scaled_columns(spec: Preprocessor) -> list[Column]:
    """The numeric columns of a row, imputed and scaled, with the missing indicators behind them."""
    values = dict(zip(spec.numeric, _values(spec.numeric)))
    raw = [F.coalesce(values[c], F.lit(m)) for c, m in zip(spec.numeric, spec.medians)]
    raw += [values[c].isNull().cast("double") for c in spec.indicators]
    return [(v - F.lit(m)) / F.lit(s) for v, m, s in zip(raw, spec.means, spec.stds)]


def level_text(column: str) -> Column:
    """A category as text; a missing value is a category of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def level_positions(spec: Preprocessor) -> dict[str, dict[str, int]]:
    """Place of every known category among all columns; rare ones of a feature share a place."""
    at, out = len(spec.means), {}
    for column, known in spec.categories.items():
        out[column] = {v: at + i for i, v in enumerate(known["frequent"])}
        at += len(known["frequent"])
        out[column] |= dict.fromkeys(known["infrequent"], at)
        at += bool(known["infrequent"])
    return out


def _equals(text: Column):
    return lambda level: (level == text).cast("double")


def code_rows(df: DataFrame, spec: Preprocessor, out: str = "features") -> DataFrame:
    """Like ``apply_preprocessor`` without the zeros: ``values`` (scaled values and indicators, then a one) and ``places`` (the column
    of each category among all columns, -1 if unknown to training)."""
    places = []
    for i, (column, known) in enumerate(level_positions(spec).items()):
        if not known:
            continue
        words = df.sparkSession.createDataFrame(list(known.items()), f"_level{i} string, _place{i} int")
        # As long as the vocabulary, like the weights; a shuffle by level would meet all rows of a common one in one task.
        df = df.join(F.broadcast(words), level_text(column) == F.col(f"_level{i}"), "left").drop(f"_level{i}")
        places.append(f"_place{i}")
    values = F.array(*scaled_columns(spec), F.lit(1.0)).alias("values")
    found = F.array(*[F.coalesce(p, F.lit(-1)) for p in places]).cast("array<int>").alias("places")
    return df.withColumn(out, F.struct(values, found)).drop(*places)


def feature_rows(df: DataFrame, spec: Preprocessor) -> DataFrame:
    """Add ``features`` for the layers: whole rows of a short vocabulary, coded rows of a long one."""
    return apply_preprocessor(df, spec) if spec.width <= DENSE_WIDTH or not spec.categories else code_rows(df, spec)


def apply_preprocessor(df: DataFrame, spec: Preprocessor, out: str = "features") -> DataFrame:
    """Add the ``features`` array: scaled values and indicators, then one-hot columns. Rare
    training categories share one column; values unknown to training are all zeros."""
    scaled = scaled_columns(spec)
    blocks = [F.array(*scaled)] if scaled else []
    for column, known in spec.categories.items():
        text = level_text(column)
        if known["frequent"]:
            levels = F.array(*[F.lit(v) for v in known["frequent"]])
            blocks.append(F.transform(levels, _equals(text)))
        if known["infrequent"]:
            blocks.append(F.array(text.isin(known["infrequent"]).cast("double")))
    return df.withColumn(out, F.concat(*blocks))
