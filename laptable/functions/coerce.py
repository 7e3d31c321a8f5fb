"""Scalar column expressions: coercion, parsing, binning, banding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing value in hand-made files.
BLANK_TEXTS = ["", "nan", "None"]


def number(column: Column | str) -> Column:
    """Double, null where the value is not a number (NaN counts as missing)."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def flag(column: Column | str) -> Column:
    """Boolean, false where the value is missing."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.try_cast("boolean"), F.lit(False))


def true_text(column: Column) -> Column:
    """Boolean from provider text: only ``true`` (any case) is true."""
    return F.coalesce(F.lower(column.cast("string")) == "true", F.lit(False))


def timestamp(column: Column | str) -> Column:
    """ISO-8601 text, with or without fractional seconds, to a UTC timestamp; else null."""
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column)


def is_blank(column: Column | str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.isNull() | F.trim(value.cast("string")).isin(BLANK_TEXTS)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column: Spark aggregates treat NaN as a value."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def lap_seconds(text: Column) -> Column:
    """``1:31.234`` / ``1:02:03.4`` / plain seconds to seconds; anything else is null."""
    parts = F.split(text, ":")
    whole = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2)]
    last = F.element_at(parts, -1).try_cast("double")
    return (
        F.when(F.size(parts) == 1, last)
        .when(F.size(parts) == 2, whole[0] * 60 + last)
        .when(F.size(parts) == 3, whole[0] * 3600 + whole[1] * 60 + last)
    )


def _accents() -> tuple[str, str, dict[str, str]]:
    """Accented Latin letters (Latin-1 to Latin Extended-B and Additional) and their base letters."""
    source, target, wide = "", "", {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        plain = "".join(ch for ch in plain if ch.isalpha())
        if len(plain) == 1:
            source, target = source + letter, target + plain
        elif plain:
            wide[letter] = plain
    return source, target, wide


ACCENTS, PLAIN, WIDE = _accents()


def letter_code(text: Column) -> Column:
    """Three upper-case ASCII letters of a name, accents stripped; ``UNK`` when none is left."""
    folded = F.translate(text, ACCENTS, PLAIN)
    for letter, plain in WIDE.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    letters = F.substring(F.upper(F.regexp_replace(folded, "[^A-Za-z]", "")), 1, 3)
    return F.when(F.length(letters) > 0, letters).otherwise(F.lit("UNK"))


def driver_code(code: Column, surname: Column) -> Column:
    """Official code when there is one, else the first letters of the surname."""
    official = F.when(F.length(F.trim(code)) > 0, F.trim(code))
    return letter_code(F.coalesce(official, surname, F.lit("UNK")))


def wind_components(degrees: Column) -> dict[str, Column]:
    angle = F.radians(degrees)
    return {"wind_dir_sin": F.sin(angle), "wind_dir_cos": F.cos(angle)}


def weather_bins() -> dict[str, Column]:
    """Condition bins; halves round to the even bin."""

    def binned(column: str, width: float) -> Column:
        return F.bround(number(column) / width, 0) * width

    return {
        "track_temp_bin": binned("track_temp_c", 5.0),
        "air_temp_bin": binned("air_temp_c", 4.0),
        "humidity_bin": binned("humidity_pct", 10.0),
        "wind_bin": binned("wind_speed_ms", 2.0),
        "rain_state": flag("rainfall").cast("int"),
    }


def driver_team() -> Column:
    return F.concat(
        F.coalesce(F.col("driver").cast("string"), F.lit("None")),
        F.lit("@"),
        F.coalesce(F.col("team").cast("string"), F.lit("None")),
    )


def event_order(columns: list[str]) -> Column:
    """Day number that orders events: the event date, else the season start (plus the round
    as days when the table has rounds but no dates at all)."""
    start = F.make_date(F.col("season").cast("int"), F.lit(1), F.lit(1))
    if "event_date" in columns:
        parsed = F.try_to_date(F.substring(F.col("event_date").cast("string"), 1, 10))
        return F.unix_date(F.coalesce(parsed, start))
    return F.unix_date(F.date_add(start, F.coalesce(number("round_number"), F.lit(0.0)).cast("int")))


def band(value: Column, edges: list[float], labels: list[str], missing: str = "unknown") -> Column:
    """Label of the right-closed band (edges[i], edges[i+1]] a value falls in."""
    out = F.when(value <= edges[0], F.lit(missing))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= upper, F.lit(label))
    return out.otherwise(F.lit(missing))


# --- Fixed values: band edges and labels --------------------------------------------------
TYRE_AGE = ([0, 5, 15, 30, 999], ["1-5 laps", "6-15 laps", "16-30 laps", "31+ laps"])
RUNNING_POSITION = ([0, 3, 10, 99], ["P1-P3", "P4-P10", "P11+"])
CLEAN_LAP_DEPTH = ([0, 1, 4, 10, 999], ["1 (first clean lap)", "2-4", "5-10", "11+"])
RACE_PHASE = ([0, 0.33, 0.66, 1.0], ["opening third", "middle third", "final third"])


def condition_bands(race_length: Column) -> dict[str, Column]:
    """Condition labels of one lap; ``race_length`` is the last lap of its event."""
    phase = number("lap_number") / race_length
    wet = F.coalesce(F.lower(F.col("rainfall").cast("string")).isin("true", "1", "1.0"), F.lit(False))
    return {
        "tyre_age": band(number("tyre_life"), *TYRE_AGE),
        "conditions": F.when(wet, "wet").otherwise("dry"),
        "running_position": band(number("position"), *RUNNING_POSITION),
        "clean_lap_depth": band(number("laps_in_segment"), *CLEAN_LAP_DEPTH),
        "race_phase": band(phase, *RACE_PHASE, missing="nan"),
    }
