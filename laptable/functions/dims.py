"""Fixed dimensions: names that change between seasons, and session codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: constructor id -> team name, with the seasons a name is valid in -------
TEAM_NAMES = {
    "red_bull": "Red Bull Racing",
    "mercedes": "Mercedes",
    "ferrari": "Ferrari",
    "mclaren": "McLaren",
    "williams": "Williams",
    "renault": "Renault",
    "alpine": "Alpine",
    "haas": "Haas F1 Team",
    "toro_rosso": "Toro Rosso",
    "alphatauri": "AlphaTauri",
    "force_india": "Force India",
    "racing_point": "Racing Point",
    "aston_martin": "Aston Martin",
    "audi": "Audi",
    "cadillac": "Cadillac",
}
TEAM_STEPS = [
    ("rb", 0, 2024, "RB"),
    ("rb", 2025, 9999, "Racing Bulls"),
    ("sauber", 0, 2023, "Sauber"),
    ("sauber", 2024, 9999, "Kick Sauber"),
    ("alfa", 0, 2021, "Alfa Romeo Racing"),
    ("alfa", 2022, 9999, "Alfa Romeo"),
]

# --- Fixed values: circuit id -> location ---------------------------------------------------
CIRCUIT_LOCATIONS = {
    "bahrain": "Sakhir",
    "jeddah": "Jeddah",
    "albert_park": "Melbourne",
    "baku": "Baku",
    "miami": "Miami",
    "imola": "Imola",
    "monaco": "Monaco",
    "catalunya": "Barcelona",
    "villeneuve": "Montréal",
    "red_bull_ring": "Spielberg",
    "silverstone": "Silverstone",
    "hungaroring": "Budapest",
    "spa": "Spa-Francorchamps",
    "zandvoort": "Zandvoort",
    "monza": "Monza",
    "marina_bay": "Marina Bay",
    "suzuka": "Suzuka",
    "losail": "Lusail",
    "americas": "Austin",
    "rodriguez": "Mexico City",
    "interlagos": "São Paulo",
    "vegas": "Las Vegas",
    "yas_marina": "Yas Island",
    "shanghai": "Shanghai",
    "sochi": "Sochi",
    "ricard": "Le Castellet",
    "hockenheimring": "Hockenheim",
    "istanbul": "Istanbul",
    "nurburgring": "Nürburgring",
    "portimao": "Portimão",
    "mugello": "Mugello",
    "sepang": "Kuala Lumpur",
}

# --- Fixed values: event name -> location, and the events whose location was renamed -------
EVENT_LOCATIONS = {
    "70th Anniversary Grand Prix": "Silverstone",
    "Australian Grand Prix": "Melbourne",
    "Austrian Grand Prix": "Spielberg",
    "Azerbaijan Grand Prix": "Baku",
    "Bahrain Grand Prix": "Sakhir",
    "Barcelona Grand Prix": "Barcelona",
    "Belgian Grand Prix": "Spa-Francorchamps",
    "Brazilian Grand Prix": "São Paulo",
    "British Grand Prix": "Silverstone",
    "Canadian Grand Prix": "Montréal",
    "Chinese Grand Prix": "Shanghai",
    "Dutch Grand Prix": "Zandvoort",
    "Eifel Grand Prix": "Nürburgring",
    "Emilia Romagna Grand Prix": "Imola",
    "French Grand Prix": "Le Castellet",
    "German Grand Prix": "Hockenheim",
    "Hungarian Grand Prix": "Budapest",
    "Italian Grand Prix": "Monza",
    "Japanese Grand Prix": "Suzuka",
    "Las Vegas Grand Prix": "Las Vegas",
    "Malaysian Grand Prix": "Kuala Lumpur",
    "Mexican Grand Prix": "Mexico City",
    "Mexico City Grand Prix": "Mexico City",
    "Portuguese Grand Prix": "Portimão",
    "Qatar Grand Prix": "Lusail",
    "Russian Grand Prix": "Sochi",
    "Sakhir Grand Prix": "Sakhir",
    "Saudi Arabian Grand Prix": "Jeddah",
    "Spanish Grand Prix": "Barcelona",
    "Styrian Grand Prix": "Spielberg",
    "São Paulo Grand Prix": "São Paulo",
    "Turkish Grand Prix": "Istanbul",
    "Tuscan Grand Prix": "Mugello",
    "United States Grand Prix": "Austin",
}
EVENT_STEPS = [
    ("Abu Dhabi Grand Prix", 0, 2018, "Yas Marina"),
    ("Abu Dhabi Grand Prix", 2019, 9999, "Yas Island"),
    ("Miami Grand Prix", 0, 2024, "Miami"),
    ("Miami Grand Prix", 2025, 9999, "Miami Gardens"),
    ("Monaco Grand Prix", 0, 2021, "Monte Carlo"),
    ("Monaco Grand Prix", 2022, 2025, "Monaco"),
    ("Monaco Grand Prix", 2026, 9999, "Monte Carlo"),
    ("Singapore Grand Prix", 0, 2021, "Singapore"),
    ("Singapore Grand Prix", 2022, 9999, "Marina Bay"),
]

# --- Fixed values: session names, codes and running order of a weekend ---------------------
SESSION_NAMES = {
    "Race": "R",
    "Sprint": "S",
    "Qualifying": "Q",
    "Sprint Qualifying": "SQ",
    "Sprint Shootout": "SS",
    "Practice 1": "FP1",
    "Practice 2": "FP2",
    "Practice 3": "FP3",
}
SPRINT_CODES = ["S", "SQ", "SS"]
CONVENTIONAL = {"FP1": 0, "FP2": 1, "FP3": 2, "Q": 3, "R": 6}
SPRINT_TO_2022 = {"FP1": 0, "Q": 1, "FP2": 2, "S": 4, "R": 6}
SPRINT_2023 = {"FP1": 0, "Q": 1, "SS": 2, "S": 4, "R": 6}
SPRINT_FROM_2024 = {"FP1": 0, "SQ": 1, "S": 2, "Q": 3, "R": 6}
OTHER_RANK = 5


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _steps(df: DataFrame, key: str, season: str, out: str, fixed: dict[str, str], steps: list[tuple]) -> DataFrame:
    """Validity-range join with a constant dimension (a few dozen rows, so broadcast)."""
    rows = [(k, 0, 9999, v) for k, v in fixed.items()] + steps
    dim = df.sparkSession.createDataFrame(rows, "_dim_ref string, _dim_from int, _dim_to int, _dim_name string")
    on = (F.col(key) == F.col("_dim_ref")) & F.col(season).between(F.col("_dim_from"), F.col("_dim_to"))
    return df.join(F.broadcast(dim), on, "left").withColumnRenamed("_dim_name", out).drop("_dim_ref", "_dim_from", "_dim_to")


def with_team(df: DataFrame, constructor: str, season: str, given_name: str, out: str = "team") -> DataFrame:
    """Team name of a constructor in a season; unknown constructors keep their given name."""
    joined = _steps(df, constructor, season, "_team", TEAM_NAMES, TEAM_STEPS)
    name = F.when(F.col(constructor).isNotNull(), F.coalesce(F.col("_team"), F.col(given_name)))
    return joined.withColumn(out, name).drop("_team")


def with_location(df: DataFrame, circuit: str, given_location: str, out: str = "circuit") -> DataFrame:
    """Location of a circuit id; unknown ids keep the given location."""
    known = F.try_element_at(literal_map(CIRCUIT_LOCATIONS), F.col(circuit))
    return df.withColumn(out, F.coalesce(known, F.col(given_location)))


def with_event_location(df: DataFrame, event: str, season: str, out: str = "circuit") -> DataFrame:
    """Location of an event in a season; unknown events use their name without the suffix."""
    joined = _steps(df, event, season, "_where", EVENT_LOCATIONS, EVENT_STEPS)
    rest = F.replace(F.col(event), F.lit(" Grand Prix"), F.lit(""))
    return joined.withColumn(out, F.coalesce(F.col("_where"), rest)).drop("_where")


def session_code(column: Column) -> Column:
    """Code of a session given as a code or spelled out, in any case, with stray blanks."""
    text = F.upper(F.trim(column.cast("string")))
    return F.coalesce(F.try_element_at(literal_map({k.upper(): v for k, v in SESSION_NAMES.items()}), text), text)


def weekend_rank(code: Column, season: Column, sprint: Column) -> Column:
    """Place of a session in its weekend; an unknown season uses the current sprint order."""

    def rank(order: dict[str, int]) -> Column:
        return F.coalesce(F.try_element_at(literal_map(order), code), F.lit(OTHER_RANK))

    return (
        F.when(~sprint, rank(CONVENTIONAL))
        .when(season < 2023, rank(SPRINT_TO_2022))
        .when(season < 2024, rank(SPRINT_2023))
        .otherwise(rank(SPRINT_FROM_2024))
    )
