"""Race-control messages to timed status intervals, and interval arithmetic.

The message log of a session drives several independent open/close processes (yellow per
sector, safety car, virtual safety car, red flag). Each is written as two markers, "opens
here" and "closes here"; a window over the ordered log then tells whether the process is open
before a message, and a period is emitted on the message that closes it. No per-row state
code is needed, and a very long log is ordered across tasks like any other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.functions.groups import OrderedGroups, join_on

# --- Fixed values: status codes in the order a status text lists them --------------------
STATUS_ORDER = ["1", "2", "4", "5", "6", "7"]
YELLOW, SAFETY_CAR, RED, VSC, VSC_ENDING = "2", "4", "5", "6", "7"
BLOCKING = [SAFETY_CAR, RED, VSC, VSC_ENDING]
CLEAR_TRACK_SLACK_S = 0.5


def _message_kinds() -> dict[str, Column]:
    """What a message means, from its category, flag, scope and text."""
    category = F.coalesce(F.col("category"), F.lit(""))
    flag = F.upper(F.coalesce(F.col("flag"), F.lit("")))
    sector_scope = F.coalesce(F.col("scope"), F.lit("")) == "Sector"
    text = F.upper(F.coalesce(F.col("message"), F.lit("")))

    def has(words: str) -> Column:
        return F.contains(text, F.lit(words))

    is_flag, status, car, other = (category == c for c in ("Flag", "SessionStatus", "SafetyCar", "Other"))
    virtual = has("VIRTUAL") | F.startswith(text, F.lit("VSC"))
    return {
        "yellow_key": F.when(sector_scope, F.concat(F.lit("sector-"), F.coalesce(F.col("sector").cast("string"), F.lit("None")))).otherwise("track"),
        "yellow": is_flag & flag.isin("YELLOW", "DOUBLE YELLOW"),
        "sector_clear": is_flag & (flag == "CLEAR") & sector_scope,
        "track_clear": is_flag & ((flag == "GREEN") | ((flag == "CLEAR") & ~sector_scope)),
        "stopped": (is_flag & (flag == "RED")) | (status & (has("ABORTED") | has("SUSPENDED"))),
        "running": status & (has("RESUMED") | has("STARTED")),
        "started": status & has("STARTED"),
        "vsc_on": car & virtual & has("DEPLOYED"),
        "vsc_off": car & virtual & ~has("DEPLOYED") & has("ENDING"),
        "sc_on": car & ~virtual & has("DEPLOYED"),
        "sc_in": car & ~virtual & ~has("DEPLOYED") & has("IN THIS LAP"),
        "behind_sc": other & has("BEHIND THE SAFETY CAR"),
        "rolling_start": other & ~has("BEHIND THE SAFETY CAR") & has("ROLLING START"),
    }


def _on_off(opens: Column, closes: Column) -> Column:
    return F.when(opens, F.lit(True)).when(closes, F.lit(False))


def _periods(log: DataFrame, groups: OrderedGroups, opens: Column, closes: Column, code: str,
             restarts: bool = False) -> DataFrame:
    """Periods of one process. Opening an open process keeps the earlier start, or begins anew
    when ``restarts``."""
    is_open = groups.before(log, last={"_open": _on_off(opens, closes)})
    begins = opens if restarts else opens & ~F.coalesce(F.col("_open"), F.lit(False))
    since = groups.before(is_open, last={"_since": F.when(begins, F.col("date"))})
    return since.where(closes & F.coalesce(F.col("_open"), F.lit(False))).select(
        *groups.keys, F.col("_since").alias("start"), F.col("date").alias("end"), F.lit(code).alias("code")
    )


def track_status_intervals(messages: DataFrame, sessions: DataFrame, split: bool = False) -> DataFrame:
    """(session_key, start, end, code) of every status period.

    ``messages``: session_key, date, message_id (input order), category, flag, scope, sector,
    message. ``sessions``: session_key, session_end. Periods still open close at session end;
    yellow time under a neutralisation is removed.
    """
    log = messages.select("session_key", "date", "message_id", F.lit(False).alias("is_end"), *[
        e.alias(n) for n, e in _message_kinds().items()
    ])
    # The session end is one more message, after all others.
    flags = [c for c, t in log.dtypes if t == "boolean" and c != "is_end"]
    ends = sessions.select(
        "session_key", F.col("session_end").alias("date"), F.lit(None).cast("bigint").alias("message_id"),
        F.lit(True).alias("is_end"), F.lit("track").alias("yellow_key"), *[F.lit(False).alias(c) for c in flags],
    )
    log = log.withColumn("message_id", F.col("message_id").cast("bigint")).unionByName(ends)
    groups = OrderedGroups(log, ["session_key"], ["is_end", "date", "message_id"], split)
    end, stop, clear = F.col("is_end"), F.col("stopped"), F.col("track_clear")

    red_on = groups.before(groups.df, last={"_red": _on_off(stop, clear | F.col("running"))})
    free_start = F.col("started") & ~F.col("stopped") & ~F.coalesce(F.col("_red"), F.lit(False))
    announced = groups.before(red_on, last={"_behind": _on_off(F.col("behind_sc"), free_start)})
    sc_opens = F.col("sc_on") | (free_start & F.coalesce(F.col("_behind"), F.lit(False)))
    named = announced.withColumn("sc_opens", sc_opens)
    marked = groups.before(named, last={"_in_lap": _on_off(F.col("sc_in"), F.col("sc_opens"))})
    sc_closes = (clear & F.coalesce(F.col("_in_lap"), F.lit(False))) | stop | F.col("rolling_start") | end
    vsc = groups.before(groups.df, last={"_vsc": _on_off(F.col("vsc_on"), F.col("vsc_off") | stop | end)})
    ending = vsc.withColumn("ends_now", F.col("vsc_off") & F.coalesce(F.col("_vsc"), F.lit(False)))

    neutral = (
        _periods(groups.df, groups, stop, clear | F.col("running") | end, RED)
        .unionByName(_periods(marked, groups, F.col("sc_opens"), sc_closes, SAFETY_CAR))
        .unionByName(_periods(groups.df, groups, F.col("vsc_on"), F.col("vsc_off") | stop | end, VSC))
        .unionByName(_periods(ending, groups, F.col("ends_now"), clear | stop | end, VSC_ENDING, restarts=True))
    )
    yellow = _yellow_periods(groups, split)
    return neutral.unionByName(subtract_intervals(yellow, neutral, split))


def _yellow_periods(session: OrderedGroups, split: bool) -> DataFrame:
    """Yellow per sector, from the ordered log of the sessions.

    Track-wide clears and the session end close every sector. They cut the log into stretches
    that all sectors share; each yellow message learns the number of its stretch and the time
    that ends it, so no clear is handed to the sectors one by one. Inside a stretch a sector has
    a log of its own, and a period that no clear of the sector ends lasts to the stretch's end.
    """
    wide = F.col("track_clear") | F.col("is_end")
    log = session.after(session.df, first={"_until": F.when(wide, F.col("date"))})
    log = session.before(log, total={"_stretch": wide.cast("int")})
    own = log.where("yellow or sector_clear").select(
        "session_key", "yellow_key", "_stretch", "date", "message_id", "yellow", "sector_clear", "_until"
    )
    sector = OrderedGroups(own, ["session_key", "yellow_key", "_stretch"], ["date", "message_id"], split)
    known = sector.before(sector.df, last={"_open": _on_off(F.col("yellow"), F.col("sector_clear"))})
    known = sector.after(known, first={"_cleared": F.when(F.col("sector_clear"), F.col("date"))})
    begins = F.col("yellow") & ~F.coalesce(F.col("_open"), F.lit(False))
    return known.where(begins).select(
        "session_key", F.col("date").alias("start"), F.coalesce("_cleared", "_until").alias("end"), F.lit(YELLOW).alias("code")
    ).where("end is not null")


def _sweep(edges: DataFrame, keys: list[str], active: Column, split: bool) -> DataFrame:
    """Maximal stretches during which ``active`` holds. ``edges``: keys, at, up, block (changes
    in the number of open spans); equal times are summed first."""
    steps = edges.groupBy(*keys, "at").agg(F.sum("up").alias("up"), F.sum("block").alias("block"))
    groups = OrderedGroups(steps, keys, ["at"], split)
    level = groups.before(groups.df, total={"_up": F.col("up"), "_block": F.col("block")})
    level = level.withColumns({"_up": F.col("_up") + F.col("up"), "_block": F.col("_block") + F.col("block")})
    level = level.withColumn("_active", active)
    level = groups.before(level, last={"_was": F.col("_active")})
    was = F.coalesce(F.col("_was"), F.lit(False))
    level = groups.before(level, last={"_since": F.when(F.col("_active") & ~was, F.col("at"))})
    return level.where(was & ~F.col("_active")).select(*keys, F.col("_since").alias("start"), F.col("at").alias("end"))


def _edges(spans: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Two rows per span: +1 where it starts and -1 where it ends."""
    other = "block" if column == "up" else "up"
    step = F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))
    ))
    return (
        spans.where(F.col("start") < F.col("end")).select(*keys, step.alias("_s"))
        .select(*keys, "_s.at", F.col("_s.d").alias(column), F.lit(0).alias(other))
    )


def merge_intervals(spans: DataFrame, keys: list[str], split: bool = False) -> DataFrame:
    """Union of overlapping or touching spans per key."""
    return _sweep(_edges(spans, keys, "up"), keys, F.col("_up") > 0, split)


def subtract_intervals(spans: DataFrame, blocking: DataFrame, split: bool = False,
                       keys: tuple[str, ...] = ("session_key",), code: str = YELLOW) -> DataFrame:
    """Parts of ``spans`` (merged per key) that lie in no ``blocking`` span."""
    edges = _edges(spans, list(keys), "up").unionByName(_edges(blocking, list(keys), "block"))
    free = _sweep(edges, list(keys), (F.col("_up") > 0) & (F.col("_block") == 0), split)
    return free.withColumn("code", F.lit(code))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


ANY = "any"


def _span_steps(spans: DataFrame, keys: list[str], codes: list[str]) -> DataFrame:
    """Two rows per span: how it changes the number of open spans of every code at its ends."""
    edges = _edges(spans.select(*keys, "start", "end", "code"), [*keys, "code"], "up")
    steps = [F.col("up") if c == ANY else F.when(F.col("code") == c, F.col("up")).otherwise(0) for c in codes]
    known = edges if ANY in codes else edges.where(F.col("code").isin(codes))
    return known.select(*keys, F.col("at").alias("_at"), *[s.alias(f"_step{i}") for i, s in enumerate(steps)]).dropna(subset=keys)


def covered_by_code(laps: DataFrame, spans: DataFrame, keys: list[str], codes: list[str], split: bool = False) -> DataFrame:
    """Distinct laps with ``_copies``, how often each came, and ``_covered``: (span_code, overlap_s) of
    every listed code whose spans overlap the lap by a positive time, in the order of ``codes``; the
    code ``any`` stands for all spans together.

    The covered time C(t) of a code is a running sum over one log per key, which holds the ends of
    spans and of laps; a lap's overlap is C at its end less C at its start. Equal times add nothing,
    so their order is free. A span or lap of any length is two rows, and spans need no merging.
    Spans without a key, without length or with missing times cover nothing; laps like that are
    kept with an empty list. ``split`` for keys with very long logs.
    """
    numbers, columns = range(len(codes)), [F.col(f"`{c}`") for c in laps.columns]
    ends = F.explode(F.array(F.struct(F.col("lap_start").alias("at"), F.lit(False).alias("is_end")), F.struct(F.col("lap_end").alias("at"), F.lit(True).alias("is_end"))))
    points = laps.select(*columns, ends.alias("_point")).select(
        *columns, F.col("_point.at").alias("_at"), F.col("_point.is_end").alias("_is_end"), *[F.lit(0).alias(f"_step{i}") for i in numbers]
    )
    groups = OrderedGroups(points.unionByName(_span_steps(spans, keys, codes), allowMissingColumns=True), keys, ["_at"], split)
    level = groups.before(groups.df, last={"_was": F.unix_micros("_at")}, total={f"_open{i}": F.col(f"_step{i}") for i in numbers})
    since = F.unix_micros("_at") - F.col("_was")
    level = level.withColumns({f"_gain{i}": F.when(F.col(f"_open{i}") > 0, since).otherwise(0) for i in numbers})
    done = groups.before(level, total={f"_sum{i}": F.col(f"_gain{i}") for i in numbers}).where(F.col("_is_end").isNotNull())

    def until(i: int, is_end: bool) -> Column:
        return F.max(F.when(F.col("_is_end") == is_end, F.col(f"_sum{i}") + F.col(f"_gain{i}")))

    # The rows are already together by key, so this needs no shuffle of its own.
    met = done.groupBy(*columns).agg(*[(until(i, True) - until(i, False)).alias(f"_met{i}") for i in numbers], F.count_if(~F.col("_is_end")).alias("_copies"))
    usable = F.col("lap_start") < F.col("lap_end")
    entries = [
        F.when(usable & (F.col(f"_met{i}") > 0), F.struct(F.lit(code).alias("span_code"), (F.col(f"_met{i}") / 1_000_000).alias("overlap_s")))
        for i, code in enumerate(codes)
    ]
    return met.select(*columns, "_copies", F.array_compact(F.array(*entries)).alias("_covered"))


def overlap_join(laps: DataFrame, spans: DataFrame, keys: list[str], codes: list[str] = STATUS_ORDER, split: bool = False) -> DataFrame:
    """One row per lap and code whose spans overlap it by a positive time, with span_code and
    overlap_s, the seconds covered by at least one span of the code. ``laps``: keys, lap_start,
    lap_end and any other columns that can be grouped; repeated laps stay as often as they came."""
    met = covered_by_code(laps, spans, keys, codes, split).withColumn("_met", F.explode("_covered"))
    copies = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*[F.col(f"`{c}`") for c in laps.columns], "_met.span_code", "_met.overlap_s")


def union_length(intervals: DataFrame, keys: list[str], split: bool = False) -> DataFrame:
    """Seconds covered by at least one span, per key."""
    merged = merge_intervals(intervals, keys, split)
    return merged.groupBy(*keys).agg(F.sum(seconds_between("start", "end")).alias("covered_s"))


def lap_track_status(laps: DataFrame, intervals: DataFrame, lap_keys: list[str], split: bool = False,
                     keys: tuple[str, ...] = ("session_key",)) -> DataFrame:
    """Status text per lap: all codes met, with ``1`` when part of the lap was clear."""
    lap = list(dict.fromkeys([*lap_keys, *keys, "lap_start", "lap_end"]))
    met = covered_by_code(laps.select(*lap), intervals, list(keys), [*STATUS_ORDER, ANY], split)
    out = join_on(laps, met.drop("_copies"), lap)
    total = F.get(F.filter("_covered", lambda m: m["span_code"] == ANY), F.lit(0))["overlap_s"]
    length = seconds_between("lap_start", "lap_end")
    # Without a usable length the lap counts as partly clear.
    partly_clear = F.coalesce(total < length - CLEAR_TRACK_SLACK_S, F.lit(True))
    codes = F.transform("_covered", lambda m: m["span_code"])
    order = F.array(*[F.lit(c) for c in STATUS_ORDER])
    listed = F.filter(order, lambda c: F.array_contains(codes, c) | ((c == "1") & partly_clear))
    return out.withColumn("track_status", F.array_join(listed, "")).drop("_covered")
