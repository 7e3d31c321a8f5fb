"""Quality rules of documents and of the hosts they come from.

Each document gets counts and rule failures from its own text. Failures are summed by host; a host's failure rate is
shrunk towards the rate of all hosts with a beta prior whose two parameters come from the hosts themselves (method of
moments). A host whose shrunken rate is high gets the verdict "poor", and that verdict is joined back: documents of a poor
host must also pass the strict rules. A document that passes all its own rules stays, whatever its host.

Defined cases: a null text has no words and fails as too short; a null host is no host (only the document's own rules
count); repeated rows count as rows; an empty table gives an empty result; columns of the input that bear the name of a
computed column are replaced by it. Everything is a DataFrame expression; nothing but one row (the prior) and the number of
hosts reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import bounded_broadcast, cut_lineage, let, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits: the first two reject a document, the next three count as failures and reject on poor hosts only."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    min_mean_word: int = 3
    poor_host_rate: float = 0.5


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FLAGS = ["base_failed", "strict_failed"]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more.

    Windows are compared by a 64-bit hash of eight 64-bit word hashes. Only texts in which some window repeats
    are sorted: equal windows become neighbours there, and the covered words follow from the gaps between their starts.
    """

    def covered(starts: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(starts) - 1)
        gap = lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - F.get(starts, j), F.lit(WINDOW)))
        return F.aggregate(ends, F.lit(0), lambda total, j: total + gap(j))

    def repeated(ranked: Column) -> Column:
        same = lambda e, j: F.coalesce(e["h"] == F.get(ranked, j)["h"], F.lit(False))
        starts = F.transform(ranked, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
        return let(F.sort_array(F.array_compact(starts)), covered)

    def of_windows(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, repeated))

    def of_hashes(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        return let(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window), of_windows)

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    return F.when(F.size(words) > WINDOW, hashes).otherwise(F.lit(0))


def document_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The input with the counts and the two flags of each document."""
    whole = text_or_empty(text)
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE))
    parts = docs.withColumns({"_words": F.array_remove(F.split(whole, SPACE), ""), "_lines": lines})
    counted = parts.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words")).cast("long"),
            "_n_lines": F.size("_lines"),
        }
    )
    n = F.col("n_words")
    few = n < rules.min_words
    repeats = 100 * F.col("n_repeat_words") > rules.max_repeat_pct * n
    symbols = 100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("word_chars")
    same_lines = 100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("_n_lines")
    short_words = F.col("word_chars") < rules.min_mean_word * n
    flagged = counted.withColumns({"base_failed": few | repeats, "strict_failed": few | repeats | symbols | same_lines | short_words})
    return flagged.drop("_words", "_lines", "_n_lines")


def host_verdicts(judged: DataFrame, host: str = "source", rules: Rules = Rules()) -> tuple[DataFrame, int]:
    """One row per host (documents, failures, shrunken rate, poor or not), stored, and the number of hosts.

    Prior of host rates: mean m and variance v over hosts (each weighs one) give a + b = m (1 - m) / v - 1. With equal
    rates or a single host, v is zero and hosts count as one population; a + b is then held at its upper bound.
    """
    rows = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("strict_failed").cast("long")).alias("n_failed")
    )
    rows = cut_lineage(rows)
    rate = F.col("n_failed") / F.col("n_docs")
    prior = rows.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.count("*").alias("n")).first()
    m, v = float(prior["m"] or 0.0), float(prior["v"] or 0.0)
    strength = min(max(m * (1 - m) / v - 1 if v > 0 else 1e6, 1.0), 1e6)
    shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    table = rows.withColumn("host_rate", shrunk).withColumn("host_poor", F.col("host_rate") > rules.poor_host_rate)
    return table, int(prior["n"])


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), keep_text: bool = True) -> DataFrame:
    """The input with counts, flags, the host's shrunken rate and verdict, and ``kept``.

    Hosts need every document's flags first. Without the text in the result the flags are stored in between; with it
    they are computed again for the result, as that is cheaper than storing every text a second time.
    """
    judged = document_rules(docs, text, rules)
    if not keep_text:
        judged = cut_lineage(judged.drop(text))
    table, n_hosts = host_verdicts(judged, host, rules)
    verdict = table.select(F.col("host").alias("_host"), F.col("host_rate").alias("_rate"), F.col("host_poor").alias("_poor"))
    joined = judged.join(bounded_broadcast(verdict, n_hosts), F.col(host) == F.col("_host"), "left")
    poor = F.coalesce(F.col("_poor"), F.lit(False))
    kept = ~F.col("base_failed") & ~(poor & F.col("strict_failed"))
    return joined.withColumns({"host_rate": F.col("_rate"), "host_poor": poor, "kept": kept}).drop("_host", "_rate", "_poor")


def keep_good_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_source"))
    return judge_documents(inner, "_text", "_source", rules).where("kept").select("_row.*")
