"""Repeated passages across documents, by hashing small units: the earliest occurrence stays, the others go.

A text is cut into units that tile it: sentences (up to a sentence mark or the end of a line), lines or paragraphs. Units are
normalised to lower-case letters and digits with single blanks and hashed to 128 bits; units without a letter or digit are
passed over. Digests are counted globally with the smallest (id, text, place) as their first occurrence, which is combined
before the shuffle, so a unit that a third of all documents share is one row per task. A unit is *repeated* if its digest has
an earlier occurrence. Of a document's repeated units, runs of consecutive ones go that together have ``min_words`` words,
or ``min_letters`` letters and digits for scripts without blanks; shorter runs stay. Sentences that many documents share by
chance thus stay where they stand alone, while a passage goes however it is wrapped and wherever in a line it begins. What goes
keeps its place in the original text as [start, end) in code points.

Units meet their digest by a shuffled join, but for digests above one part in ``HOT`` of all units: there are at most ``HOT`` of
them, so they are broadcast and their units never meet in one task.

Defined cases: null and empty texts have no units and stay as they are; a passage that repeats inside one document goes too;
rows with equal id and equal text are one document and get the same result; rows without an id rank last; a unit of any
length is whole; a text of which everything goes is empty; an empty table gives an empty result; computed columns replace
input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage, let, sum_before

#: Units as patterns that tile a text.
UNITS = {"sentence": r"[^\n.!?。！？]*[\n.!?。！？]+\x20*|[^\n.!?。！？]+", "line": r"[^\n]*\n+|[^\n]+", "paragraph": r"(?s).+?(?:\n[\x20\t]*\n|$(?!\n))"}
MIN_WORDS, MIN_LETTERS = 40, 240
NOT_WORD = r"[^\p{L}\p{N}]+"
HOT = 20_000
KEY = ["_last", "_id", "_text"]


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), NOT_WORD, " "))


def cut_units(text: Column, unit: str) -> Column:
    return F.regexp_extract_all(text, F.lit(UNITS[unit]), F.lit(0))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows with what names them: id (null last), and a hash of the text."""
    key = {"_last": F.col(doc_id).isNull(), "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "_text": F.xxhash64(F.col(text))}
    return docs.withColumns(key)


def _later(hashed: DataFrame) -> DataFrame:
    """The units whose digest has an earlier occurrence."""
    place = F.struct(*KEY, "_at")
    counted = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    shared = cut_lineage(counted.where("n > 1"))
    most = F.lit(hashed.count() // HOT)
    hot, cold = shared.where(F.col("n") > most).drop("n"), shared.where(F.col("n") <= most).drop("n")
    of_hot = hashed.join(F.broadcast(hot), ["h1", "h2"])
    of_cold = hashed.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])
    return of_hot.unionByName(of_cold).where(place != F.col("first")).select(*KEY, "_at", "_place", "words", "letters")


def repeated_runs(
    docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``_last, _id, _text, gone``: runs (first and last unit by number, in order) that go from each document that loses some."""
    named = _rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id")
    units = F.transform(cut_units(F.col("text"), unit), lambda u, i: F.struct(i.alias("place"), normalised(u).alias("norm")))
    spread = named.select(*KEY, F.posexplode(F.filter(units, lambda u: u["norm"] != "")).alias("_at", "_unit"))
    words, norm = F.size(F.split("_unit.norm", " ")), F.col("_unit.norm")
    sizes = [words.alias("words"), (F.char_length(norm) - words + 1).alias("letters")]
    hashed = cut_lineage(spread.select(*KEY, "_at", F.col("_unit.place").alias("_place"), *sizes, F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(7), norm).alias("h2")))
    run = (F.col("_at") - F.row_number().over(Window.partitionBy(*KEY).orderBy("_at"))).alias("_run")
    # Rows that repeat an id and a text are one document.
    runs = _later(hashed).dropDuplicates([*KEY, "_at"]).select(*KEY, "_place", "words", "letters", run).groupBy(*KEY, "_run")
    runs = runs.agg(F.min("_place").alias("first"), F.max("_place").alias("last"), F.sum("words").alias("words"), F.sum("letters").alias("letters"))
    long = runs.where((F.col("words") >= min_words) | (F.col("letters") >= min_letters))
    return long.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("gone"))


def drop_repeated_units(
    docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The input with the remaining ``text`` and ``removed``: array of (start, end) in the original text."""
    gone = repeated_runs(docs, unit, min_words, min_letters, text, doc_id)
    rows = _rows(docs.drop("removed"), text, doc_id).join(gone, KEY, "left")

    def spans(lengths: Column) -> Column:
        start = lambda r: sum_before(lengths, r["first"])
        return F.transform("gone", lambda r: F.struct(start(r).alias("start"), sum_before(lengths, r["last"] + 1).alias("end")))

    def stays(removed: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), removed["end"])
        ends = F.concat(removed["start"], F.array(F.char_length(text)))
        return F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(F.col(text), p["a"] + 1, p["b"] - p["a"])), "")

    lengths = F.transform(cut_units(F.col(text), unit), lambda u: F.char_length(u))
    removed = F.when(F.col("gone").isNotNull(), let(lengths, spans))
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = rows.withColumn("removed", F.coalesce(removed, none))
    kept = F.when(F.size("removed") > 0, stays(F.col("removed"))).otherwise(F.col(text))
    return rows.withColumn(text, kept).drop(*KEY, "gone")
