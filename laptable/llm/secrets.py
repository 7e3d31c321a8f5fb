"""Secrets in texts: fixed patterns, and strings that look random to a pair of character Markov models.

Fixed patterns find assignments to secret-like names, access keys and long hexadecimal runs, each kind leftmost and without
overlap. On top of these, every run of key characters that holds a letter and a digit is scored: one first-order Markov
model of characters is trained on random strings, one on ordinary identifiers, and a run whose mean log-likelihood ratio reaches
a limit becomes a span of kind ``markov``; where base spans cover part of it, its parts outside of them do. Spans are [start, end) in code points.

Training takes labelled samples (``sample``, ``random``). :func:`corpus_samples` labels them from a bounded number of
documents (``SAMPLE_DOCS``, those with the smallest hashes of their ids): what the fixed patterns find is random, words
outside of that are ordinary; key-like digests of row numbers are added to the random side. Only counts by label and
character pair (at most two alphabets squared) reach the driver. All work is done by DataFrame expressions.

Defined cases: null or empty text has no spans and stays as it is; repeated rows are scanned each; an empty table gives an
empty result (the models then rest on the digests and on smoothing); computed columns replace input columns of their name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laptable.llm.common import let, sum_before, text_or_empty

#: Kinds in the order in which spans of one start are listed; pattern, group whose length counts, its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
KINDS = [*BASE, "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{RUN})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){RUN}{{20,}}"
WORD = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z_]{5,}[0-9]{0,2}(?![A-Za-z0-9_])"
SAMPLE_DOCS = 2_000
RANDOM_STRINGS = 4_000
#: Least log-likelihood ratio of a span, in nats per step from one character to the next.
LIMIT = 1.0


def _spans(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans of a pattern: the texts between matches give their places. Short matches use up text but are dropped."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(matches: Column, between: Column, value: Column) -> Column:
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.char_length(b) + F.char_length(m))
        gap = lambda i: F.char_length(F.get(between, i))

        def spans(sums: Column) -> Column:
            def span(match: Column, i: Column) -> Column:
                return let(
                    sum_before(sums, i) + gap(i),
                    lambda start: F.struct(
                        start.alias("start"),
                        F.lit(KINDS.index(kind)).alias("rank"),
                        (start + F.char_length(match)).alias("end"),
                        F.get(value, i).alias("value"),
                    ),
                )

            return F.transform(matches, span)

        return F.filter(let(lengths, spans), lambda s: F.char_length(s["value"]) >= least)

    many = let(F.split(text, pattern), lambda between: let(values, lambda value: let(found, lambda m: placed(m, between, value))))
    return F.when(F.regexp_count(text, F.lit(pattern)) == 0, none).otherwise(many)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and kind."""
    return F.sort_array(F.flatten(F.array(*[_spans(text, p, g, n, k) for k, (p, g, n) in BASE.items()])))


def corpus_samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings: ``sample``, ``random`` (boolean)."""
    spark = docs.sparkSession
    ids = docs.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    some = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text")).join(F.broadcast(ids), "_id", "left_semi")
    keys = [F.regexp_extract_all("_text", F.lit(p), F.lit(g)) for p, g, _ in BASE.values()]
    rest = F.col("_text")
    for pattern, _, _ in BASE.values():
        rest = F.regexp_replace(rest, pattern, " ")
    found = some.select(F.explode(F.flatten(F.array(*keys))).alias("sample"), F.lit(True).alias("random")).where("length(sample) >= 16")
    words = some.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("sample"), F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    kind = F.col("id") % 4
    made = F.when(kind == 0, digest).when(kind == 1, F.upper(digest)).otherwise(F.substring(F.base64(F.unhex(digest)), 1, 40))
    numbers = spark.range(0, RANDOM_STRINGS, 1, 1).select(made.alias("sample"), F.lit(True).alias("random"))
    return found.unionByName(words).unionByName(numbers)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of each character after each other one, with add-one smoothing."""
    n = len(ALPHABET)
    pairs = samples.select("random", F.regexp_replace("sample", f"[^{RUN[1:-1]}]", "").alias("s")).where("length(s) > 1")
    pairs = pairs.select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair")
    )
    counts = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][ALPHABET.index(row["pair"][0]) * n + ALPHABET.index(row["pair"][1])] += row["count"]
    rows = {k: [sum(v[i * n : i * n + n]) for i in range(n)] for k, v in counts.items()}
    chance = lambda k, i: counts[k][i] / rows[k][i // n]
    return [math.log(chance(True, i) / chance(False, i)) for i in range(n * n)]


def likelihood_ratio(run: Column, ratios: Sequence[float]) -> Column:
    """Log-likelihood ratio of a run of key characters."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    codes = F.split(F.lit(",".join(str(max(ALPHABET.find(chr(c)), 0)) for c in range(128))), ",").cast("array<int>")
    ranks = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.get(codes, F.ascii(c)))
    steps = lambda r: F.sequence(F.lit(1), F.size(r) - 1)
    return let(
        ranks, lambda r: F.aggregate(steps(r), F.lit(0.0), lambda total, i: total + F.get(table, F.get(r, i - 1) * n + F.get(r, i)))
    )


def outside(span: Column, base: Column) -> Column:
    """The parts of a span that no base span covers, in order; a whole span if none touches it."""

    def cut(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        part = lambda start, end: F.struct(
            start.alias("start"), last["rank"].alias("rank"), end.alias("end"), last["value"].alias("value")
        )
        before = F.slice(done, F.lit(1), F.size(done) - 1)
        pieces = F.concat(before, F.array(part(last["start"], F.greatest(last["start"], b["start"]))), F.array(part(F.greatest(last["start"], b["end"]), last["end"])))
        return F.when((b["start"] < last["end"]) & (last["start"] < b["end"]), pieces).otherwise(done)

    near = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    parts = F.filter(F.aggregate(near, F.array(span), cut), lambda s: s["start"] < s["end"])
    return F.when(F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])), parts).otherwise(F.array(span))


def find_secrets(docs: DataFrame, ratios: Sequence[float], text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The input with ``spans``: array of (start, rank of the kind, end), by start and kind."""
    whole = text_or_empty(text)
    likely = F.filter(_spans(whole, CANDIDATE, 0, 20, "markov"), lambda s: likelihood_ratio(s["value"], ratios) >= limit * (F.char_length(s["value"]) - 1))
    found = docs.withColumns({"_base": base_spans(whole), "_likely": likely})
    free = F.flatten(F.transform("_likely", lambda s: outside(s, F.col("_base"))))
    bare = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    spans = F.when((F.size("_base") == 0) & (F.size("_likely") == 0), F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    spans = spans.otherwise(F.transform(F.sort_array(F.concat("_base", free)), bare))
    return found.withColumn("spans", spans).drop("_base", "_likely")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["rank"].isin(*[KINDS.index(k) for k in kinds]))


def redact(docs: DataFrame, spans: str = "spans", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with each stretch of overlapping spans replaced by a mark; texts without spans stay as they are."""
    piece = "struct<start:int,end:int>"

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), wider)
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > s["start"]), longer).otherwise(F.concat(done, new))

    def rebuilt(merged: Column) -> Column:
        end_before = lambda i: F.coalesce(F.get(merged, i - 1)["end"], F.lit(0))
        before = F.transform(merged, lambda m, i: F.substring(F.col(text), end_before(i) + 1, m["start"] - end_before(i)))
        tail = F.substring(F.col(text), F.element_at(merged, -1)["end"] + 1, F.char_length(F.col(text)))
        return F.concat(F.array_join(F.transform(before, lambda b: F.concat(b, F.lit(mark))), ""), tail)

    merged = F.aggregate(F.col(spans), F.array().cast(f"array<{piece}>"), join)
    return docs.withColumn(text, F.when(F.size(spans) > 0, let(merged, rebuilt)).otherwise(F.col(text)))
