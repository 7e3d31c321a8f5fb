"""Language identification: averaged embeddings of hashed letter runs, a linear softmax, and a calibrated score.

A text's features are its runs of one to three characters inside words (lower case, with marks for word edges), hashed to a
fixed number of buckets. A text is the mean of its runs' embeddings, a linear layer and softmax give the language. Embeddings
and layer are trained together by stochastic gradient descent in numpy on a bounded sample (``SAMPLE_DOCS`` labelled
documents with the smallest hashes; whole texts, turned into bucket counts inside tasks). A fifth of the sample is kept
aside: it sets the temperature of the scores and the score below which a prediction is marked as rejected, so that accepted
ones are right at least ``target`` of the time there.

As the layer is linear, prediction needs one row of class values per bucket; the mean of these rows over all runs of a whole
text is the text's logit. The model has a fixed size and travels with the tasks.

Defined cases: texts that are null, empty or without a letter get ``und`` and score 0; rows without a label are not learned
from; repeated rows are predicted each; without any labelled row everything is ``und``; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.llm.tokens import slices

SAMPLE_DOCS = 2_000
BUCKETS = 1 << 14
WIDTH = 16
UNKNOWN = "und"
SLICE = 1 << 21

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For every code point its lower-case letter, 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three: the buckets of all texts in a row, and the number of runs before each text (and in all)."""
    joined = "\n".join(texts) + "\n"
    x = _letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate([np.zeros(1, np.uint32), x, np.zeros(1, np.uint32)])
    a, b, c = x[:-2], x[1:-1], x[2:]
    m1, m2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = b != 0

    def buckets(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h[valid]
        before = np.concatenate([[0], np.cumsum(valid)])[edges]
        return (h ^ (h >> np.uint32(15))) * m2 >> np.uint32(18), before

    two = (a * m1 + b) * m2
    return [
        buckets(b * m1 + np.uint32(1), inside),
        buckets(two + np.uint32(2), inside | (a != 0)),
        buckets((two + c) * m1 + np.uint32(3), inside),
    ]


@dataclass(frozen=True)
class Model:
    """``table``: class values per bucket; ``bias``; scores are softmax(logit / temperature); below ``reject`` a prediction is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 0.3, batch: int = 32, target: float = 0.99, seed: int = 1) -> Model | None:
    """Trains on (buckets, counts, language) of each sample document."""
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return None
    languages = sorted({r[2] for r in rows})
    y = np.array([languages.index(r[2]) for r in rows])
    shares = [(r[0], r[1] / r[1].sum()) for r in rows]
    aside = np.arange(len(rows)) % 5 == 4
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    learn = np.flatnonzero(~aside)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = np.concatenate([[0], np.cumsum([len(shares[k][0]) for k in some])[:-1]])
            which, share = (np.concatenate([shares[k][j] for k in some]) for j in (0, 1))
            mean = np.add.reduceat(embed[which] * share[:, None], at, axis=0)
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(some)), y[some]] -= 1
            back = error @ layer.T
            layer -= step * mean.T @ error
            bias -= step * error.mean(axis=0)
            lengths = [len(shares[k][0]) for k in some]
            np.add.at(embed, which, -step * share[:, None] * np.repeat(back, lengths, axis=0))
    table = embed @ layer
    if not aside.any():
        return Model(languages, table.astype(np.float32), bias, 1.0, 0.0)
    logits = np.array([(table[shares[k][0]] * shares[k][1][:, None]).sum(axis=0) + bias for k in np.flatnonzero(aside)])
    truth = y[aside]
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = _softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= target * np.arange(1, len(order) + 1))
    reject = float(score[order][good[-1]]) if len(good) else 1.0
    return Model(languages, table.astype(np.float32), bias, temperature, reject)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fits on the labelled documents for which ``learn`` holds."""
    labelled = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = labelled.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    some = labelled.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                kinds = features(part.column("text").to_pylist())
                whole = [np.concatenate([w[at[i] : at[i + 1]] for w, at in kinds]) for i in range(part.num_rows)]
                found = [np.unique(x, return_counts=True) for x in whole]
                arrays = [part.column("_id"), part.column("lang"), pa.array([x.astype("<u2").tobytes() for x, _ in found], pa.binary())]
                counts = pa.array([np.minimum(n, 2**31 - 1).astype("<i4").tobytes() for _, n in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, counts], names=["id", "lang", "which", "counts"])

    counted = some.join(F.broadcast(ids), "_id", "left_semi").mapInArrow(count, "id long, lang string, which binary, counts binary")
    rows = sorted(counted.collect(), key=lambda r: (r["id"], r["lang"], bytes(r["which"])))[:sample_docs]
    return fit([(np.frombuffer(r["which"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<i4").astype(float), r["lang"]) for r in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``lang_pred``, ``score`` and ``rejected`` of every row."""
    carried = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)], F.col(text).alias("text"))
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(carried, carry, strict=True)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                names, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if model is not None:
                    kinds = features([t or "" for t in part.column("text").to_pylist()])
                    has = np.flatnonzero(np.diff(kinds[0][1]))
                    if len(has):
                        sums = sum(np.add.reduceat(model.table[w], at[has], axis=0, dtype=np.float64) for w, at in kinds)
                        runs = sum(np.diff(at)[has, None] for _, at in kinds)
                        p = _softmax((sums / runs + model.bias) / model.temperature)
                        names[has], score[has] = np.array(model.languages, object)[p.argmax(axis=1)], p.max(axis=1)
                rejected = score < (model.reject if model else 1.0)
                arrays = [*[part.column(c) for c in carried], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "lang_pred", "score", "rejected"])

    found = rows.mapInArrow(predict, ", ".join([*kinds, "lang_pred string, score double, rejected boolean"]))
    return found.withColumnsRenamed(dict(zip(carried, carry, strict=True)))
