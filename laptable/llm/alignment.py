"""Alignment of two tokenizers over a corpus: which tokens of one overlap which tokens of the other, and how often.

Both tokenizers cut the same bytes (a blank and the text). Where tokens of both end, the text falls into groups; a link is a
pair of tokens, one of each side, whose byte ranges overlap. Every stretch between neighbouring ends is one link, so links
come from one pass over the marked ends, without pairs of tokens.

1. An array gives for each id of A the id of B that stands for the same bytes. A group of one token each that follows this map
   is *regular*: it is counted in a vector as long as A's vocabulary, one vector a task, and never becomes a row by itself.
2. Other links are kept as numbers of distinct pairs of a chunk of documents (about ``CHUNK`` bytes of text), so a pair that
   all documents hold is one row a chunk. Only these rows are shuffled, summed with the vectors, and compared with the highest
   count of their B id.
3. Chunks ask for the counts of their own pairs by the same rows; regular links read theirs from the summed vector, which
   is bounded by the vocabulary. Each document's sums follow inside its chunk. Encoded chunks are stored once.

Words and pre-tokens seen before are looked up instead of encoded again (see ``tokens``; pieces of B never hold a blank after
another character, so its words are segmented apart). Texts above ``LONG`` code points are worked on in pieces that begin
with a blank after no white space, where tokens of both sides end.

Defined cases: null and empty texts, and texts whose joined bytes differ on either side, have no tokens: zeros and an empty
digest; strings of special tokens are plain text; repeated rows are documents each and count each; rows without an id come
back without an id; a text without blanks is one piece whatever its length; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage
from laptable.llm.tokens import Encoder, slices

TOKENIZER_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
WORDS = re.compile(" +[^ ]*")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
IDS, PAIRS = np.dtype("<u2"), np.dtype("<u4")
REMEMBERED = 300_000
#: Bytes of text aligned at once, bytes of text in a chunk, and code points from where a text is worked on in pieces.
TOGETHER, CHUNK, LONG = 1 << 20, 1 << 23, 1 << 20
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​-‍⁠﻿]) ")
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_regular", "n_other")
ENCODED = "doc_ids array<long>, stats binary, digests array<string>, regular binary, other binary, pairs array<long>, times array<long>, same_pairs array<long>, same_times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones themselves, the others in a row from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PieceWords:
    """One worker's piece model with its remembered words; a text must begin with a blank, which the model adds itself."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        assert len(pieces) <= 1 << 16 and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.raw = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        #: The blank at the end of a text, which the model would not see behind the one it adds.
        self.last = {" ": np.array([self.model.piece_to_id(MARK)], IDS).tobytes()}
        self.known = dict(self.last)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        cut = [WORDS.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = dict(self.last)
        fresh = list(set().union(*cut).difference(self.known))
        made = {w: np.array(x, IDS).tobytes() for w, x in zip(fresh, self.model.encode([w[1:] for w in fresh], num_threads=1), strict=True)}
        self.known |= {w: x for w, x in made.items() if len(w) <= 256}
        long = {w: x for w, x in made.items() if len(w) > 256}
        get = (self.known | long if long else self.known).__getitem__
        return [b"".join(map(get, x)) for x in cut]


class Aligner:
    """Both tokenizers, the bytes of their ids, and the map between ids of equal bytes."""

    def __init__(self, a: str, b: str):
        self.a = Encoder(a)
        self.a.tokenizer.encode_special_tokens = True
        self.a.special = []
        self.b = PieceWords(b)
        letters, vocabulary = _byte_letters(), self.a.tokenizer.get_vocab()
        self.raw_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.raw_b = self.b.raw
        self.size_a, self.size_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.same = same_ids(self.raw_a, self.raw_b)
        ends = lambda n, last: [f"{i}{c}".encode() for i in range(n) for c in (",", last)]
        self.spelt = ends(len(self.raw_a), "|") + ends(len(self.raw_b), ";")

    def align(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """For texts with ids on both sides: their counts (``STATS``), groups as text, ids of regular links, other pairs."""
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        marks = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        marks = marks[marks > 0]
        is_a, is_b, both = marks & 1, marks >> 1, marks == 3
        up_a, up_b = np.cumsum(is_a, dtype=np.int64), np.cumsum(is_b, dtype=np.int64)
        link_a, link_b = a[up_a - is_a], b[up_b - is_b]
        at_a, at_b, cuts = np.flatnonzero(is_a), np.flatnonzero(is_b), np.flatnonzero(both)
        group = np.cumsum(both) - both
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.append(0, up_b[cuts])[group[at_a]]] = 2 * a + both[at_a]
        code[np.arange(len(b)) + up_a[cuts][group[at_b]]] = 2 * (len(self.raw_a) + b) + both[at_b]
        alone = both.copy()
        alone[1:] &= both[:-1]
        regular = alone & (self.same[link_a] == link_b)
        ends = at_a[np.cumsum(n_a) - 1] + 1
        starts = np.append(0, ends[:-1])
        total = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64)[ends - 1]))
        n_regular = total(regular)
        stats = np.stack([n_a, n_b, total(both), ends - starts, n_regular, ends - starts - n_regular], axis=1)
        words = list(map(self.spelt.__getitem__, code.tolist()))
        edges = np.append(0, np.cumsum(n_a + n_b)).tolist()
        groups = [b"".join(words[i:j])[:-1] for i, j in zip(edges, edges[1:], strict=False)]
        other = (link_a[~regular] << 16 | link_b[~regular]).astype(PAIRS)
        return stats, groups, link_a[regular].astype(IDS), other

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """As ``align`` for whole documents, with digests of the groups."""
        owner, parts = [], []
        for i, text in enumerate(texts):
            if text:
                some = _pieces(" " + text)
                owner.extend([i] * len(some))
                parts.extend(some)
        left, right = self.a.encode(parts), self.b.encode(parts)
        a, b = ([np.frombuffer(x, IDS) for x in side] for side in (left, right))
        spoilt = set()
        for i, part, x, y in zip(owner, parts, a, b, strict=True):
            whole = part.encode()
            if b"".join(map(self.raw_a.__getitem__, x.tolist())) != whole or b"".join(map(self.raw_b.__getitem__, y.tolist())) != whole:
                spoilt.add(i)
        kept = [k for k, i in enumerate(owner) if i not in spoilt]
        sizes = np.cumsum([len(parts[k]) for k in kept]) // TOGETHER
        stats, digests = np.zeros((len(texts), len(STATS)), np.int64), {}
        regular, other = [np.zeros(0, IDS)], [np.zeros(0, PAIRS)]
        for run in np.split(np.array(kept, np.int64), np.flatnonzero(np.diff(sizes)) + 1):
            if len(run):
                found = self.align([a[k] for k in run], [b[k] for k in run])
                owners = [owner[k] for k in run]
                np.add.at(stats, owners, found[0])
                for i, groups in zip(owners, found[1], strict=True):
                    if i in digests:
                        digests[i].update(b";")
                    digests.setdefault(i, hashlib.sha256()).update(groups)
                regular.append(found[2])
                other.append(found[3])
        named = [digests[i].hexdigest() if i in digests else "" for i in range(len(texts))]
        return stats, named, np.concatenate(regular), np.concatenate(other)


def same_ids(raw_a: list[bytes], raw_b: list[bytes]) -> np.ndarray:
    """For each id of A the id of B with the same bytes (a whole piece before a byte piece, then the smaller), else -1."""
    of: dict[bytes, int] = {}
    spelling = sorted(range(len(raw_b)), key=lambda i: (i < 259, i))
    for i in spelling:
        of.setdefault(raw_b[i], i)
    return np.array([of.get(x, -1) if x else -1 for x in raw_a], np.int64)


def _pieces(whole: str) -> list[str]:
    """A text that begins with a blank, in pieces of about ``LONG`` code points that do so too."""
    out, start = [], 0
    while len(whole) - start > 2 * LONG:
        cut = SAFE.search(whole, start + LONG)
        if cut is None:
            break
        out.append(whole[start : cut.start()])
        start = cut.start()
    return [*out, whole[start:]]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The worker's tokenizers, kept between tasks."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _row(docs: list, stats: np.ndarray, digests: list, regular: np.ndarray, other: np.ndarray, vector: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    pairs, number, times = np.unique(other, return_inverse=True, return_counts=True)
    used = np.flatnonzero(vector)
    longs, many = pa.list_(pa.int64()), pa.list_(pa.string())
    cells = [
        (docs, longs), (stats.astype("<i8").tobytes(), pa.binary()), (digests, many), (regular.tobytes(), pa.binary()),
        (number.astype(PAIRS).tobytes(), pa.binary()), (pairs.astype(np.int64), longs), (times.astype(np.int64), longs), (used << 16 | same[used], longs), (vector[used], longs),
    ]
    names = [x.split(" ")[0] for x in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cells], names=names)


def _encoded(docs: DataFrame, a: str, b: str, chunk_bytes: int) -> DataFrame:
    """Stored chunks of documents; the last row of a task also holds its vector of regular links."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(a, b)
        vector = np.zeros(len(tools.raw_a), np.int64)
        nothing = np.zeros(0, np.int64)
        held: list[tuple] = []
        size = 0

        def chunk(last: bool) -> pa.RecordBatch:
            ids = [i for x in held for i in x[0]]
            digests = [d for x in held for d in x[2]]
            stats, regular, other = (np.concatenate([x[k] for x in held]) for k in (1, 3, 4))
            return _row(ids, stats, digests, regular, other, vector if last else nothing, tools.same)

        for batch in batches:
            for part in slices(batch, "text"):
                if size > chunk_bytes:
                    yield chunk(False)
                    held, size = [], 0
                found = tools.documents(part.column("text").to_pylist())
                vector += np.bincount(found[2], minlength=len(vector))
                held.append((part.column("doc_id").to_pylist(), *found))
                size += part.nbytes
        if held:
            yield chunk(True)

    return cut_lineage(docs.mapInArrow(encode, ENCODED)).withColumn("chunk", F.monotonically_increasing_id())


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Stored ``pair`` (A id times 65536, and B id), ``n`` links in the corpus, ``best`` (no pair of its B id has more), ``is_same``."""
    listed = lambda pairs, n, same: chunks.select(F.explode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(n).alias("n"))).alias("x")).select("x.*", F.lit(same).alias("is_same"))
    every = listed("same_pairs", "same_times", True).unionByName(listed("pairs", "times", False))
    summed = cut_lineage(every.groupBy("pair").agg(F.sum("n").alias("n"), F.max("is_same").alias("is_same")))
    b = F.col("pair") % 65536
    most = summed.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return cut_lineage(summed.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "is_same"))


def align_documents(
    docs: DataFrame, a: str = TOKENIZER_A, b: str = MODEL_B, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Per document its tokens, groups and links with their counts in the corpus (``RESULT``); and the counts of all pairs."""
    chunks = _encoded(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), a, b, chunk_bytes)
    counts = pair_counts(chunks)
    n_a, best_a = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    # One row per id of A at most.
    known = counts.where("is_same").select("pair", "n", "best").toArrow()
    at = np.asarray(known.column("pair")) >> 16
    n_a[at], best_a[at] = np.asarray(known.column("n")), np.asarray(known.column("best")).astype(np.int64)

    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    answer = F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("answers")
    answered = asked.join(counts.select("pair", "n", "best"), "pair").groupBy("chunk").agg(answer)
    joined = chunks.select("chunk", "doc_ids", "stats", "digests", "regular", "other").join(answered, "chunk", "left").drop("chunk")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            stats = np.frombuffer(row.column("stats")[0].as_py(), "<i8").reshape(-1, len(STATS))
            answers = row.column("answers")[0].values
            n, best = (np.asarray(answers.field(k)).astype(np.int64) if answers is not None else np.zeros(0, np.int64) for k in (1, 2))
            sums = []
            for column, count, top, width in (("regular", n_a, best_a, 4), ("other", n, best, 5)):
                ids = np.frombuffer(row.column(column)[0].as_py(), IDS if column == "regular" else PAIRS)
                edges = np.append(0, np.cumsum(stats[:, width]))
                sums.append([np.diff(np.append(0, np.cumsum(x[ids]))[edges]) for x in (count, top)])
            columns = [row.column("doc_ids")[0].values, *(pa.array(stats[:, k]) for k in range(4))]
            columns += [pa.array(sums[0][1] + sums[1][1]), pa.array(sums[0][0] + sums[1][0]), row.column("digests")[0].values]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in RESULT.split(", ")])

    return joined.mapInArrow(total, RESULT), counts

