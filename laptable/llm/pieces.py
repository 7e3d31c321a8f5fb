"""Encoding texts into a piece vocabulary and back: the segmentation with the highest sum of piece scores.

The vocabulary is read from a model file (pieces, scores, kinds). A text gets a leading mark for a blank, blanks become that
mark, and it falls apart into words: no piece holds a mark after another character, so the best segmentation of a text is
that of its words in a row. Words are segmented once per worker and looked up afterwards. Fresh words of one length advance
together: hashes of all their substrings are looked up among the sorted hashes of the pieces, and at each end the best of
sixteen lengths is chosen at once and stored as a back pointer; of equal sums the longest last piece wins. A character
that no piece covers costs more than any piece and becomes the pieces of its UTF-8 bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; decoding gives the text back but for the mark's own
character, which reads as a blank; repeated rows are encoded each; words of any length are whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import text_or_empty
from laptable.llm.texthash import U, mix
from laptable.llm.tokens import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces in the model file (fixed values of the format).
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
REMEMBERED = 300_000
#: Longer words advance alone.
TOGETHER = 48
FACTOR = U(0x9E3779B97F4A7C15)
IDS = np.dtype("<u2")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            at += size
            value = raw[at - size : at]
            yield key >> 3, struct.unpack("<f", value)[0] if key & 7 == 5 else value


class Vocabulary:
    """Pieces of a model file, sorted by hash for lookups, with the segmentations found so far."""

    def __init__(self, name: str = MODEL):
        import public_tokenizers

        with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
            rows = [dict(_fields(v)) for f, v in _fields(file.read()) if f == 1]
        self.pieces = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        ids = [i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED, UNUSED)]
        self.scores = {self.pieces[i]: (float(rows[i].get(2, 0.0)), i) for i in ids}
        self.unknown = min(s for s, _ in self.scores.values()) - 10
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.longest = max(map(len, self.scores))
        assert not any(MARK in p.lstrip(MARK) for p in self.scores) and len(self.pieces) <= 1 << 16
        keys = np.array([self._hash(p) for p in self.scores], U)
        order = np.argsort(keys)
        self.keys = keys[order]
        assert (np.diff(self.keys) > 0).all()
        self.key_scores = np.array([s for s, _ in self.scores.values()])[order]
        self.key_ids = np.array([i for _, i in self.scores.values()])[order]
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for byte, i in self.byte_ids.items():
            self.raw[i] = bytes([byte])
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, U)
        for c in piece:
            h = h * FACTOR + U(ord(c) + 1)
        return int(mix(h + U(len(piece)))[0])

    def _spelt(self, word: str, ids: list[int]) -> bytes:
        """Ids as bytes; -1 - i stands for the unknown character at place i."""
        out: list[int] = []
        for i in ids:
            out.extend([i] if i >= 0 else (self.byte_ids[b] for b in word[-1 - i].encode()))
        return np.array(out, IDS).tobytes()

    def alone(self, word: str) -> bytes:
        """One word, by the same recurrence over a dictionary."""
        best, back = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(max(0, end - self.longest), end):
                found = self.scores.get(word[start:end])
                if found is None and start == end - 1:
                    found = self.unknown, -1 - start
                if found is not None and (top is None or best[start] + found[0] > top[0]):
                    top = best[start] + found[0], start, found[1]
            best.append(top[0])
            back.append(top[1:])
        ids, end = [], len(word)
        while end:
            end, piece = back[end]
            ids.append(piece)
        return self._spelt(word, ids[::-1])

    def together(self, words: list[str]) -> list[bytes]:
        """Words of one length."""
        n, w = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(w, n).astype(U)
        sums = np.zeros((w, n + 1), U)
        for i in range(n):
            sums[:, i + 1] = sums[:, i] * FACTOR + codes[:, i] + U(1)
        most = min(n, self.longest)
        gain = np.full((most + 1, w, n + 1), -np.inf)
        piece = np.zeros((most + 1, w, n + 1), np.int64)
        for size in range(1, most + 1):
            power = U(pow(int(FACTOR), size, 1 << 64))
            keys = mix(sums[:, size:] - sums[:, : n + 1 - size] * power + U(size))
            at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
            hit = self.keys[at] == keys
            gain[size, :, size:] = np.where(hit, self.key_scores[at], -np.inf)
            piece[size, :, size:] = self.key_ids[at]
            if size == 1:
                gain[1, :, 1:][~hit] = self.unknown
                piece[1, :, 1:][~hit] = np.broadcast_to(-1 - np.arange(n), (w, n))[~hit]
        best, back = np.zeros((w, n + 1)), np.zeros((w, n + 1), np.int64)
        rows = np.arange(w)
        for end in range(1, n + 1):
            sizes = np.arange(min(end, most), 0, -1)
            totals = best[:, end - sizes] + gain[sizes, :, end].T
            which = totals.argmax(axis=1)
            best[:, end], back[:, end] = totals[rows, which], sizes[which]
        chosen, used = np.zeros((w, n), np.int64), np.zeros((w, n), bool)
        ends, live = np.full(w, n), rows
        while len(live):
            sizes = back[live, ends[live]]
            starts = ends[live] - sizes
            chosen[live, starts], used[live, starts] = piece[sizes, live, ends[live]], True
            ends[live] = starts
            live = live[starts > 0]
        odd = ((chosen < 0) & used).any(axis=1)
        flat, edges = chosen[used], np.concatenate([[0], np.cumsum(used.sum(axis=1))]).tolist()
        raw = np.where(flat < 0, 0, flat).astype(IDS).tobytes()
        out = [raw[2 * a : 2 * b] for a, b in zip(edges, edges[1:], strict=False)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._spelt(words[i], flat[edges[i] : edges[i + 1]].tolist())
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, two bytes each."""
        cut = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        groups: dict[int, list[str]] = defaultdict(list)
        made: dict[str, bytes] = {}
        for word in set().union(*cut).difference(self.known):
            if len(word) <= TOGETHER:
                groups[len(word)].append(word)
            else:
                made[word] = self.alone(word)
        for words in groups.values():
            for i in range(0, len(words), 4096):
                some = words[i : i + 4096]
                self.known.update(zip(some, self.together(some), strict=True))
        get = (self.known | made if made else self.known).__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, IDS).tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """The worker's vocabulary, kept between tasks."""
    if name not in _vocabularies:
        _vocabularies[name] = Vocabulary(name)
    return _vocabularies[name]


def encode_pieces(docs: DataFrame, model: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` (binary, two bytes an id, little-endian) of every text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = vocabulary(model).encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text``: the decoded texts, with a digest of the ids as unsigned 32-bit integers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                rows = part.column("ids").to_pylist()
                texts = [vocabulary(model).decode(x) for x in rows]
                crcs = [zlib.crc32(np.frombuffer(x, IDS).astype("<u4").tobytes()) for x in rows]
                arrays = [part.column("doc_id"), pa.array([len(x) // 2 for x in rows], pa.int64()), pa.array(crcs, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_ids", "ids_crc32", "text"])

    return encoded.mapInArrow(decode, "doc_id long, n_ids long, ids_crc32 long, text string")
