"""Token ids of whole texts inside tasks: repeated parts of texts are encoded once per worker and then looked up.

A text is cut where the tokenizer itself always ends a pre-token, so its ids are those of its parts in a row:

- Any text may be cut before ASCII white space that follows a character which is white space to nobody.
- A text of the first 256 code points alone (without odd spaces, special strings, and for word-end tokenizers apostrophes)
  can be cut into the pre-tokens themselves, as its letters and digits are known and no normalisation reaches across them.

Fresh pre-tokens that are plain words are encoded many at a time in one text; their ids are told apart by the bytes they
stand for (byte-level vocabularies) or by the ids that end a word.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many distinct parts are remembered by a worker before it starts anew (about 200 bytes each).
REMEMBERED = 300_000
#: Longer parts are encoded each time and not remembered.
LONG = 256
#: White space of any kind beside the ASCII ones, as either side sees it.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
SPACED = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
CAREFUL = re.compile(r"(?<=\S)(?=[\t-\r ])")
#: Letters and digits below code point 256.
L, N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
ODD = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-\xff]")
BYTE_PARTS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+")
WORD_PARTS = re.compile(rf"[{L}]+|[^{L}]+")
BYTE_WORD, WORD_WORD = re.compile(f" [{L}]+"), re.compile(f"[{L}]+")
TOGETHER = 400


class Encoder:
    """One worker's tokenizer with its remembered parts; ids are little-endian ``dtype`` bytes."""

    def __init__(self, name: str, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        assert self.tokenizer.get_vocab_size() <= 1 << (8 * np.dtype(dtype).itemsize)
        self.dtype, self.width = dtype, np.dtype(dtype).itemsize
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = self.tokenizer.get_vocab()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.kind = ""
        size = max(vocabulary.values()) + 1
        if spec["model"].get("end_of_word_suffix"):
            suffix = spec["model"]["end_of_word_suffix"]
            self.kind, self.plain, self.parts = "word", WORD_WORD, WORD_PARTS
            self.ends = np.zeros(size, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        elif spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.kind, self.plain, self.parts = "byte", BYTE_WORD, BYTE_PARTS
            self.bytes = np.zeros(size, np.int64)
            self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def cut(self, text: str) -> list[str]:
        if self.kind and ODD.search(text) is None and not any(x in text for x in self.special):
            if self.kind == "byte":
                return self.parts.findall(text)
            if "'" not in text:
                return self.parts.findall(text.lower())
        return SPACED.findall(text) if OTHER_SPACE.search(text) is None else CAREFUL.split(text)

    def _each(self, parts: list[str]) -> dict[str, bytes]:
        if not parts:
            return {}
        done = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return {p: np.array(x.ids, self.dtype).tobytes() for p, x in zip(parts, done, strict=True)}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Plain words, many in one text."""
        out: dict[str, bytes] = {}
        glue = "" if self.kind == "byte" else " "
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, done in zip(groups, self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(done.ids, self.dtype)
            if self.kind == "byte":
                ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(w.encode()) for w in group])) + 1
            else:
                ends = np.flatnonzero(self.ends[ids]) + 1
            edges, raw = [0, *(ends * self.width).tolist()], ids.tobytes()
            if len(edges) != len(group) + 1 or edges[-1] != len(raw):
                out |= self._each(group)
                continue
            out |= {w: raw[a:b] for w, a, b in zip(group, edges, edges[1:], strict=False)}
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        every = set().union(*cut)
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = every.difference(self.known)
        long = [x for x in fresh if len(x) > LONG]
        fresh.difference_update(long)
        plain = [x for x in fresh if self.plain.fullmatch(x)] if self.kind else []
        fresh.difference_update(plain)
        self.known |= self._words(plain)
        self.known |= self._each(list(fresh))
        get = (self.known | self._each(long) if long else self.known).__getitem__
        return [b"".join(map(get, x)) for x in cut]


def slices(batch: pa.RecordBatch, text: str, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``budget`` bytes at most (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // budget
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
