"""Token counts that follow edits: each document keeps a segment tree over runs of pre-tokens.

A text is cut into leaves of about ``LEAF`` characters, only where white space follows a character that is none; pre-tokens
always end there, whatever stands further away. A leaf holds its characters and tokens, inner nodes the sums of their
children, both as flat arrays of twice the (power of two) number of leaves. An edit replaces characters [start, stop) of the
current text. The leaves it touches, with the character before and the one after it as context, are found by descending the
character sums; their new text alone is encoded again, the first of these leaves takes its counts, the others become
empty, and the sums above them are updated. The tokens of the document are the root. A leaf that outgrows four times its size
has the tree built anew from its leaves' texts.

Defined cases: a null text counts as empty; edits reach at most to the end of the text (starts and stops beyond it mean the
end, a stop before the start means none removed), a null insert inserts nothing; edits of a document apply by ``seq``, equal
ones by start, stop and insert; edits of unknown or null documents are left out; rows that repeat a document's id get
the same edits each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import text_or_empty
from laptable.llm.packing import encoder
from laptable.llm.tokens import Encoder, slices

TOKENIZER = "byte_bpe_50k.json"
LEAF = 512
EDGE = re.compile("(?<=[^\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff])(?=[\t-\r ])")
TREES = "doc_id long, text string, chars array<int>, tokens array<int>"
COUNTED = "doc_id long, n_tokens_before long, n_tokens long, n_edits long, chars_encoded long, text string, chars array<int>, tokens array<int>"


def leaves(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        edge = EDGE.search(text, at + LEAF)
        end = edge.start() if edge else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class Tree:
    """Sums of characters and tokens: node 1 is the root, node i has the children 2i and 2i + 1, leaves start at half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.half = chars, tokens, len(chars) // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        half = 1 << max(len(chars) - 1, 0).bit_length()
        arrays = []
        for values in (chars, tokens):
            sums = np.zeros(2 * half, np.int64)
            sums[half : half + len(values)] = values
            size = half
            while size > 1:
                sums[size // 2 : size] = sums[size : 2 * size : 2] + sums[size + 1 : 2 * size : 2]
                size //= 2
            arrays.append(sums)
        return cls(*arrays)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.half:
            node *= 2
            if place - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.half, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.half
        add = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += add[0]
            self.tokens[node] += add[1]
            node //= 2


def plant(texts: list[str], enc: Encoder) -> list[Tree]:
    """The trees of whole texts."""
    cut = [leaves(t) for t in texts]
    sizes = [len(x) // 2 for x in enc.encode([leaf for own in cut for leaf in own])]
    out, at = [], 0
    for own in cut:
        out.append(Tree.of([len(x) for x in own], sizes[at : at + len(own)]))
        at += len(own)
    return out


def edit(text: str, tree: Tree, start: int, stop: int, insert: str, enc: Encoder) -> tuple[str, Tree, int]:
    """The new text, its tree (changed in place), and the characters encoded for it."""
    n = len(text)
    start = min(max(start, 0), n)
    stop = min(max(stop, start), n)
    first, left = tree.find(max(start - 1, 0)) if n else (0, 0)
    last, before = tree.find(min(stop, n - 1)) if n else (0, 0)
    right = before + int(tree.chars[last + tree.half])
    text = text[:start] + insert + text[stop:]
    region = text[left : right + len(insert) - (stop - start)]
    if len(region) > 4 * LEAF * (last - first + 1):
        return text, plant([text], enc)[0], len(text)
    tree.put(first, len(region), len(enc.encode([region])[0]) // 2)
    for leaf in range(first + 1, last + 1):
        if tree.chars[leaf + tree.half]:
            tree.put(leaf, 0, 0)
    return text, tree, len(region)


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text, chars, tokens``: every document with the two arrays of its tree."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                trees = plant(part.column("text").to_pylist(), encoder(tokenizer))
                sums = [pa.array([getattr(t, k).astype(np.int32) for t in trees], pa.list_(pa.int32())) for k in ("chars", "tokens")]
                yield pa.RecordBatch.from_arrays([*part.columns, *sums], names=["doc_id", "text", "chars", "tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(build, TREES)


def count_after_edits(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document with its tokens before and after its edits (doc_id, seq, start, stop, insert), its new text and tree."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for row in part.to_pylist():
                    text, tree = row["text"], Tree(*(np.array(row[k], np.int64) for k in ("chars", "tokens")))
                    before, encoded = int(tree.tokens[1]), 0
                    for e in row["edits"] or []:
                        text, tree, more = edit(text, tree, e["start"] or 0, e["stop"] or 0, e["insert"] or "", enc)
                        encoded += more
                    rows.append((row["doc_id"], before, int(tree.tokens[1]), len(row["edits"] or []), encoded, text, tree.chars, tree.tokens))
                columns = zip(zip(*rows, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=names)

    names = [c.split()[0] for c in COUNTED.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int32())] * 2
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "insert")
    lists = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    joined = trees.join(lists, "doc_id", "left").select("doc_id", "text", "chars", "tokens", "edits")
    return joined.mapInArrow(apply, COUNTED)
