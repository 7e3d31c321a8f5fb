"""Alignment of two tokenizers against whole encodings and all pairs of tokens that overlap."""

import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from laptable.llm import alignment
from laptable.llm import queries as q
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

ODD = ["a", "b", " ", "  ", "\n", "é", "ß", "日", "\x00", "'", "s", "<|endoftext|>", "<s>", "▁", "　", "\x85", "12", "😀", "the", "ing", "\t", "ﬁ", "<0x0A>", "é"]


def plain(rows):
    """The result by whole encodings and a double loop over tokens; rows are (doc_id, text)."""
    a_model = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=public_tokenizers.path(alignment.MODEL_B))
    letters = alignment._byte_letters()
    spelt = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        of_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        of_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if b"".join(of_a) != b"".join(of_b) or b"".join(of_a) != (" " + (text or "")).encode():
            a, b, of_a, of_b = [], [], [], []
        spans = []
        for raw in (of_a, of_b):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [""] * (2 * len(common))
        for side, ids in enumerate((a, b)):
            for i, (_, e) in zip(ids, spans[side], strict=True):
                g = 2 * bisect.bisect_left(common, e) + side
                groups[g] += f",{i}" if groups[g] else str(i)
        starts = [s for s, _ in spans[1]]
        links = [(x, b[k]) for x, (s, e) in zip(a, spans[0], strict=True) for k in range(max(bisect.bisect_right(starts, s) - 1, 0), bisect.bisect_left(starts, e))]
        text_of = ";".join(f"{x}|{y}" for x, y in zip(groups[::2], groups[1::2], strict=True))
        spelt.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    counts = Counter(x for row in spelt for x in row[4])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(d, na, nb, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, na, nb, g, ls, h in spelt], counts


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *[x or 0 for x in r[:1]], r[1:]))


@pytest.mark.parametrize("size", [alignment.CHUNK, 300])
def test_alignment_equals_all_pairs(spark, documents, size):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in documents.where("doc_id < 60 and length(text) < 3000").collect()]
    rows += [(None, "the same row"), (None, "the same row"), (7, "the same row"), (5000, None), (5001, ""), (5002, "x" * 3000)]
    found, counts = alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=size)
    wanted, pairs = plain(rows)
    assert in_order(found.collect()) == in_order(wanted)
    assert {(r["pair"] >> 16, r["pair"] & 65535): r["n"] for r in counts.collect()} == dict(pairs)


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    tools = alignment.aligner(alignment.TOKENIZER_A, alignment.MODEL_B)
    rng = random.Random(4)
    texts = ["".join(rng.choice([*ODD, " the", " a", " word"]) for _ in range(2000)).replace("▁", ""), "y" * 900, None, " ", "a  b " * 300]
    whole = tools.documents(texts)
    monkeypatch.setattr(alignment, "LONG", 100)
    monkeypatch.setattr(alignment, "TOGETHER", 250)
    assert len(alignment._pieces(" " + texts[0])) > 5
    cut = tools.documents(texts)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1]
    assert sorted(whole[2].tolist()) == sorted(cut[2].tolist()) and sorted(whole[3].tolist()) == sorted(cut[3].tolist())


def test_alignment_of_odd_rows(spark, odd, empty):
    found, _ = alignment.align_documents(odd)
    wanted, _ = plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert in_order(found.collect()) == in_order(wanted)
    found, counts = alignment.align_documents(empty)
    assert found.count() == 0 and counts.count() == 0


def test_query_covers_all_documents(spark, documents):
    rows = q.op12_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == documents.count()
    wanted, _ = plain([(r["doc_id"], r["text"]) for r in documents.where("length(text) < 2000").collect()])
    digests = {r[0]: r[-1] for r in wanted}
    assert all(r["groups_sha256"] == digests[r["doc_id"]] for r in rows if r["doc_id"] in digests)
