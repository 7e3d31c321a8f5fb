"""Packing, token files, edit-aware counts and pieces: round trips and brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from laptable.llm import codec, counts, packing, pieces, token_files
from laptable.llm import queries as q
from laptable.llm.packing import encoder
from pyspark.sql import functions as F

from .conftest import SF, odd_rows

ALPHABET = " \n\t  \x1c\x85ab'sét1²É!<́　﻿日"
SPECIAL = ["<|endoftext|>", "a<|endoftext|> b", "it's don't", "  two  spaces \n\n x\t", "", " "]


def plain_ids(name, text):
    return encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_equals_the_tokenizer(documents, name):
    rng = random.Random(1)
    texts = SPECIAL + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [r["text"] or "" for r in documents.limit(100).collect()]
    for text, ids in zip(texts, encoder(name).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain_ids(name, text)


def check_packing(docs, rows, length):
    expected = sorted(plain_ids(packing.TOKENIZER, t) + [packing.END_ID] for _, t in rows)
    by_doc = {}
    windows = {}
    for r in rows_sorted(packing.pack_documents(docs, length).collect()):
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"] and r["length"] > 0
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    whole = []
    for (_, n), parts in by_doc.items():
        copies = sum(start == 0 for start, _ in parts)
        parts.sort()
        runs = [[] for _ in range(copies)]
        for start, ids in parts:
            run = next(x for x in runs if len(x) == start)
            run.extend(ids)
        assert all(len(x) == n for x in runs)
        whole.extend(runs)
    assert sorted(whole) == expected
    assert sorted(windows) == list(range(len(windows)))
    for k, parts in windows.items():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and (ends[-1] == length or k == len(windows) - 1)


def rows_sorted(rows):
    return sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))


def test_packing(spark, documents, odd, empty):
    check_packing(documents, [(r["doc_id"], r["text"]) for r in documents.collect()], 4096)
    check_packing(odd.repartition(3), [(r[0], r[1]) for r in odd_rows()], 128)
    assert packing.pack_documents(empty).count() == 0
    assert q.op3_packing(spark, SF).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_sequences_are_padded_but_at_a_power_of_two(spark):
    for words, full in ((20, 32), (15, 16)):
        docs = spark.createDataFrame([(1, " ".join(["a"] * words))], "doc_id long, text string")
        row = packing.sequences(packing.pack_documents(docs, 32), 32).first()
        assert row["n_tokens"] == words + 1 and len(row["ids"]) == 2 * full


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 5000, codec.BLOCK):
        blocks = [rng.integers(0, 65536, n), np.zeros(n, np.int64), rng.zipf(1.3, n).clip(max=65535), np.arange(n) % 7]
        coded = codec.encode_blocks(blocks)
        assert all((a == b).all() for a, b in zip(blocks, codec.decode_blocks(coded), strict=True))
        assert codec.encode_blocks(blocks[2:3]) == coded[2:3], "a block does not depend on the blocks coded with it"
    assert len(coded[1]) < 1000 and len(coded[3]) < 1500 and len(coded[2]) < 2 * codec.BLOCK
    broken = bytearray(coded[2])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        codec.decode_blocks([bytes(broken)])


def check_files(rows, docs, spark, folder):
    token_files.write_tokens(docs, folder)
    found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert len(found) == len(rows)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = sorted((i or -1, crc(plain_ids("byte_bpe_50k.json", t) + [0])) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in found) == expected


def test_token_files(spark, documents, odd, empty, tmp_path):
    check_files([(r["doc_id"], r["text"]) for r in documents.collect()], documents, spark, str(tmp_path / "a"))
    check_files([(r[0], r[1]) for r in odd_rows()], odd, spark, str(tmp_path / "b"))
    token_files.write_tokens(empty, str(tmp_path / "c"))
    assert token_files.read_tokens(spark, str(tmp_path / "c")).count() == 0


def test_documents_that_span_blocks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(n))) for i, n in enumerate((10, 90_000, 3, 40_000, 5))]
    check_files(rows, spark.createDataFrame(rows, "doc_id long, text string"), spark, str(tmp_path / "d"))
    blocks = token_files.read_blocks(spark, str(tmp_path / "d")).orderBy("part", "block").collect()
    ids = [i for b in blocks for i in b["ids"]]
    assert ids == [i for _, t in rows for i in plain_ids("byte_bpe_50k.json", t) + [0]]


def test_edits_keep_the_counts_right(monkeypatch):
    enc, rng = encoder("byte_bpe_50k.json"), random.Random(3)
    full = lambda t: len(plain_ids("byte_bpe_50k.json", t))
    for leaf in (4, 64):
        monkeypatch.setattr(counts, "LEAF", leaf)
        for _ in range(60):
            text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300)))
            tree = counts.plant([text], enc)[0]
            for _ in range(8):
                start = rng.randint(0, len(text) + 3)
                stop = start + rng.choice([-2, 0, 1, 5, 30])
                insert = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 40])))
                a, b = min(start, len(text)), min(max(stop, start), len(text))
                expected = text[:a] + insert + text[max(a, b) :]
                text, tree, _ = counts.edit(text, tree, start, stop, insert, enc)
                assert text == expected and tree.tokens[1] == full(text) and tree.chars[1] == len(text)


def test_small_edits_encode_little():
    enc = encoder("byte_bpe_50k.json")
    text = " ".join(f"word{i}" for i in range(50_000))
    tree = counts.plant([text], enc)[0]
    _, _, encoded = counts.edit(text, tree, 200_000, 200_003, "xyz", enc)
    assert encoded < 5 * counts.LEAF


def test_edit_tables(spark, odd, empty):
    edits = spark.createDataFrame([(1, 2, 0, 3, "new "), (1, 1, 5, 5, None), (3, 1, 0, 0, "from null"), (99, 1, 0, 0, "x"), (None, 1, 0, 0, "x"), (6, 1, None, 99, "")], "doc_id long, seq int, start int, stop int, insert string")
    found = counts.count_after_edits(counts.build_trees(odd), edits).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        assert r["n_tokens"] == len(plain_ids("byte_bpe_50k.json", r["text"]))
    texts = {r["doc_id"]: r["text"] for r in found}
    assert texts[3] == "from null" and texts[6] == "" and texts[1].startswith("new ")
    assert counts.count_after_edits(counts.build_trees(empty), edits).count() == 0


def test_count_query(spark, documents):
    edited = {r["doc_id"]: r for r in counts.count_after_edits(counts.build_trees(documents), q._edits(documents)).collect()}
    for r in q.op4_counts(spark, SF).collect():
        text = edited[r["doc_id"]]["text"]
        assert r["n_tokens"] == len(plain_ids("byte_bpe_50k.json", text)) and r["text_crc32"] == zlib.crc32(text.encode()) and r["n_edits"] == 3
    for d in documents.collect():
        text, n = d["text"] or "", len(d["text"] or "")
        t = n // 3
        if d["text"] is not None and d["lang"] is not None:
            text = text[:t] + text[t + 17 :]
            text = text[: 2 * t] + d["lang"] + " 42 " + text[2 * t :] + "\n" + (d["source"] or "")
            assert edited[d["doc_id"]]["text"] == text


def best_score(vocabulary, word):
    """Highest sum over all segmentations, by trying each one."""

    def scores(rest):
        if not rest:
            yield 0.0
        for k in range(1, min(len(rest), vocabulary.longest) + 1):
            found = vocabulary.scores.get(rest[:k]) or ((vocabulary.unknown, 0) if k == 1 else None)
            if found:
                yield from (found[0] + x for x in scores(rest[k:]))

    return max(scores(word))


def test_pieces_have_the_best_score():
    v = pieces.vocabulary(pieces.MODEL)
    rng = random.Random(2)
    words = ["".join(rng.choice("thenrdaios▁") for _ in range(n)) for n in range(1, 12) for _ in range(20)] + ["日本x", "é\nß", "▁▁▁a"]
    for word in words:
        ids = np.frombuffer(v.together([word])[0], "<u2").tolist()
        assert v.alone(word) == v.together([word])[0]
        if all(i > 258 for i in ids):
            assert "".join(v.pieces[i] for i in ids) == word
            assert sum(v.scores[v.pieces[i]][0] for i in ids) == best_score(v, word)
    long = "ab" * 3000
    assert v.decode(v.encode([long])[0]) == long


def test_pieces_round_trip(spark, documents, odd, empty):
    for docs in (documents, odd):
        back = pieces.decode_pieces(pieces.encode_pieces(docs)).collect()
        key = lambda r: (r["doc_id"] or -1, r["text"] or "")
        assert sorted(map(key, back)) == sorted(map(key, docs.select("doc_id", F.translate("text", "▁", " ").alias("text")).collect()))
    assert pieces.decode_pieces(pieces.encode_pieces(empty)).count() == 0
    assert q.op9_pieces(spark, SF).where("n_ids = 0 AND n_chars > 0").isEmpty()
