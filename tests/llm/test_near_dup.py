"""Near duplicates against all pairs, and components against a plain union-find."""

import random

import numpy as np
import pyarrow as pa
from laptable.llm import components, near_dup, texthash
from laptable.llm import queries as q
from pyspark.sql import functions as F

from .conftest import SF, WORD, odd_rows, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def smallest(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    pairs = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                pairs.append((a, b))
    return {i: (len(sets[i]), c) for i, c in smallest(pairs, ids).items()}


def near_copies(n=60, seed=1):
    """A text with many edited copies, some of them only linked over others, and unrelated texts of the same words."""
    rng = random.Random(seed)
    base = prose(seed, 120).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(n, n + 20):
        words = list(base)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows


def test_shingle_sets_equal_plain_ones():
    texts = ["", " ", "One two  THREE\ttwo three", "a", "é É e", "x y", "one two three two\nthree one two three", None, "a b c"]
    for k in (1, 2, 5):
        sets = list(texthash.shingle_sets(pa.array([t or "" for t in texts]), k))
        assert [len(s) for s in sets] == [len(shingles(t, k)) for t in texts]
    two = list(texthash.shingle_sets(pa.array(["zz", "A b", "a B", "b a", "ab"]).slice(1), 2))
    assert (two[0] == two[1]).all() and not np.intersect1d(two[0], two[2]).size and not np.intersect1d(two[0], two[3]).size


def test_near_duplicates_equal_all_pairs(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    edited = [(10_000 + i, t) for i, t in near_copies()]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    expected = plain_components(rows + edited, 2)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, 2).collect()}
    assert found == expected
    assert any(c != i for i, (_, c) in expected.items() if i >= 10_000)


def test_pairs_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 65536, (200, near_dup.SYMBOLS)).astype("<u2")
    two = one.copy()
    for row in two:
        row[rng.choice(near_dup.SYMBOLS, 2 * near_dup.CHUNKS - 1, replace=False)] ^= 1
    a, b = near_dup.keys_of(one), near_dup.keys_of(two)
    for i in range(len(a)):
        first = near_dup._first_key(one[i], two[i : i + 1])[0]
        assert a[i][first] == b[i][first] and first == np.flatnonzero(a[i] == b[i])[0]


def test_blocks_within_a_key(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rows = near_copies(40, 7)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert found == plain_components(rows, 2)


def test_two_texts_under_one_id_keep_their_links(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (1, b), (2, f"{b} more"), (3, f"more {a}"), (4, prose(3, 60))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    found = near_dup.near_duplicates(spark.createDataFrame([(5, a), (2, f"{a} more"), (5, b), (3, f"{b} more"), (3, f"{b} more")], "doc_id long, text string"), 2)
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(2, 2), (3, 3), (3, 3), (5, 2), (5, 3)]


def test_odd_rows(spark, odd, empty):
    found = near_dup.near_duplicates(odd, 2).collect()
    assert len(found) == len(odd_rows())
    own = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert own[1][1] == own[2][1] == 1 and own[3] == (0, 3) and own[4] == (0, 4) and own[5] == (0, 5) and own[6] == (1, 6)
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    kept = near_dup.drop_near_duplicates(odd)
    ids = sorted((r["doc_id"] or -1) for r in kept.select("doc_id").collect())
    assert kept.columns == odd.columns and ids == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert kept.where("kept <> 'clash' OR key <> 'clash'").isEmpty()
    assert near_dup.near_duplicates(empty, 2).count() == 0 and near_dup.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    expected = smallest(pairs, {n for p in pairs for n in p})
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {n: c for n, c in expected.items() if n != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_covers_every_document(spark, documents):
    found = q.op6_near_dup(spark, SF)
    assert found.count() == documents.count() and found.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).isEmpty()


def test_blocks_give_every_link_and_hardly_more(spark):
    """Near copies around similarity 0.8: pairs that come out of the blocks, against all pairs of whole sets."""
    rng = np.random.default_rng(5)
    # Lengths on both sides of the bound up to which sets are compared by their own bits.
    texts, lengths = [], (120, 230, 290)
    for length in lengths:
        base = [f"w{length}x{i}" for i in range(length)]
        for _ in range(40):
            words = list(base)
            for at in rng.choice(length, length // 36 + rng.integers(2), replace=False):
                words[at] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = near_dup.cut_lineage(near_dup._signed(docs, 2).withColumnRenamed("doc_id", "rep").withColumn("doc_id", F.col("rep")))
    keys = near_dup._keys(classes)
    several = keys.groupBy("key").count().where("count > 1").select("key")
    members = keys.join(several, "key").withColumn("comp", F.col("rep"))
    sets = near_dup._stored_sets(members.select("rep"), classes, docs, 2)
    pairs = near_dup._across(near_dup.cut_lineage(members), classes, sets, 80).collect()
    shingles = [set(zip(w, w[1:])) for w in map(str.split, texts)]
    share = lambda a, b: 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    links = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if share(a, b)}
    found = [(r["a"], r["b"]) for r in pairs]
    assert len(found) == len(set(found)) and links <= set(found)
    exact = [p for p in found if len(shingles[p[0]]) <= near_dup.SHORT and len(shingles[p[1]]) <= near_dup.SHORT]
    assert len([p for p in exact if p not in links]) <= len(exact) // 50
    # Both kinds of pairs are there.
    together = sum(len(shingles[a] & shingles[b]) > 0 for a in range(len(texts)) for b in range(a + 1, len(texts)))
    assert 100 < len(links) < together - 100
