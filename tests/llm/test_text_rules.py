"""Quality rules, secrets and repeated lines against plain Python."""

import hashlib
import re
from collections import Counter

from laptable.llm import line_dedup, quality, secrets
from laptable.llm import queries as q
from pyspark.sql import functions as F

from .conftest import CLASHES, SF, WORD, prose

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, lines, covered, same = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            same += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


def base_spans(text):
    text = text or ""
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS.values()) for m in p.finditer(text) if len(m[g]) >= n)


def test_quality_counts_and_flags(spark, documents, odd):
    for docs in (documents, odd):
        for row in quality.document_rules(docs.select("doc_id", "text")).collect():
            expected = counts(row["text"])
            assert tuple(row[c] for c in quality.COUNTS) == expected, row["doc_id"]
            assert row["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])


def test_quality_repeats(spark):
    text = prose(1, 10) + " " + prose(1, 10) + " " + prose(2, 50)
    rows = [(1, text), (2, " ".join(["same"] * 40)), (3, prose(3, 8)), (4, "a\na\n\nb\n b\na")]
    for row in quality.document_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert tuple(row[c] for c in quality.COUNTS) == counts(row["text"])


def test_poor_hosts_reject_only_documents_that_fail_the_strict_rules(spark):
    bad, good = " ".join(f"w{i}###" for i in range(30)), prose(5, 30)
    rows = [(i, bad if i % 10 else good, "poor") for i in range(40)] + [(100 + i, good if i % 20 else bad, "fine") for i in range(40)]
    rows += [(200, bad, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality.judge_documents(docs, keep_text=False).collect()}
    assert found[0]["kept"] and found[0]["host_poor"] and not found[1]["kept"]
    assert found[100]["kept"] and not found[100]["host_poor"] and found[200]["kept"]
    rates = {r["source"]: r["host_rate"] for r in found.values() if r["source"]}
    assert 0.85 < rates["poor"] < 0.9 and 0.05 < rates["fine"] < 0.1


def test_quality_odd_rows(spark, odd, empty):
    kept = quality.keep_good_documents(odd)
    assert kept.columns == odd.columns and kept.where("spans <> 'clash' OR kept <> 'clash'").isEmpty()
    assert sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == [1, 2, 2, 7, 8, 9]
    assert kept.where("doc_id IS NULL").count() == 2
    assert quality.keep_good_documents(empty).count() == 0 and quality.judge_documents(empty, keep_text=False).count() == 0


def test_base_spans(spark, documents, odd):
    tricky = [
        "token=secret=abcdefgh1 token: api_key: ABCDEFGHI PASSWORD : 'aaaaaaaa' passwd=short secret==longenough",
        "AKIA AKIAAKIA12345678 AKIA1234 AKIAABCDEFGHIJKL" + "f" * 40 + "é" + "0" * 32,
        "Tokén token = éabcdefghi api_key\"= \"abcdefgh\" apikey='12345678' secret = abcdefghij",
        "token=" + "a1" * 3000 + " " + "AKIA" * 2000,
    ]
    extra = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for docs in (documents, odd, extra):
        rows = docs.select("doc_id", "text").withColumn("s", secrets.base_spans(F.coalesce("text", F.lit("")))).collect()
        for row in rows:
            assert [(s["start"], s["rank"], s["end"]) for s in row["s"]] == base_spans(row["text"]), row["doc_id"]


def test_markov_models_tell_keys_from_words(spark, documents):
    ratios = secrets.train(secrets.corpus_samples(documents))
    names = ["user_account_number_2", "some-long-name-of-a-file-2024", "index_of_the_last_item_10", "thehandleofthenextitem7"]
    keys = [hashlib.sha256(str(i).encode()).hexdigest()[:30].upper() for i in range(20)] + ["ghp_x8Kd02LmQz71PwVn34RtYb56", "Zx9Qw3Er7Ty1Ui5Op2As8Df4"]
    rows = [(k, f"before {s} after") for k, s in enumerate(names + keys)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()
    hit = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["rank"] == 3] for r in found}
    assert not any(hit[k] for k in range(len(names)))
    assert sum(bool(hit[k]) for k in range(len(names), len(rows))) >= len(keys) - 1
    assert all(v == [(7, 7 + len(rows[k][1]) - 13)] for k, v in hit.items() if v)


def test_redaction(spark, odd, empty):
    ratios = [0.0] * len(secrets.ALPHABET) ** 2
    found = secrets.find_secrets(odd.select("doc_id", "text", F.col("text").alias("old")), ratios)
    for row in secrets.redact(found).collect():
        text, last = "", 0
        merged = []
        for s, _, e in base_spans(row["old"]):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            text, last = text + row["old"][last:s] + "[SECRET]", e
        assert row["text"] == (text + row["old"][last:] if merged else row["old"])
    assert secrets.find_secrets(empty, secrets.train(secrets.corpus_samples(empty))).count() == 0


def test_secret_query(spark, documents):
    rows = {r["doc_id"]: r for r in q.op5_secrets(spark, SF).collect()}
    for d in documents.collect():
        spans = base_spans(d["text"])
        row = rows[d["doc_id"]]
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[1] == i for s in spans) for i in range(3)]
        text = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert text in row["spans"] or "markov" in row["spans"]


def plain_dedup(rows, words=40, letters=240, unit=r"[^\n.!?。！？]*[\n.!?。！？]+\x20*|[^\n.!?。！？]+"):
    """(id, text) -> remaining text and removed spans, with rows in order of id (null last) and text hash."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None)):
        runs, run, gone = [], [], []
        for m in re.finditer(unit, t or ""):
            norm = re.sub(r"[\W_]+", " ", m[0].lower()).strip()
            if norm:
                if norm in seen:
                    run.append((m.start(), m.end(), norm))
                elif run:
                    runs, run = [*runs, run], []
                seen.add(norm)
        for r in [*runs, run]:
            if sum(len(x[2].split(" ")) for x in r) >= words or sum(len(x[2].replace(" ", "")) for x in r) >= letters:
                gone.append((r[0][0], r[-1][1]))
        edges = [0, *[e for span in gone for e in span], len(t or "")]
        rest = None if t is None else "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out[(i, t)] = rest, gone
    return out


def test_line_dedup(spark, documents, odd, empty):
    for docs in (documents, odd.drop("removed")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        expected = plain_dedup(rows)
        marked = docs.withColumn("old", F.col("text"))
        for r in line_dedup.drop_repeated_units(marked).collect():
            text, spans = expected[(r["doc_id"], r["old"])]
            assert r["text"] == text and [tuple(s) for s in r["removed"]] == spans
    assert line_dedup.drop_repeated_units(empty).count() == 0
    assert line_dedup.drop_repeated_units(odd).where("kept <> 'clash'").isEmpty()
    assert set(CLASHES) <= set(line_dedup.drop_repeated_units(odd).columns)


def deduped(spark, texts, *more):
    rows = list(enumerate(texts))
    return {r["doc_id"]: r for r in line_dedup.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), *more).collect()}


def test_paragraphs(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    found = deduped(spark, [f"{a}\n\n{b}", f"{c}\n \n{a.upper()}!\n\n{a}", None], "paragraph")
    assert found[0]["text"] == f"{a}\n\n{b}" and found[1]["text"] == f"{c}\n \n" and found[2]["text"] is None
    assert [tuple(s) for s in found[1]["removed"]] == [(len(c) + 3, len(c) + 6 + 2 * len(a))]


def test_passages_however_they_are_wrapped(spark):
    sentences = [prose(k, 9) + "." for k in range(10, 17)]
    passage, lines = " ".join(sentences), "\n".join(sentences)
    own = [f"{prose(k, 12)}. " for k in range(30, 40)]
    chinese = "".join(chr(0x4E00 + k * 7 % 5000) + ("。" if k % 20 == 19 else "") for k in range(320))
    texts = [own[0] + passage + own[1], own[2] + lines + "\n" + own[3], own[4] + passage + " " + own[5], own[6] + sentences[0] + own[7], chinese, own[8] + chinese + own[9]]
    found = deduped(spark, texts)
    assert found[0]["text"] == texts[0] and found[3]["text"] == texts[3] and found[4]["text"] == chinese
    for k in (1, 2, 5):
        assert found[k]["text"] == "".join(own[2 * k : 2 * k + 2] if k < 5 else own[8:])
        assert [texts[k][s["start"] : s["end"]].strip() for s in found[k]["removed"]] == [{1: lines, 2: passage, 5: chinese}[k]]


def test_a_line_in_every_document_is_no_hot_key(spark, monkeypatch):
    """Common digests are broadcast: with every digest of two or more common, the plan gives the same rows."""
    common = prose(5, 45)
    texts = [f"{prose(100 + k, 20)}.\n{common}\n{prose(400 + k, 20)}." for k in range(200)]
    wanted = {k: plain_dedup(list(enumerate(texts)))[(k, t)] for k, t in enumerate(texts)}
    for hot in (line_dedup.HOT, 50):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {k: (r["text"], [tuple(s) for s in r["removed"]]) for k, r in deduped(spark, texts).items()} == wanted
    assert sum(bool(w[1]) for w in wanted.values()) == 199
