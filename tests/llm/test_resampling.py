import hashlib
import math
import random
import re
import zlib
from collections import Counter

from docspark.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, items, longest=1, share=10, least=20, buckets=10_000, seed="2024"):
    def features(text):
        own = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]
        return len(own), [zlib.crc32(r.encode()) % buckets for r in runs]

    read = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for r in read for b in r[2]), Counter(b for x in items for b in features(x)[1])
    all_s, all_t = s.total() + buckets, t.total() + buckets
    rows = []
    for doc, n, own in read:
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = Counter()
    drawn = able[: len(able) * share // 100]
    out = Counter((r[0], *r[2:], n) for n, r in enumerate(drawn, 1))
    for r in able[len(drawn) :] + [r for r in rows if r[1] < least]:
        out[(r[0], *r[2:], None)] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_crc_matrices_equal_zlib(monkeypatch):
    draw = random.Random(3)
    words = [draw.randbytes(draw.choice([0, 1, 2, 3, 7, 255, 256, 257, 2000])) for _ in range(500)]
    assert resampling.crc32_of(words).tolist() == [zlib.crc32(w) for w in words]
    assert resampling.crc32_of([]).tolist() == []


def test_equals_the_rules_by_hand(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [(r.doc_id, r.text) for r in documents.collect()]
    texts = [r.text for r in items.collect()]
    assert rows_of(resampling.resample(documents, items)) == by_hand(asked, texts)
    pairs = resampling.resample(documents, items, longest=2, share=35, least_words=60, buckets=97, seed="7")
    assert rows_of(pairs) == by_hand(asked, texts, 2, 35, 60, 97, "7")


def test_small_chunks_and_memory_change_nothing(spark, documents, monkeypatch):
    items = documents.limit(0)
    whole = resampling.bucket_counts(documents.select("text"))
    assert whole.sum() == sum(len(WORD.findall(r.text.translate(LOWER))) for r in documents.collect())
    known = resampling.Buckets(10_000)
    monkeypatch.setattr(resampling, "_KNOWN", 3)
    for words in ({b"a", b"b"}, {b"b", b"c", b"d"}, {b"a"}):
        known.learn(words)
        assert all(known[w] == zlib.crc32(w) % 10_000 for w in words)
    assert resampling.bucket_counts(items.select("text")).sum() == 0


def test_odd_rows_ties_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "some words"), (2, None)], "item_id long, text string")
    asked = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = rows_of(resampling.resample(odd_docs, items, share=60))
    assert got == by_hand(asked, ["some words", None], share=60)
    assert rows_of(resampling.resample(odd_docs, items.limit(0), share=100)) == by_hand(asked, [], share=100)
    assert resampling.resample(no_docs, items).count() == 0
    # documents of one id share their noise; ties go to the smaller id by way of equal scores
    same = spark.createDataFrame([(5, "word " * 30)] * 6, "doc_id long, text string")
    ranks = sorted(r["rank"] or 0 for r in resampling.resample(same, items, share=50).collect())
    assert ranks == [0, 0, 0, 1, 2, 3]
