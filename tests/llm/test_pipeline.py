import zlib

import numpy as np

import corpus_pipeline
from docspark.llm import decontamination, simhash, tokens
from tests.llm.test_simhash import components_of, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
    before = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id for r in kept["language"]} == before  # every text of this table has a language

    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in kept["language"]]
    label = components_of(prints, 4)
    assert sorted(r.doc_id for r in kept["simhash"]) == sorted(set(label.values()))

    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    cut = decontamination.Templates()
    hashes = lambda t: decontamination.window_hashes(cut.tokens(t)[2], 8).tolist()
    own = [hashes(r.text) for r in items]
    held = lambda t: any(sum(w in there for w in x) >= 0.3 * len(x) for there in [set(hashes(t))] for x in own)
    clean = {r.doc_id for r in kept["simhash"] if not held(r.text)}
    assert {r.doc_id for r in kept["decontamination"]} == clean

    mixed = {r.doc_id for r in kept["mixing"]}
    size = {r.doc_id: len(r.text.split()) for r in kept["decontamination"]}
    assert mixed < clean and 0.9 * sum(size.values()) <= sum(size[i] for i in mixed) < sum(size.values())

    encoder, start, want = tokens.Encoder(tokens.default_tokenizer()), 0, []
    for r in sorted(kept["mixing"]):
        ids = encoder.tokenizer.encode(r.text, add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, kept["tokens"])) == want


def test_odd_rows(odd_docs, no_docs, spark, folder):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert {r.doc_id for r in docs.collect()} <= {1, 6, 8, 9}
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/empty-{name}")
        docs = spark.read.parquet(f"{folder}/empty-{name}")
    assert docs.count() == 0


def test_near_copies_never_broadcast_their_cells(spark, documents, monkeypatch):
    """Spark sizes the 70 cells of a fingerprint as one, at any size of the corpus."""
    plans, linked = [], simhash.linked

    def seen(*given):
        found = linked(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "linked", seen)
    corpus_pipeline.drop_near_copies(spark, documents, None).count()
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
