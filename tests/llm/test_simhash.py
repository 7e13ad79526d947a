import itertools
from collections import Counter

import numpy as np
import pytest

from docspark.llm import simhash


def components_of(prints, bits):
    """Smallest id reachable over all pairs of rows at most so many bits apart."""
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(prints, 2):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(r.encode(), 42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_equals_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = components_of(prints, 4)
    assert {i: (fp & (1 << 64) - 1, c) for i, (fp, c) in found.items()} == {i: (fp, want[i]) for i, fp in prints}


@pytest.mark.parametrize("bits,slabs", [(0, 8), (2, 5), (4, 8), (6, 9)])
def test_links_of_dense_fingerprints(spark, bits, slabs):
    import random

    draw = random.Random(bits)
    base = [draw.getrandbits(64) for _ in range(6)]
    near = {b ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(7))) for b in base for _ in range(40)}
    near = sorted({(x & (1 << 64) - 1) - (1 << 64 if x >> 63 & 1 else 0) for x in near})
    frame = spark.createDataFrame([(x,) for x in near], "fp long")
    found = [tuple(r) for r in simhash.linked(frame, bits, slabs).collect()]
    want = {
        (a, b)
        for a, b in itertools.combinations(near, 2)
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_a_chain_is_one_component(spark):
    chain = [0]
    for step in range(30):
        chain.append(chain[-1] ^ (0b1111 << 2 * step))
    frame = spark.createDataFrame([(x,) for x in chain], "fp long")
    from docspark.llm.common import components

    found = components(simhash.linked(frame), "test").collect()
    assert {r.node for r in found} == set(chain) and len({r.component for r in found}) == 1


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] and {c for _, c in by[1]} == {1}
    assert by[3] == by[4] == by[5] == {(0, 3)}
    assert (0, 3) in by[None]
    kept = simhash.one_per_group(odd_docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 6, 8, 9] and set(kept[0].asDict()) == set(odd_docs.columns)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_bits_of_slabs_spare_pair_tests(spark):
    """Random fingerprints meet by their bits hundreds of times less often than by their counts."""
    draw = np.random.default_rng(4)
    prints = draw.integers(-(2**63), 2**63, 6000).tolist()
    near = [p ^ (1 << int(a)) ^ (1 << int(b)) for p, a, b in zip(prints, *draw.integers(0, 62, (2, 300)))]
    prints = list(dict.fromkeys(prints + near))
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    masks = simhash._slab_masks(simhash.SLABS)
    by_counts = by_bits = 0
    odd = 0x5555555555555555
    counts = [((p | p >> 1) & odd) | ((p & p >> 1 & odd) << 1) for p in (p & (2**64 - 1) for p in prints)]
    for chosen in ((0, 1, 2, 3), (1, 3, 5, 7)):
        mask = sum(masks[i] for i in chosen)
        for values in (counts, prints):
            sizes = Counter(v & mask for v in values)
            pairs = sum(n * (n - 1) // 2 for n in sizes.values())
            by_counts, by_bits = (by_counts + pairs, by_bits) if values is counts else (by_counts, by_bits + pairs)
    found = sorted((r.a, r.b) for r in simhash.linked(table).collect())
    want = {(min(p, q), max(p, q)) for p, q in zip(prints, near) if p != q and bin((p ^ q) & (2**64 - 1)).count("1") <= 4}
    assert want <= set(found) and all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in found)
    assert len(set(found)) == len(found) and by_bits <= len(want) and by_counts > by_bits


def test_one_row_of_an_id_stays_whatever_the_order(spark, prose):
    rows = [(1, prose(50, 1), "a"), (1, prose(50, 2), "b"), (1, prose(50, 1), "a"), (2, prose(60, 3), None), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (
        sorted(map(tuple, simhash.one_per_group(d).collect())) for d in (docs.repartition(3), docs.orderBy("source").coalesce(1))
    )
    assert once == again and [r[0] for r in once] == [1, 2] and once[1] == rows[3]


def test_cells_are_never_broadcast(spark, folder):
    """A small table of fingerprints has 70 cells each, which Spark does not count when it sizes a join."""
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{folder}/prints")
    found = simhash.linked(spark.read.parquet(f"{folder}/prints"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
