import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from docspark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def by_hand(rows, least=3, top=200):
    """The contract's rules on plain Python numbers, every term of every group."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, held = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        docs[lang].update(set(found))
        held[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(held[lang, s]) for s in sources}
        whole = shares(sum((held[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [
                (-f(own[s][t], whole[t]), t.encode())
                for t in kept
                if held[lang, s][t] and own[s][t] > whole[t]
            ]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, n) for n, (v, i) in enumerate(found, 1)}
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_equals_the_rules_by_hand(documents, monkeypatch):
    asked = [(r.lang, r.source, r.text) for r in documents.collect()]
    found = rows_of(divergence.audit(documents))
    assert len(found) == len(set(found)) and set(found) == by_hand(asked)


def test_odd_rows_and_few_terms(spark, odd_docs):
    more = odd_docs.select("doc_id", "text", "lang", "source").union(
        spark.createDataFrame(
            [(i, f"Same words É {'here' * (i % 2)} x{i}", lang, s) for i, (lang, s) in enumerate([("en", "a"), ("en", "b"), ("en", None)] * 4)],
            "doc_id long, text string, lang string, source string",
        )
    )
    found = rows_of(divergence.audit(more, top_terms=7))
    assert set(found) == by_hand([(r.lang, r.source, r.text) for r in more.collect()], top=7)
    clashing = rows_of(divergence.audit(odd_docs))
    assert set(clashing) == by_hand([(r.lang, r.source, r.text) for r in odd_docs.collect()])
    assert {(r[0], r[1]) for r in clashing} >= {("de", "b"), ("de", "c")}  # no kept term, yet a pair
    assert all(r[4] == 0 for r in clashing if r[0] == "de")


def test_empty_table(no_docs):
    assert divergence.audit(no_docs).count() == 0


def test_spilled_stripes_add_up(monkeypatch):
    rows = [("en", f"s{i % 3}", f"alpha beta{i % 5} alpha") for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])

    def folded(limit):
        monkeypatch.setattr(divergence, "_STRIPES", limit)
        total, n = Counter(), 0
        for part in divergence._folded([batch.slice(0, 15), batch.slice(15)]):
            n += 1
            for r in part.to_pylist():
                for s, c in zip(r["sources"], r["counts"]):
                    total[r["lang"], r["term"], s] += c
        return total, n

    (whole, one), (spilled, many) = folded(10**6), folded(2)
    assert one == 1 < many and whole == spilled and whole["en", "alpha", None] == 40


def test_pairs_of_a_stripe_in_blocks(monkeypatch):
    draw = np.random.default_rng(1)
    stripes = [[{"id": int(g), "p": int(p), "p0": 7 + int(g)} for g, p in zip(draw.permutation(9)[:n], draw.integers(1, 10**9, n))] for n in draw.integers(1, 9, 50)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(stripes, kind)], names=["stripe"])
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for stripe in stripes:
        for a in stripe:
            for b in stripe:
                if a is not b:
                    want[a["id"], b["id"]] += f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"])
    for pairs, sums in ((1 << 20, 1 << 20), (5, 3)):
        monkeypatch.setattr(divergence, "_PAIRS", pairs)
        monkeypatch.setattr(divergence, "_SUMS", sums)
        got = Counter()
        for part in divergence._shared_terms([batch.slice(0, 20), batch.slice(20)]):
            for r in part.to_pylist():
                got[r["a"], r["b"]] += r["value"]
        assert got == want
