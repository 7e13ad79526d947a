import random

import numpy as np
import pandas as pd
import pytest

from docspark.llm import passages


def root_of(hashes):
    """The root of the Cartesian tree, built by a stack."""
    stack = []
    for i, h in enumerate(hashes):
        while stack and hashes[stack[-1]] > h:
            stack.pop()
        stack.append(i)
    return stack[0]


def test_compact_windows_equal_the_roots_of_cartesian_trees():
    draw = np.random.default_rng(3)
    t = passages.LEAST_TOKENS
    for n in (45, 46, 47, 60, 200):
        tokens = draw.integers(0, 2**32, n).astype(np.uint32)
        other = draw.integers(0, 2**32, 70).astype(np.uint32)
        several = np.concatenate((other, tokens, other[:20])), np.array([70, n, 20])
        found = {tuple(map(int, x[1:])) for x in zip(*passages.compact_windows(*several)) if x[0] == 1}
        assert {int(x) for x in passages.compact_windows(*several)[0]} == ({0, 1} if n > 45 else {0})
        want = set()
        for f in range(passages.HASHES):
            hashes = (tokens * passages._SEEDS[f]).tolist()
            roots = [s + root_of(hashes[s : s + t]) for s in range(n - t + 1)]
            for root in set(roots):
                starts = [s for s, r in enumerate(roots) if r == root]
                assert starts == list(range(starts[0], starts[-1] + 1))
                want.add((f, hashes[root], starts[0], starts[-1] + t - 1))
        assert found == want


@pytest.mark.parametrize("size", [1, 2, 3, 7, 46])
def test_sliding_minimum(size):
    values = np.random.default_rng(size).integers(0, 1000, (3, 60))
    found = passages.sliding_minimum(values, size)
    want = [[row[i : i + size].min() for i in range(60 - size + 1)] for row in values]
    assert found.tolist() == np.array(want).tolist()


def planted(prose):
    """Texts with a common passage: copied, with an edited word, and of other lengths."""
    passage = prose(60, 900).split()
    edited = passage[:30] + ["changed"] + passage[31:]
    rows = [(i, " ".join([prose(40 + i, i), *passage, prose(70, 50 + i)])) for i in range(1, 9)]
    rows += [(20, " ".join([prose(100, 20), *edited, prose(30, 21)]))]
    rows += [(30, " ".join([prose(100, 30), *passage[:40], prose(30, 31)]))]  # too short
    rows += [(40 + i, prose(200, 600 + i)) for i in range(5)]
    exact = prose(52, 901)
    rows += [(60, f"{prose(33, 61)} {exact}"), (61, f"{exact.upper()}\n{prose(44, 62)}"), (62, exact)]
    return rows


def test_planted_passages(spark, prose):
    docs = spark.createDataFrame(planted(prose), "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.n_words >= 50 and r.n_links >= 1
    assert sorted(map(sorted, classes.values())) == [[1, 2, 3, 4, 5, 6, 7, 8, 20], [60, 61, 62]]
    spans = {r.doc_id: (r.first_word, r.n_words) for r in found}
    assert spans[3] == (43, 60) and spans[62] == (0, 52)


def test_large_group_of_copies_and_a_common_line(spark, prose):
    """A group has no more links than a few times its windows."""
    line = prose(55, 77)
    rows = [(i, f"{prose(20, i)} {line}") for i in range(300)] + [(1000 + i, prose(120, 78)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert passages.similar_passages(docs).count() <= 2 * 3 * 500
    found = passages.repeated_passages(docs).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(len, classes.values())) == [200, 300]


def test_recall_against_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    hasher = passages.Hasher()
    tokens = {i: hasher.tokens(t) for i, t in texts.items()}
    holders = {}
    for i, own in tokens.items():
        for x in set(own.tolist()):
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    want = {x for p in pairs if passages.similar_stretches(tokens[p[0]], tokens[p[1]]) for x in p}
    found = {r.doc_id for r in passages.repeated_passages(documents).collect()}
    assert len(want) > 3 and len(found & want) >= 0.95 * len(want) and found <= want


def test_similar_stretches_by_set_similarity():
    draw = random.Random(8)
    for _ in range(200):
        a = np.array([draw.randrange(10**6) for _ in range(80)], np.int64)
        b = a.copy()
        for i in draw.sample(range(80), draw.randrange(0, 16)):
            b[i] = -i
        share = len(set(a) & set(b)) / len(set(a) | set(b))
        found = passages.similar_stretches(a, b)
        assert not found or all(q - p + 1 >= 46 for p, q, _, _ in found)
        if share >= 0.85:
            assert found


def test_odd_rows(odd_docs, no_docs):
    found = passages.repeated_passages(odd_docs).collect()
    assert {r.doc_id for r in found} == {1, 2, 6, 7}
    assert {r.n_words for r in found if r.doc_id == 7} == {60_000}
    assert passages.repeated_passages(no_docs).count() == 0


def test_a_pair_with_many_regions():
    """Regions beyond the 64th, and one behind many places of b with the same phrase."""
    row = lambda f, la, lb: {"sa": int(passages._spans(f, la, la + 50)), "sb": int(passages._spans(f, lb, lb + 50))}
    far = [row(f, 1000 * i, 1000 * (150 - i)) for i in range(150) for f in (0, 1)]
    places = [row(0, 500, 300 * i) for i in range(100)] + [row(f, 510, 40_000) for f in (1, 2)]
    frame = pd.DataFrame({"a": [1, 1], "b": [2, 3], "spans": [far, places]})
    found = next(passages._regions([frame]))
    assert (found.b == 2).sum() == 150
    assert found[found.b == 3].b0.tolist() == [40_000 - passages.LEAST_TOKENS]


def test_long_documents_with_many_passages(spark, prose):
    shared = [prose(60, 3000 + i) for i in range(110)]
    texts = [" ".join(f"{prose(250, 5000 + 200 * k + i)} {p}" for i, p in enumerate(shared)) for k in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert [sum(r.doc_id == k for r in found) for k in (0, 1)] == [110, 110]


def any_similar(a, b, aligned):
    """Whether any interval of a and any of b are similar: all are tried.

    Both have ends that the other holds, or, if ``aligned``, the same ends.
    """
    t = passages.LEAST_TOKENS
    for i in range(len(a) - t + 1):
        for j in range(len(b) - t + 1):
            if aligned and a[i] != b[j]:
                continue
            first_a, first_b = {}, {}
            for k, x in enumerate(a[i:].tolist()):
                first_a.setdefault(x, k)
            for k, x in enumerate(b[j:].tolist()):
                first_b.setdefault(x, k)
            grid = np.zeros((len(a) - i, len(b) - j), int)
            for x in first_a.keys() & first_b.keys():
                grid[first_a[x], first_b[x]] += 1
            shared = grid.cumsum(0).cumsum(1)
            own = np.cumsum([first_a[x] == k for k, x in enumerate(a[i:].tolist())])[:, None]
            other = np.cumsum([first_b[x] == k for k, x in enumerate(b[j:].tolist())])[None, :]
            fits = shared >= 0.8 * (own + other - shared)
            for p, q in zip(*np.nonzero(fits[t - 1 :, t - 1 :])):
                x, y = a[i : i + p + t], b[j : j + q + t]
                if x[-1] == y[-1] if aligned else {x[0], x[-1]} <= set(y.tolist()) and {y[0], y[-1]} <= set(x.tolist()):
                    return True
    return False


def pieces_of(*parts):
    """Tokens of parts: a number is so many new tokens, a list is itself."""
    fresh = iter(range(10**6, 2 * 10**6))
    return np.array([x for p in parts for x in ([next(fresh) for _ in range(p)] if isinstance(p, int) else p)], np.int64)


def test_stretches_inside_chains():
    passage, phrase = list(range(46)), [500]
    for between in range(5, 12):
        a, b = pieces_of(9, passage, between, phrase), -pieces_of(4, 0, between)
        b = np.concatenate((b[:4], passage, b[4:], phrase))
        found = passages.similar_stretches(a, b)
        assert [(s[0], s[2]) for s in found] == [(9, 4)] and found[0][1] >= 54
    halves = list(range(45)), list(range(45, 90))
    a, b = pieces_of(*halves), pieces_of(halves[0], 18, halves[1])
    assert passages.similar_stretches(a, b) == [(0, 89, 0, 107)]
    # tokens that b holds four times, the passage itself in the middle
    some = passage[3:9]
    b = pieces_of(some, 90, passage, 90, some, 90, some)
    assert passages.similar_stretches(pieces_of(passage), b) == [(0, 45, 96, 141)]


def test_stretches_equal_brute_force():
    draw, hits = random.Random(5), 0
    for n in range(60):
        base = [draw.randrange(30 if n % 3 == 0 else 10**5) for _ in range(draw.randrange(44, 58))]
        sides = []
        for side in (1, 2):
            own, at = list(base), 0
            for _ in range(draw.randrange(0, 3)):
                at = draw.randrange(len(own))
                cut = draw.randrange(0, 4)
                own[at : at + cut] = [side * 10**6 + draw.randrange(10**5) for _ in range(draw.randrange(0, 6))]
            around = lambda: [draw.choice([*base, *[side * 10**7 + draw.randrange(10**5)] * 150]) for _ in range(draw.randrange(9))]
            sides.append(np.array([*around(), *own, *around()], np.int64))
        found = bool(passages.similar_stretches(*sides))
        hits += found
        if any_similar(*sides, aligned=True):
            assert found, (n, [x.tolist() for x in sides])
        elif found:
            assert any_similar(*sides, aligned=False)
    assert 10 < hits < 55


@pytest.fixture(scope="module")
def beside_boilerplate(prose):
    """300 pairs with a common passage of 60 words, of which every document holds 42; ids at random."""
    draw = random.Random(5)
    common, ids, rows = prose(42, 1).split(), list(range(600)), []
    draw.shuffle(ids)
    for i in range(300):
        own, cut = prose(18, 100 + i).split(), draw.randrange(19)
        for side in range(2):
            around = [prose(draw.randrange(20, 80), 1000 * (2 * i + side) + k) for k in (1, 2)]
            rows.append((ids[2 * i + side], " ".join([around[0], *own[:cut], *common, *own[cut:], around[1]])))
    return rows, {tuple(sorted(ids[2 * i : 2 * i + 2])) for i in range(300)}


def test_pairs_among_documents_that_share_boilerplate(spark, beside_boilerplate):
    rows, want = beside_boilerplate
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for n in (1, 16):
        found = passages.similar_passages(docs.repartition(n, "doc_id"))
        pairs = {(r.a, r.b) for r in found.collect()}
        assert len(pairs & want) >= 0.98 * len(want)
        results.append(sorted(map(tuple, passages.repeated_passages(docs.repartition(n, "doc_id")).collect())))
    assert results[0] == results[1]


def test_every_pair_of_a_crowded_group_comes_into_one_class(spark, prose):
    """150 pairs with a passage of 52 words, of which all documents hold 48: too few to be alike to all."""
    common = prose(48, 1)

    def text(i, side):
        tail = " ".join(f"tail{i}x{k}" for k in range(4))
        return f"{prose(30, 2 * i + side)} a{i}x{side} b{i}x{side} {common} {tail} c{i}x{side} {prose(30, 4000 + 2 * i + side)}"

    rows = [(2 * i + side, text(i, side)) for i in range(150) for side in range(2)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(sorted, classes.values())) == [[2 * i, 2 * i + 1] for i in range(150)]


def test_a_line_and_edited_copies_make_few_candidates(spark, prose, monkeypatch):
    """Texts with a common line, and copies edited in many places, meet without a row for each two of them."""
    line, copied, draw = prose(24, 1), prose(150, 2).split(), random.Random(6)
    rows = [(i, f"{prose(40 + i % 50, 10 + i)} {line} {prose(60, 5000 + i)}") for i in range(200)]
    for i in range(150):
        own = list(copied)
        for at in draw.sample(range(150), 5):
            own[at] = f"x{i}y{at}"
        rows.append((1000 + i, " ".join(own)))
    same = prose(30, 3)
    rows += [(2000 + i, f"{prose(30, 9000 + i)} {line} {same} {prose(30, 9100 + i)}") for i in range(2)]
    counts, compared = [], passages._compared

    def counted(pairs, tokens, least):
        pairs = passages.written(pairs, "test-pairs")
        counts.append(pairs.select("a", "b").distinct().count())
        return compared(pairs, tokens, least)

    monkeypatch.setattr(passages, "_compared", counted)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(counts) == 2 and counts[1] <= 3 * 350
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {2000, 2001} in classes.values() and not any(r.doc_id < 200 for r in found)


@pytest.mark.parametrize("kinds", [10**6, 12])
def test_texts_that_meet_at_a_run_lose_no_similar_ones(kinds):
    """Whatever is similar around the run is let pass, one by one and with all others."""
    draw = np.random.default_rng(kinds)
    run, core = draw.integers(10**7, 10**8, passages.RUN), draw.integers(0, kinds, 60)
    texts, before = [], []
    for i in range(40):
        own = core.copy()
        at = draw.integers(0, 60, i % 9)
        own[at] = 10**8 + draw.integers(0, kinds, len(at))
        cut = draw.integers(10, 50)
        around = [10**9 + draw.integers(0, 10**6, draw.integers(0, passages.REACH - 70)) for _ in range(2)]
        texts.append(np.concatenate((around[0], own[:30], run, own[30:] if i % 2 else own[30:cut], around[1])))
        before.append(len(around[0]) + 30)
    meeting = passages._Meeting(np.concatenate(texts).astype(np.uint64), np.array([len(t) for t in texts]), np.array(before))
    common = meeting.common()
    x, y = np.triu_indices(len(texts), 1)
    want = np.array([meeting.link(i, j)[1] for i, j in zip(x.tolist(), y.tolist())])
    assert 20 < want.sum() and (common[x, y] > 0)[want].all() and meeting.may_link(x, y)[want].all()
    pairs = passages._linking(meeting, np.arange(len(texts)), common)
    group = list(range(len(texts)))
    for i, j in [*pairs]:
        group = [group[i] if g == group[j] else g for g in group]
    assert all(group[i] == group[j] for i, j in zip(x[want], y[want]))
    if kinds > 12:
        assert len(pairs) < len(texts) and want.sum() < len(x)


def test_similar_texts_share_a_marked_run():
    draw = np.random.default_rng(4)
    for n in (18, 19, 40):
        same = draw.integers(0, 2**32, n, dtype=np.uint32)
        own = []
        for _ in range(2):
            around = [draw.integers(0, 2**32, draw.integers(0, 60), dtype=np.uint32) for _ in range(2)]
            hashes, marked = passages._marked_runs(np.concatenate((around[0], same, around[1])))
            own.append(set(hashes[marked].tolist()))
        assert own[0] & own[1]


def test_words_hash_alike_wherever_they_stand():
    hasher = passages.Hasher()
    own = hasher.tokens("A b\x0bc d e f\u0130")
    long = hasher.tokens("zz yy " * 200_000 + "a B c\td e f\u0130")
    assert len(own) == 2 and len(long) == 400_002 and long[-2:].tolist() == own.tolist()
    tokens, sizes = hasher.all_tokens([b"a b c d e", b"", b"a b c d", b"a b c d e a"])
    assert sizes.tolist() == [1, 0, 0, 2] and tokens[0] == tokens[1] == own[0] != tokens[2]


def test_texts_of_one_id(spark, prose):
    """The longest text of an id is the document; rows that repeat are one."""
    passage = prose(60, 3)
    rows = [(1, passage), (1, f"{passage} {prose(90, 4)}"), (1, prose(70, 5)), (2, passage), (2, passage), (3, prose(70, 5))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words) for r in found) == [(1, 0, 60), (2, 0, 60)]


def test_single_tokens_by_matrices_equal_the_search(monkeypatch):
    draw = np.random.default_rng(8)
    for _ in range(150):
        x = draw.permutation(400)[: draw.integers(60, 300)].astype(np.uint32)
        y, at = x.copy(), draw.integers(0, len(x), draw.integers(1, 25))
        y[at] = 1000 + np.arange(len(at))
        y = np.concatenate((y[20:], y[:20])) if draw.random() < 0.3 else np.delete(y, at[:2])
        monkeypatch.setattr(passages, "_FEW_RUNS", 256)
        fast = passages.similar_stretches(x, y)
        monkeypatch.setattr(passages, "_FEW_RUNS", -1)
        for stretch in fast:
            a, b = set(x[stretch[0] : stretch[1] + 1].tolist()), set(y[stretch[2] : stretch[3] + 1].tolist())
            assert len(a & b) >= 0.8 * len(a | b) and min(len(a), len(b)) >= passages.LEAST_TOKENS
        cover = lambda found, i: {p for s in found for p in range(s[i], s[i + 1] + 1)}
        slow = passages.similar_stretches(x, y)
        assert cover(fast, 0) == cover(slow, 0) and cover(fast, 2) == cover(slow, 2)


def test_pairs_that_cannot_be_similar_are_left_out_at_once():
    """No pair with similar stretches is left out; texts that share a line, or a word that comes again and again, are."""
    draw = np.random.default_rng(11)
    fresh = lambda n: draw.integers(0, 2**32, n, dtype=np.uint32)
    pairs = []
    for i in range(300):
        same, other = fresh(60), fresh(60)
        if i % 3 == 0:  # a passage of which some tokens differ
            other = same.copy()
            other[draw.choice(60, i % 12, replace=False)] = fresh(i % 12)
        elif i % 3 == 1:  # few tokens that come again
            same, other = (draw.choice(fresh(1 + i % 7), 60) for _ in range(2))
            other[: i % 60] = same[: i % 60]
        pairs.append([np.concatenate((fresh(i % 50), x, fresh(i % 40))) for x in (same, other)])
    line, word = fresh(40), fresh(1)
    useless = [[np.concatenate((fresh(50), line, fresh(50))) for _ in range(2)], [np.concatenate((fresh(30), np.tile(np.append(fresh(9), word), 9))) for _ in range(2)]]
    sides = [(np.concatenate(x), np.array([len(y) for y in x])) for x in zip(*pairs, *useless)]
    let = passages.may_be_similar(*sides[0], *sides[1]).tolist()
    found = [bool(passages.similar_stretches(a, b)) for a, b in pairs]
    assert 50 < sum(found) < 250 and all(m for m, f in zip(let, found) if f)
    assert let[-2:] == [False, False]
