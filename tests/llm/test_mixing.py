import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from docspark.llm import mixing

LEVELS = ["domain", "lang", "source"]


def share(children, budget):
    """Water filling: by weight, again and again among those with room, largest wholes first."""
    left, open_, out = budget, dict(children), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= w * left]
        if not full:
            break
        n = min(full, key=lambda x: (open_[x][1] / open_[x][0], x))
        out[n] = open_.pop(n)[1]
        left -= out[n]
    done, total = 0, sum(w for w, _ in open_.values())
    for n in sorted(open_, key=lambda x: (open_[x][1] / open_[x][0], x)):
        w = open_[n][0]
        out[n] = max(left, 0) * (done + w) // total - max(left, 0) * done // total
        done += w
    return out


def test_budgets_of_a_tree(spark):
    draw = random.Random(2)
    for _ in range(6):
        leaves = [
            (f"d{d}", f"l{x}", f"s{s}", draw.choice([1, 10, 100, 5000]) * draw.randrange(1, 9))
            for d in range(3)
            for x in range(3)
            for s in range(3)
            if draw.random() < 0.8
        ]
        weights = {"domain": {"d0": 5, "d1": 2}, "lang": {"l0": 3}, "source": {"s2": 7}}
        total, epochs = sum(x[3] for x in leaves), draw.choice([1, 2, 5])
        want = {}
        budget = total * draw.choice([1, 2, 5, 9]) // 4

        def descend(prefix, budget):
            level = len(prefix)
            below = defaultdict(int)
            for x in leaves:
                if x[:level] == prefix:
                    below[x[level]] += x[3] * epochs
            names = list(weights.values())[level]
            shares = share({n: (names.get(n, 1), c) for n, c in below.items()}, budget)
            for n, b in shares.items():
                if level == 2:
                    want[(*prefix, n)] = b
                else:
                    descend((*prefix, n), b)

        descend((), budget)
        frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
        rows = mixing.plan(frame, LEVELS, weights, F.lit(budget), epochs).collect()
        assert {(r.domain, r.lang, r.source): r.budget for r in rows} == want
        assert sum(want.values()) == min(budget, total * epochs)


def test_prefixes_of_seeded_epochs(spark):
    docs = [(i, f"s{i % 3}", " ".join(["w"] * (i % 7 + 1))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    levels = {"source": F.col("source")}
    for part in (1, 3, 9):
        rows = mixing.select(frame, levels, {}, F.expr(f"total * {part} div 4"), seed=5).collect()
        taken = defaultdict(list)
        for r in rows:
            taken[r.source, r.epoch].append(r)
        for name in ("s0", "s1", "s2"):
            own = {i: len(t.split()) for i, s, t in docs if s == name}
            epochs = sorted(e for s, e in taken if s == name)
            assert epochs == list(range(1, len(epochs) + 1))
            for e in epochs[:-1]:
                assert sorted(r.doc_id for r in taken[name, e]) == sorted(own)
            last = epochs[-1]
            order = sorted(own, key=lambda i: hashlib.md5(f"5:{last}:{i}".encode()).hexdigest())
            ids = {r.doc_id for r in taken[name, last]}
            assert set(order[: len(ids)]) == ids


def test_odd_rows(odd_docs, no_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    rows = mixing.select(odd_docs, levels, {"lang": {"en": 2}}, F.expr("total * 3"), max_epochs=2).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.epoch)
    # the tree can give two epochs of every document with a word
    assert {i: sorted(e) for i, e in by.items()} == {
        1: [1, 1, 2, 2], 2: [1, 2], 6: [1, 2], 7: [1, 2], 8: [1, 2], 9: [1, 2], None: [1, 2],
    }
    assert mixing.select(no_docs, levels, {}, F.expr("total")).count() == 0
    nothing = mixing.select(odd_docs, levels, {}, F.lit(0))
    assert nothing.count() == 0


def test_no_python_on_the_executors(documents):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    plan = mixing.select(documents, levels, {}, F.expr("total div 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
