import numpy as np
import pytest

from docspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(seed=5, dim=24):
    """Random vectors, near copies around the threshold, copies, a dense region and a chain."""
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((150, dim))
    rows = list(base)
    for noise in (0.01, 0.05, 0.2, 0.25, 0.28, 0.3, 0.32, 0.33, 0.34, 0.36, 0.5):
        rows += [b + noise * np.linalg.norm(b) / dim**0.5 * draw.standard_normal(dim) for b in base[:12]]
    rows += [7.5 * base[3], base[3], base[4], base[4] * 1e-30, base[5] * 1e30]
    centre = draw.standard_normal(dim) * 3
    rows += [centre + draw.standard_normal(dim) * np.linalg.norm(centre) * w / dim**0.5 for w in draw.uniform(0, 0.45, 160)]
    return np.array(rows, np.float32)


def by_hand(ids, rows, least=0.95):
    """All pairs in double precision; links followed one by one."""
    n = len(rows)
    cos = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if a is None or b is None or len(a) != len(b):
                continue
            a, b = np.array(a, np.float64), np.array(b, np.float64)
            good = len(a) and np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()
            cos[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if good else 0
    links = (cos >= least) & ~np.eye(n, dtype=bool)
    out, seen = [None] * n, set()
    for start in range(n):
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            at = todo.pop()
            group.append(at)
            new = [j for j in np.flatnonzero(links[at]).tolist() if j not in seen]
            seen.update(new)
            todo += new
        known = [ids[g] for g in group if ids[g] is not None]
        for g in group:
            least_id = min(known) if known else None
            out[g] = (ids[g], int(links[g].sum()), least_id, ids[g] is not None and ids[g] == least_id)
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture(scope="module")
def table(spark):
    rows = planted()
    ids = list(range(1000, 1000 + len(rows)))
    np.random.default_rng(1).shuffle(ids)
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in zip(ids, rows)], SCHEMA)
    return df.repartition(3), by_hand(ids, [r.tolist() for r in rows])


@pytest.mark.parametrize("how", [dict(miss=0), dict(miss=0, tile=40), dict(bucket=64), dict(bucket=64, tile=20)])
def test_equals_all_pairs(table, how):
    df, want = table
    assert rows_of(vectors.near_duplicates(df, **how)) == want


def test_without_dense_regions(table, monkeypatch):
    df, want = table
    monkeypatch.setattr(vectors, "DENSE", 10**6)
    assert rows_of(vectors.near_duplicates(df, bucket=128)) == want


def test_bound_holds_for_every_pair():
    units = vectors.unit_rows(planted().astype(np.float64))
    codes, scale, lost = vectors.quantised(units)
    close = vectors.tile_products(codes, codes) * np.outer(scale, scale)
    reach = lost[:, None] * (1 + lost) + lost
    assert (np.abs(close - units @ units.T) <= reach).all()
    assert reach.max() < 0.03


def test_products_are_exact():
    draw = np.random.default_rng(2)
    for dim in (3, 64, 2000):
        a, b = (draw.integers(-127, 128, (20, dim)).astype(np.int8) for _ in "ab")
        a[0] = b[0] = 127
        assert (vectors.tile_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_tables_meet_often_enough():
    for rows in (10**5, 10**9, 10**12):
        bits, tables = vectors.table_plan(rows, 0.95, 1e-4)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** tables <= 1e-4 and rows / 2**bits <= vectors.BUCKET
    assert vectors.table_plan(10**9, 0.95, 0) == (0, 1)


def test_recall_at_the_threshold(spark):
    """Pairs a little closer than the threshold, in many small buckets, against all pairs."""
    draw = np.random.default_rng(9)
    base = vectors.unit_rows(draw.standard_normal((600, 64)))
    side = draw.standard_normal(base.shape)
    side = vectors.unit_rows(side - (side * base).sum(1, keepdims=True) * base)
    angle = np.arccos(draw.uniform(0.9501, 0.953, (600, 1)))
    rows = np.concatenate((base, np.cos(angle) * base + np.sin(angle) * side)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(rows)], SCHEMA)
    found = vectors.near_duplicates(df, bucket=16)
    assert found.where("n_links = 1 and component_id = vec_id % 600").count() >= 1198


def test_no_pair_is_left_out(spark):
    """Pairs above the threshold that share no bucket in any table of random directions."""
    draw = np.random.default_rng(4)
    base = vectors.unit_rows(draw.standard_normal((60_000, 64)))
    side = draw.standard_normal(base.shape)
    side = vectors.unit_rows(side - (side * base).sum(1, keepdims=True) * base)
    near = (0.9502 * base + (1 - 0.9502**2) ** 0.5 * side).astype(np.float32)
    base = base.astype(np.float32)
    bits, tables = vectors.table_plan(600, 0.95, 1e-4, 16)
    one, two = (vectors.bucket_keys(vectors.quantised(vectors.unit_rows(x.astype(np.float64)))[0], bits, tables) for x in (base, near))
    unmet = np.flatnonzero((one != two).all(axis=1))[:300]
    assert len(unmet) >= 2
    others = np.setdiff1d(np.arange(300), unmet)[: 300 - len(unmet)]
    rows = np.concatenate((base[unmet], base[others], near[unmet], near[others]))
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(rows)], SCHEMA)
    found = vectors.near_duplicates(df, bucket=16, tile=32)
    assert found.where("n_links = 1 and component_id = vec_id % 300").count() == 600


def test_large_dense_regions_in_blocks_of_their_own(spark):
    """Two regions above a block, one of them at the edge of the other, and pairs between."""
    draw = np.random.default_rng(6)
    centre = vectors.unit_rows(draw.standard_normal((1, 16)))
    turned = draw.standard_normal((1, 16))
    turned = vectors.unit_rows(turned - (turned * centre).sum() * centre)
    angle = np.arccos(0.95) * 1.1
    other = np.cos(angle) * centre + np.sin(angle) * turned
    rows = np.concatenate([c + draw.standard_normal((120, 16)) * 0.02 for c in (centre, other)] + [draw.standard_normal((60, 16))])
    rows = rows.astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(rows)], SCHEMA)
    assert rows_of(vectors.near_duplicates(df, tile=25)) == by_hand(list(range(len(rows))), [r.tolist() for r in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.001, 0.0]),
        (None, [0.0, -1.0]), (None, None), (11, [-1.0, 0.0]), (12, [0.3, 0.0]), (13, [1e-45, 0.0]),
    ]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    for name in "rep weight ball bucket place side tile n a b first component".split():
        df = df.selectExpr("*", f"'other' AS {name}")
    given = [None if e is None else [nan if x is None else float(np.float32(x)) for x in e] for _, e in rows]
    assert rows_of(vectors.near_duplicates(df)) == by_hand([i for i, _ in rows], given)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
