import random

import pytest
from pyspark.sql import functions as F

from docspark.operators.ordering import Splitting, fold_slices, join_in_order, number_in_order, slicing, text_in_order

HOT = Splitting(slices=16, min_rows=20)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows under one key, the rest under small keys."""
    chance = random.Random(7)
    data = [("hot", f"p{i:05d}", chance.choice(["a", "bb", "", "cccc"])) for i in range(400)]
    data += [(f"k{i % 200}", f"p{i:05d}", f"t{i}") for i in range(800)]
    data.append(("alone", "p", "only"))
    chance.shuffle(data)
    return data


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "doc string, path string, text string").repartition(5)


def test_hot_key_is_cut_and_others_are_not(table):
    cut = slicing(table, ["doc"], ["path"], HOT)
    bounds = cut.bounds.collect()
    assert [b.doc for b in bounds] == ["hot"]
    assert 2 <= len(bounds[0]._bounds) <= 16
    sizes = [r["count"] for r in cut.place(table).filter("doc = 'hot'").groupBy("_slice").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200
    assert cut.place(table).filter("doc <> 'hot' AND _slice <> 0").isEmpty()


def test_bounds_are_the_same_each_time(table):
    once, again = (slicing(table, ["doc"], ["path"], HOT).bounds.collect() for _ in range(2))
    assert once == again


def test_small_keys_are_left_alone(table):
    assert slicing(table, ["doc"], ["path"]).bounds is None
    assert slicing(table, ["doc"], ["path"], None).bounds is None
    assert slicing(table.limit(0), ["doc"], ["path"], HOT).bounds is None


@pytest.mark.parametrize("how", [None, Splitting(), HOT, Splitting(slices=500, min_rows=1)])
def test_numbers_match_brute_force(table, rows, how):
    got = {(r.doc, r.path): r.n for r in number_in_order(table, ["doc"], ["path"], "n", how).collect()}
    want = {}
    for doc, path, _ in sorted(rows):
        want[doc, path] = 1 + sum(1 for d, p, _ in rows if d == doc and p < path)
    assert got == want


@pytest.mark.parametrize("how", [None, HOT])
@pytest.mark.parametrize("part_bytes", [1, 50, 1 << 20])
def test_parts_make_up_the_whole(table, rows, how, part_bytes):
    parts = join_in_order(table, ["doc"], ["path"], "text", ", ", "joined", part_bytes, how).collect()
    assert len({(p.doc, p.part_no) for p in parts}) == len(parts)
    for doc in {d for d, _, _ in rows}:
        mine = [p for p in sorted(parts, key=lambda p: p.part_no) if p.doc == doc]
        assert [(p.part_no, p.part_count) for p in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
        assert "".join(p.joined for p in mine) == ", ".join(t for d, _, t in sorted(rows) if d == doc)
    if part_bytes == 1 << 20 and how is None:
        assert len(parts) == len({d for d, _, _ in rows})


@pytest.mark.parametrize("part_bytes", [1, 3, 50, 700])
def test_slices_do_not_show(spark, table, part_bytes):
    """Hot and plain settings give the same rows, also with a row larger than the limit."""
    big = spark.createDataFrame([("hot", "p00007x", "w" * 90), (None, "p1", "no"), (None, "p2", "key")], table.schema)
    wide = table.union(big).repartition(6)
    plain, hot, fine = (
        sorted(join_in_order(wide, ["doc"], ["path"], "text", "-", "t", part_bytes, how).collect(), key=str)
        for how in (None, HOT, Splitting(slices=500, min_rows=1))
    )
    assert plain == hot == fine


def test_parts_are_bounded(table):
    cut = slicing(table, ["doc"], ["path"], HOT)
    weights = F.octet_length("text")
    parts = fold_slices(cut.spread(table), cut, weights, 40, text=text_in_order("text", ["path"])).collect()
    assert max(len(p.text) for p in parts) <= 40 + 4


def test_one_shuffle_without_hot_keys(table):
    plan = join_in_order(table, ["doc"], ["path"], "text", ", ", "joined")
    text = plan._jdf.queryExecution().executedPlan().toString()
    # the table's own repartition(5) is the other one
    assert text.count("Exchange hashpartitioning(doc") == 1
    assert "Join" not in text


def test_heavy_keys_are_cut_by_bytes(spark):
    """Few rows of many bytes are as hot as many rows; the parts are the same."""
    chance = random.Random(3)
    data = [("heavy", f"p{i:04d}", "x" * 1000) for i in range(1000)]
    data += [("uneven", f"p{i:04d}", "y" * (20_000 if i == 50 else 10)) for i in range(100)]
    data += [(f"k{i % 50}", f"p{i:04d}", "z" * 40) for i in range(2000)]
    chance.shuffle(data)
    table = spark.createDataFrame(data, "doc string, path string, text string").repartition(4)
    how = Splitting(slices=64, min_rows=10_000, min_bytes=15_000)
    weight = F.octet_length("text")
    assert slicing(table, ["doc"], ["path"], how).bounds is None
    cut = slicing(table, ["doc"], ["path"], how, weight=weight)
    assert {r.doc for r in cut.bounds.collect()} == {"heavy", "uneven"}
    sizes = cut.place(table).groupBy("doc", "_slice").agg(F.sum(weight).alias("w")).collect()
    heavy = [r.w for r in sizes if r.doc == "heavy"]
    assert len(heavy) > 30 and max(heavy) < 3 * 1_000_000 / 64
    # a row larger than a fair share is a slice with little beside it
    assert max(r.w for r in sizes if r.doc == "uneven") <= 21_000
    plain, by_bytes = (
        sorted(join_in_order(table, ["doc"], ["path"], "text", "-", "t", 50_000, h, weight=weight).collect())
        for h in (None, how)
    )
    assert plain == by_bytes
    cheap = table.select("doc", F.octet_length("text").alias("n"))
    again = slicing(table, ["doc"], ["path"], how, cheap, weight, F.col("n"))
    assert again.bounds.collect() == cut.bounds.collect()
