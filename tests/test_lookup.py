import pytest
from pyspark.sql import functions as F

from docspark.operators.lookup import expand, lookup
from docspark.operators.ordering import Splitting

HOT = Splitting(slices=8, min_rows=10)


@pytest.mark.parametrize("how", [None, Splitting(), HOT, Splitting(slices=100, min_rows=1)])
def test_lookup_equals_a_left_join(spark, how):
    # one key with half of the rows is in the table, another is not, copies included
    rows = [("hot", "same")] * 60 + [("lost", f"r{i}") for i in range(40)]
    rows += [(f"k{i % 7}", f"v{i % 3}") for i in range(30)] + [(None, "none")]
    df = spark.createDataFrame(rows, "key string, v string").repartition(4)
    table = {"hot": 1, "k1": 2, "k5": None, "extra": 4}
    known = spark.createDataFrame(list(table.items()), "key string, n int")
    got = sorted((r.key or "", r.v, r.n or 0) for r in lookup(df, known, ["key"], how).collect())
    assert got == sorted((k or "", v, table.get(k) or 0) for k, v in rows)


def test_hot_rows_are_spread(spark):
    df = spark.createDataFrame([("hot", i) for i in range(400)], "key string, i int").repartition(4)
    known = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "key string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(df, known, ["key"], HOT)
        sizes = [n for n in joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert sum(sizes) == 400 and len(sizes) > 1 and max(sizes) < 300
        assert joined.filter("n = 1").count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("how", [Splitting(), HOT])
def test_rows_without_a_key_are_spread(spark, how):
    rows = [(None, i) for i in range(300)] + [(f"k{i % 90}", i) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, i int").repartition(4)
    known = spark.createDataFrame([(f"k{i}", i) for i in range(80)], "key string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(df, known, ["key"], how)
        empty = joined.filter("key IS NULL").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(empty) == 300 and max(empty) < 150
        assert joined.count() == 1000 and joined.filter("n IS NOT NULL").count() == sum(i % 90 < 80 for i in range(700))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_spread_depends_on_the_row_alone(spark):
    """A plan whose map tasks may run again must not spread rows by their position."""
    df = spark.createDataFrame([("hot", i) for i in range(50)], "key string, i int")
    plan = lookup(df, df.limit(1).withColumnRenamed("i", "n"), ["key"], HOT)._jdf.queryExecution().toString()
    assert "monotonically" not in plan and "rand(" not in plan


def test_rows_of_a_hot_key_meet_many_parts_in_many_tasks(spark):
    """A file that a third of the requests ask for, with several parts."""
    requests = [(i, "hot" if i % 3 == 0 else f"f{i % 400}" if i % 3 == 1 else None) for i in range(6000)]
    asked = spark.createDataFrame(requests, "request_id int, doc string").repartition(3)
    parts = [("hot", n) for n in range(5)] + [(f"f{i}", n) for i in range(0, 400, 2) for n in range(i % 3)]
    table = spark.createDataFrame(parts, "doc string, part_no int")
    how = Splitting(slices=200, min_rows=50)
    by_doc = {}
    for doc, n in parts:
        by_doc.setdefault(doc, []).append(n)
    want = sorted((i, doc, n) for i, doc in requests for n in by_doc.get(doc, []))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for given in (how, None, Splitting()):
            found = expand(asked, table, ["doc"], given)
            assert sorted((r.request_id, r.doc, r.part_no) for r in found.collect()) == want
        spread = expand(asked, table, ["doc"], how).where("doc = 'hot'")
        per_task = spread.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in per_task) < 0.25 * 10_000 and len(per_task) > 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
