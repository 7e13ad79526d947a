"""Mixing sources to target weights, with DataFrame operations only.

A budget of tokens goes down a tree (domain, language, source). Siblings share
their parent's budget by weight. A child never gets more than its subtree can
give in ``max_epochs``; what it leaves goes to its siblings by weight, and only
what all siblings together cannot take has been left, by the same rule one level
up, to the parent's siblings. A leaf fills its budget with whole epochs, each in
a seeded order of its own, and a prefix of the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import written

SEED = 7
MAX_EPOCHS = 3
BUCKETS = 4096  # an epoch is ordered in so many parts by its hash; three hex digits


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: str) -> Column:
    """Where an epoch puts a document: a hash of seed, epoch and id."""
    parts = [F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts))


def share_out(children: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Adds ``budget`` to rows ``(parent..., child, weight, capacity, given)``.

    ``given`` is the parent's budget. In the order of capacity per weight, a child
    takes all it can hold as long as that is no more than its share of what is
    left; the rest is dealt by weight to the remaining ones, rounded so that no
    token is lost.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(child))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    big = "decimal(38,0)"
    marked = (
        children.withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(after))
        .withColumn("_left", F.col("given") - F.col("_before"))
        .withColumn(
            "_full",
            F.col("capacity").cast(big) * F.col("_weights")
            <= F.col("weight").cast(big) * F.greatest(F.col("_left"), F.lit(0)),
        )
    )
    # the first child that is not full has the rest, and the weights it is dealt by
    rest = F.max(F.when(~F.col("_full"), F.struct(F.col("_weights").alias("w"), F.col("_left").alias("r")))).over(whole)
    upto = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(
        by.rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = marked.withColumn("_rest", rest).withColumn("_upto", upto)

    def dealt(weight):
        return F.expr(
            f"cast((cast(greatest(_rest.r, 0) as decimal(38,0)) * ({weight})) div _rest.w as bigint)"
        )

    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(dealt("_upto") - dealt("_upto - weight"))
    return marked.withColumn("budget", budget).select(*children.columns, "budget")


def plan(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: dict[str, dict[str, int]],
    budget: Column,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``(levels..., tokens, budget)`` of each leaf of ``leaves (levels..., tokens)``.

    ``weights`` maps a level to weights by node name, whole numbers of at least 1;
    nodes without one weigh 1. ``budget`` is an expression over ``total``, all tokens.
    """
    above: list[str] = []
    given = None
    for level in levels:
        names = weights.get(level, {})
        weight = F.lit(1)
        for name, w in names.items():
            weight = F.when(F.col(level) == name, F.lit(w)).otherwise(weight)
        nodes = leaves.groupBy(*above, level).agg(
            F.sum("tokens").alias("tokens"), (F.sum("tokens") * max_epochs).alias("capacity")
        )
        nodes = nodes.withColumn("weight", weight.cast("long"))
        if given is None:  # the few nodes of the top level, with the budget of the whole
            total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
            nodes = nodes.withColumn("total", total).withColumn("given", budget.cast("long")).drop("total")
        else:
            nodes = nodes.join(given, above)
        shared = share_out(nodes, above or [F.lit(1)], level)
        above = [*above, level]
        given = shared.select(*above, F.col("budget").alias("given"))
    return shared.select(*above, "tokens", "budget")


def select(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    budget: Column,
    seed: int = SEED,
    max_epochs: int = MAX_EPOCHS,
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` once per epoch that takes them, with ``epoch`` and ``n_tokens``.

    The last document of a leaf's prefix is taken whole. Documents without a word
    hold no token and are never taken. Null levels form a node ``(none)``. Rows of
    one id and leaf have the same place in an epoch, so repeated rows go together.
    An empty table gives an empty result. Columns ``epoch`` and ``n_tokens`` of
    ``docs`` are replaced.

    What a leaf takes is found from sums of 4,096 hash ranges per leaf; only the
    documents of the one range in which a prefix ends are put in order. Documents
    then meet the plan of their leaf, one row per leaf, and are not shuffled.
    """
    names = list(levels)
    own = [f"_{n}" for n in names]
    nodes = [F.coalesce(levels[n].cast("string"), F.lit("(none)")).alias(o) for n, o in zip(names, own)]
    sizes = written(
        docs.select(F.col("doc_id"), *nodes, words(text_col).alias("n")).where("n > 0"), "mix-sizes"
    )
    leaves = sizes.groupBy(*own).agg(F.sum("n").alias("tokens"))
    shares = plan(leaves, own, {f"_{k}": v for k, v in weights.items()}, budget, max_epochs)
    full = F.expr("cast(budget div tokens as int)")
    shares = written(
        shares.withColumn("full", full).withColumn("rest", F.expr("budget - (budget div tokens) * tokens")),
        "mix-shares",
    )
    key = order_key(seed, F.col("full") + 1, "doc_id")
    placed = sizes.join(shares.where("rest > 0"), own).select(*own, "n", "rest", key.alias("key"))
    placed = written(placed.withColumn("bucket", F.substring("key", 1, 3)), "mix-order")
    buckets = placed.groupBy(*own, "bucket").agg(F.sum("n").alias("m"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        buckets.withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0)))
        .where("before < rest and before + m >= rest")
        .select(*own, "bucket", "before")
    )
    inside = Window.partitionBy(*own).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        placed.join(last, [*own, "bucket"])
        .groupBy(*own, "key", "rest", "before")
        .agg(F.sum("n").alias("n"))
        .withColumn("start", F.col("before") + F.sum("n").over(inside) - F.col("n"))
        .where("start < rest")
        .groupBy(*own)
        .agg(F.max("key").alias("cut"))
    )
    plan_rows = written(shares.join(cut, own, "left").select(*own, "full", "cut"), "mix-plan")
    rest_columns = [c for c in docs.columns if c not in ("epoch", "n_tokens")]
    sized = docs.select(*rest_columns, *nodes, words(text_col).alias("n_tokens")).where("n_tokens > 0")
    taken = F.when(key <= F.col("cut"), F.col("full") + 1).otherwise(F.col("full"))
    return (
        sized.join(plan_rows, own)
        .withColumn("_times", taken)
        .where("_times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*rest_columns, "epoch", "n_tokens")
    )
