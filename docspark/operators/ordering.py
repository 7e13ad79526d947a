"""Numbering and folding rows in order, without one task per key.

A page list, a sheet or a document can hold a large share of all rows, so
neither a plain window per key nor one string per key is safe. Two measures:

* Keys above a fair share of the rows, or of the bytes where rows are weighed, are cut
  into slices: ranges of the order columns, bounded by order values sampled by hash, in
  proportion to rows and bytes. One task sorts one slice, and offsets
  between slices come from counts. Whether such keys exist is asked first, by one
  aggregate over the key columns; without them the plan is a plain window.
* Text is folded into parts of bounded size, cut by the running size over the whole
  key and numbered 1 to ``part_count``. Parts in ``part_no`` order are the whole
  text; a text below the limit is one part. Slices do not show in the result.

Sizes: with ``slices`` = S at most S keys can exceed 1/S of the rows and as many 1/S of
the bytes, and the expected number of slice bounds over all hot keys is at most 4 * S. That does
not grow with the data, so the driver may hold the bounds and joins to them
are broadcast. Sampling by hash is a function of the row's order value, so the
bounds are the same whenever they are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
# Bounds are picked from a sample this many times larger, to even out slice sizes.
_OVERSAMPLE = 8

DEFAULT_PART_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Splitting:
    """A key is hot above ``min_rows`` rows and 1/``slices`` of all rows, or the same in bytes."""

    slices: int = 2048
    min_rows: int = 200_000
    min_bytes: int = 1 << 30


@dataclass(frozen=True)
class Slicing:
    """How rows of ``keys`` are spread: by key, or by key and slice where keys are hot."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bounds: DataFrame | None = None
    most_bounds: int = 0

    @property
    def columns(self) -> list[str]:
        return [*self.keys] if self.bounds is None else [*self.keys, SLICE]

    def place(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` if any key is hot: how many bounds lie at or below the row.

        The bounds are searched by halving: some ten comparisons for a thousand slices.
        """
        if self.bounds is None:
            return df
        at = F.struct(*self.order)
        steps = [F.lit(1 << i) for i in reversed(range(self.most_bounds.bit_length()))]
        below = F.aggregate(
            F.array(*steps),
            F.lit(0),
            lambda n, step: F.when(F.get("_bounds", n + step - 1) <= at, n + step).otherwise(n),
        )
        return (
            df.join(F.broadcast(self.bounds), [*self.keys], "left")
            .withColumn(SLICE, F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(below))
            .drop("_bounds")
        )

    def spread(self, df: DataFrame) -> DataFrame:
        """Place the rows and shuffle them so that a task holds whole slices.

        The shuffle is asked for by name: partitioning by key alone would also
        satisfy a window over key and slice, and keep a hot key in one task.
        """
        return self.place(df).repartition(*self.columns)

    def first_in_key(self) -> Column:
        """True for the first row of each key."""
        first = F.row_number().over(self.window()) == 1
        return first if self.bounds is None else first & (F.col(SLICE) == 0)

    def window(self):
        return Window.partitionBy(*self.columns).orderBy(*self.order)


@dataclass(frozen=True)
class HotKeys:
    """Keys above their fair share (``table``: keys, ``_n`` rows) and these shares."""

    table: DataFrame
    fair_rows: int
    fair_bytes: int


def hot_keys(
    df: DataFrame, keys: Sequence[str], how: Splitting, weight: Column | None = None
) -> HotKeys | None:
    """The keys above their fair share of rows, or of ``weight`` in bytes; None without such keys.

    Fewer than ``slices`` keys by each measure, whatever the size of the data.
    """
    heavy = F.lit(0) if weight is None else F.coalesce(weight, F.lit(0))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(heavy.cast("bigint")).alias("_w"))
    seen = sizes.agg(
        F.sum("_n").alias("rows"), F.max("_n").alias("largest"), F.sum("_w").alias("bytes"), F.max("_w").alias("heaviest")
    ).first()
    fair = max(how.min_rows, -(-(seen.rows or 0) // how.slices))
    fair_bytes = max(how.min_bytes, -(-(seen.bytes or 0) // how.slices))
    if (seen.largest or 0) <= fair and (seen.heaviest or 0) <= fair_bytes:
        return None
    hot = sizes.filter((F.col("_n") > fair) | (F.col("_w") > fair_bytes)).select(*keys, "_n")
    return HotKeys(df.sparkSession.createDataFrame(hot.toArrow(), hot.schema), fair, fair_bytes)


def slicing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    how: Splitting | None = Splitting(),
    counted: DataFrame | None = None,
    weight: Column | None = None,
    counted_weight: Column | None = None,
) -> Slicing:
    """Look for hot keys and choose slice bounds for them. ``how=None`` never splits.

    ``weight`` is the bytes of a row. ``counted`` is a table to count keys in, where one is
    cheaper to read than ``df``, and ``counted_weight`` the bytes that one of its rows stands for.
    """
    plain = Slicing(tuple(keys), tuple(order))
    if how is None:
        return plain
    found = hot_keys(df, keys, how, weight) if counted is None else hot_keys(counted, keys, how, counted_weight)
    if found is None:
        return plain
    # a row is drawn as often as its part of a fair share, in rows or bytes, asks for
    share = F.lit(_OVERSAMPLE / found.fair_rows)
    if weight is not None:
        share = F.greatest(share, F.coalesce(weight, F.lit(0)) * F.lit(_OVERSAMPLE / found.fair_bytes))
    chance = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) / F.lit(1 << 30)
    copies = F.floor(share) + F.when(chance < share - F.floor(share), 1).otherwise(0)
    at = F.array_repeat(F.struct(*order), F.least(copies, F.lit(_OVERSAMPLE)).cast("int"))
    wanted = df if weight is not None else df.select(*dict.fromkeys([*keys, *order]))
    sampled = (
        wanted.join(F.broadcast(found.table.select(*keys)), [*keys])
        .select(*keys, F.explode(at).alias("_at"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_at")).alias("_sampled"))
    )
    every = F.filter("_sampled", lambda _, i: i % _OVERSAMPLE == _OVERSAMPLE - 1)
    bounds = sampled.select(*keys, F.array_distinct(every).alias("_bounds"))
    # about 4 * slices order values in all at most: computed once and held by the driver
    held = bounds.toArrow()
    most = max(map(len, held["_bounds"].to_pylist()), default=0)
    if not most:
        return plain
    table = df.sparkSession.createDataFrame(held, bounds.schema)
    return Slicing(tuple(keys), tuple(order), table, most)


def number_slices(df: DataFrame, cut: Slicing, name: str, single: str | None = None) -> DataFrame:
    """Spread rows by ``cut`` and add their 1-based position within the key.

    ``single`` names a flag column for rows that are alone under their key.
    """
    local = F.row_number().over(cut.window()).cast("bigint")
    out = cut.spread(df).withColumn(name, local)
    if single:
        alone = F.count(F.lit(1)).over(Window.partitionBy(*cut.columns)) == 1
        out = out.withColumn(single, alone)
    if cut.bounds is None:
        return out
    # rows in earlier slices, hot keys only, counted before they are shuffled: one
    # row per slice
    hot = df.select(*dict.fromkeys([*cut.keys, *cut.order])).join(
        F.broadcast(cut.bounds.select(*cut.keys)), [*cut.keys], "left_semi"
    )
    earlier = Window.partitionBy(*cut.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.place(hot)
        .groupBy(*cut.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*cut.columns, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    out = out.join(F.broadcast(offsets), cut.columns, "left")
    if single:
        # a hot key never has a lone row, even where one of its slices does
        out = out.withColumn(single, F.col(single) & F.col("_before").isNull())
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def number_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    how: Splitting | None = Splitting(),
) -> DataFrame:
    """Add the 1-based position within ``keys`` by ``order`` (row_number semantics)."""
    cut = slicing(df, keys, order, how)
    return number_slices(df, cut, name).drop(SLICE)


def fold_slices(
    df: DataFrame, cut: Slicing, weight: Column, limit: int, **folds: Column
) -> DataFrame:
    """Aggregate rows spread by ``cut`` into parts of ``limit`` plus at most one row's weight.

    Gives the keys, ``part_no`` from 1 without gaps, ``part_count`` and ``folds``.
    Without hot keys, window and aggregate use the partitioning the rows already
    have. With hot keys, the parts are the same: weights of earlier slices are
    added, and rows meet by key and part, since a part may span two slices.
    """
    before = cut.window().rowsBetween(Window.unboundedPreceding, -1)
    weighed = df.withColumn("_weight", weight.cast("bigint"))
    total = F.coalesce(F.sum("_weight").over(before), F.lit(0))
    if cut.bounds is not None:
        earlier = _weights_before(weighed, cut)
        weighed = weighed.join(F.broadcast(earlier), cut.columns, "left")
        total += F.coalesce("_earlier", F.lit(0))
    parted = weighed.withColumn("_sum", total).withColumn("_part", F.expr(f"_sum div {limit}"))
    parts = parted.groupBy(*cut.keys, "_part").agg(*[c.alias(n) for n, c in folds.items()])
    if cut.bounds is None:
        return _numbered(parts, cut.keys).select(*cut.keys, "part_no", "part_count", *folds)
    # numbers of parts are counted without their texts
    numbers = _numbered(parted.select(*cut.keys, "_part").distinct(), cut.keys)
    named = numbers.select(F.struct(*cut.keys, "_part").alias("_at"), "part_no", "part_count")
    return parts.join(named, F.struct(*cut.keys, "_part").eqNullSafe(F.col("_at"))).select(
        *cut.keys, "part_no", "part_count", *folds
    )


def _numbered(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row that outweighs the limit leaves out values of ``_part``; numbers have no gaps."""
    by = Window.partitionBy(*keys)
    return parts.withColumn("part_no", F.row_number().over(by.orderBy("_part")).cast("bigint")).withColumn(
        "part_count", F.count(F.lit(1)).over(by)
    )


def _weights_before(weighed: DataFrame, cut: Slicing) -> DataFrame:
    """The weight of a hot key's earlier slices: one row per slice but the first."""
    hot = weighed.join(F.broadcast(cut.bounds.select(*cut.keys)), [*cut.keys], "left_semi")
    earlier = Window.partitionBy(*cut.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hot.groupBy(*cut.columns)
        .agg(F.sum("_weight").alias("_n"))
        .withColumn("_earlier", F.sum("_n").over(earlier))
        .where("_earlier IS NOT NULL")
        .drop("_n")
    )


def text_in_order(text: str, order: Sequence[str]) -> Column:
    """Aggregate: the texts one after another, by ``order``."""
    return F.expr(f"coalesce(listagg({text}, '') WITHIN GROUP (ORDER BY {_one(order)}), '')")


def list_in_order(value: str, order: Sequence[str]) -> Column:
    """Aggregate: the values as an array, by ``order``."""
    pairs = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("at"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def _one(order: Sequence[str]) -> str:
    # listagg takes one order value; several become a struct
    return order[0] if len(order) == 1 else f"struct({', '.join(order)})"


def join_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    separator: str | Column,
    name: str,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
    counted: DataFrame | None = None,
    weight: Column | None = None,
    counted_weight: Column | None = None,
) -> DataFrame:
    """Join texts per key in order into ``name``, one row per part of bounded size.

    ``separator`` stands before every row but the key's first. ``counted`` is a
    table to look for hot keys in, where one is cheaper to read than ``df``, and weights are
    bytes of a row, as for ``slicing``.
    """
    cut = slicing(df, keys, order, how, counted, weight, counted_weight)
    lead = separator if isinstance(separator, Column) else F.lit(separator)
    led = (
        cut.spread(df.select(*dict.fromkeys([*keys, *order]), F.col(text).alias("_text"), lead.alias("_lead")))
        .withColumn("_first", cut.first_in_key())
        .withColumn("_led", F.concat(F.when(F.col("_first"), "").otherwise(F.col("_lead")), "_text"))
    )
    return fold_slices(
        led, cut, F.octet_length("_text"), part_bytes, **{name: text_in_order("_led", order)}
    )
