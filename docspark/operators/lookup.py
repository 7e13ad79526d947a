"""Joins to a table by key, whatever share of the rows a key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.ordering import Splitting, hot_keys


def lookup(
    df: DataFrame, table: DataFrame, keys: Sequence[str], how: Splitting | None = Splitting()
) -> DataFrame:
    """Left join ``df`` to ``table``, which has one row per key.

    Without hot keys, and for streams, this is a plain join. Rows of hot keys get
    their values from a broadcast of those keys alone, fewer than ``slices`` rows,
    and are spread over all tasks of the join that serves the other rows. So are
    rows with a NULL among their keys, which match nothing. The spread is a hash of
    the row's own columns: a task that runs again sends its rows the same way.
    """
    keys = list(keys)
    whole = F.lit(True)
    for key in keys:
        whole &= F.col(key).isNotNull()
    found = None if how is None or df.isStreaming else hot_keys(df.where(whole), keys, how)
    if found is None and (how is None or df.isStreaming):
        return df.join(table, keys, "left")
    values = [c for c in table.columns if c not in keys]
    places = 1 + F.pmod(F.xxhash64(*_hashable(df)), F.lit(1 << 20))
    marked = df
    if found is None:
        marked = marked.withColumns({"_hot": F.lit(None), "_is_hot": F.lit(None).cast("boolean")})
    else:
        packed = table.select(*keys, F.struct(*values).alias("_hot"))
        hot = found.table.select(*keys)
        known = packed.join(F.broadcast(hot), keys)
        served = hot.join(F.broadcast(known), keys, "left").withColumn("_is_hot", F.lit(True))
        marked = marked.join(F.broadcast(served), keys, "left")
    # what the spread is does not matter, as long as no row of the table has it
    spread = F.when(F.coalesce("_is_hot", F.lit(False)) | ~whole, places).otherwise(F.lit(0))
    marked = marked.withColumn("_spread", spread.cast("bigint"))
    # always 0, but no constant: Spark would take a constant out of the join's keys
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("bigint")
    cold = table.select(*keys, zero.alias("_spread"), F.struct(*values).alias("_cold"))
    value = F.col("_cold") if found is None else F.coalesce("_hot", "_cold")
    return marked.join(cold, [*keys, "_spread"], "left").select(
        *df.columns, *[value[c].alias(c) for c in values]
    )


def expand(
    df: DataFrame, table: DataFrame, keys: Sequence[str], how: Splitting | None = Splitting()
) -> DataFrame:
    """Inner join of ``df`` to all rows of ``table`` with its key, such as a document's parts.

    A key that holds more than its fair share of ``df`` is cut to slices of a fair share by a
    hash of the row, and its rows in ``table`` are repeated for each slice: so many times
    as rows of ``df`` make a fair share, over all keys ``2 * slices`` times at most. One task
    joins one slice. The hot keys, fewer than ``slices``, are broadcast.
    """
    keys = list(keys)
    found = None if how is None or df.isStreaming else hot_keys(df, keys, how)
    if found is None:
        return df.join(table, keys)
    sliced = found.table.select(*keys, F.ceil(F.col("_n") / found.fair_rows).cast("int").alias("_slices"))
    n = F.coalesce("_slices", F.lit(1))
    own = F.pmod(F.xxhash64(*_hashable(df)), n).cast("int").alias("_slice")
    spread = df.join(F.broadcast(sliced), keys, "left").select(*df.columns, own)
    each = F.explode(F.sequence(F.lit(0), n - 1)).alias("_slice")
    repeated = table.join(F.broadcast(sliced), keys, "left").select(*table.columns, each)
    # by key and slice: partitioning by key alone would satisfy the join as well
    spread, repeated = (side.repartition(*keys, "_slice") for side in (spread, repeated))
    return spread.join(repeated, [*keys, "_slice"]).drop("_slice")


def _hashable(df: DataFrame) -> list[str]:
    """Columns that have a hash: all but maps and variants."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
