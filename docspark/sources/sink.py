"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(
    df: DataFrame, out: str, key: str = "source_type", mode: str = "errorifexists"
) -> str:
    """Write results below ``out``, partitioned by ``key``, and return the folder.

    The folder is made on demand. One that exists already is an error by
    default, so results never mix with what an earlier run left there. Rows are
    written where they are: a key value with many rows gets many files.
    """
    df.write.mode(mode).partitionBy(key).parquet(out)
    return out
