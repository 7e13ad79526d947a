"""Requests handled as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.functions.paths import file_category
from docspark.operators.requests import triage
from docspark.session import write_and_read

REQUEST_SCHEMA = (
    "request_id bigint, tool string, file_path string, output_dir string, dpi double, "
    "sheet_names array<string>, keep_pdf boolean, format string, output_mode string, "
    "merge_pages boolean, preserve_page_headings boolean"
)


def batch_triage(files: DataFrame, out_dir: str) -> Callable[[DataFrame, int], None]:
    """What happens to a micro-batch: judged as a batch, written to a folder of its own.

    The folder is named by the query's id, which a checkpoint keeps, and the batch's number.
    A batch that runs again after a failure replaces what it wrote before, so no row
    comes twice.
    """
    known = write_and_read(files.select("path").distinct(), "known-paths")

    def handle(requests: DataFrame, number: int) -> None:
        run = requests.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        judged = triage(requests, known).withColumn("category", file_category(F.col("file_path")))
        judged.write.mode("overwrite").parquet(f"{out_dir}/run={run}/batch={number}")

    return handle


def stream_triage(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    files: DataFrame,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Triage request files as they arrive in ``in_dir`` and append the outcome to ``out_dir``.

    Each request is judged on its own against the paths of ``files``, which are written
    once when the query starts. Every micro-batch is a batch job of its own, so files that
    a large share of its requests ask for are no hot keys. The query handles what is there and
    stops; run it again, or on a schedule, for what has arrived since. Rows gain ``category``
    (NULL for unknown file types) and ``error``, and by their folders ``run`` and ``batch``.
    """
    requests = (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(in_dir)
    )
    return (
        requests.writeStream.foreachBatch(batch_triage(files, out_dir))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
