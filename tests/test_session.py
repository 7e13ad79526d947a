import os

from pyspark.sql import DataFrameWriter

from docspark.session import _CLEANUP, remove_work, work_folder, write_and_read


def test_work_tables_can_be_removed(spark):
    df = write_and_read(spark.range(5).toDF("n"), "removal")
    folder = work_folder(spark, "unused")
    assert df.count() == 5
    path = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(path) and not os.path.exists(folder)
    assert remove_work(spark) >= 2
    assert not os.path.exists(path) and remove_work(spark) == 0


def test_shuffle_files_go_once_their_table_is_written(spark, monkeypatch):
    """Spark is asked to remove them for this write; the session's own setting stays."""
    before, seen, plain = spark.conf.get(_CLEANUP, None), [], DataFrameWriter.parquet

    def parquet(self, *args):
        seen.append(spark.conf.get(_CLEANUP))
        plain(self, *args)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    table = write_and_read(spark.range(1000).repartition(5, "id").groupBy("id").count(), "shuffled")
    assert seen == ["true"] and table.count() == 1000 and spark.conf.get(_CLEANUP, None) == before
