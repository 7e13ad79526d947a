"""Files as rows: listings, contents, attachments, image checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docspark.functions.paths import file_basename, mime_type
from docspark.session import write_and_read

# Fixed value: the first four bytes of a PNG file.
PNG_SIGNATURE = bytes.fromhex("89504E47")
ATTACHMENT_TYPE = "blob"
FOLDERS = "docspark_folders"


def plain_path(path: Column) -> Column:
    """A local path without its ``file:`` scheme, as requests write it."""
    return F.regexp_replace(path, "^file:/+", "/")


def _folder_source() -> type[DataSource]:
    """A data source that lists folders, a partition for each.

    Made in a function so that executors get the classes themselves and need no copy
    of this package.
    """

    class Folder(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, folders):
            self.folders = folders

        def partitions(self):
            return [Folder(f) for f in self.folders]

        def read(self, partition):
            from datetime import timezone

            import pyarrow as pa
            from pyarrow import fs

            given = partition.value
            if "://" in given:
                system, root = fs.FileSystem.from_uri(given)
            else:
                system, root = fs.LocalFileSystem(), given
            scheme = given.partition("://")[0] + "://" if "://" in given else ""
            found = system.get_file_info(fs.FileSelector(root))
            known = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
            for at in range(0, len(known), 100_000):
                some = known[at : at + 100_000]
                folder = [f.type == fs.FileType.Directory for f in some]
                columns = [
                    pa.array([scheme + f.path for f in some], pa.string()),
                    pa.array([0 if d else f.size for f, d in zip(some, folder)], pa.int64()),
                    pa.array([f.mtime and f.mtime.astimezone(timezone.utc) for f in some], pa.timestamp("us", "UTC")),
                    pa.array(folder),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["path", "length", "modificationTime", "is_folder"]
                )

    class Folders(DataSource):
        @classmethod
        def name(cls):
            return "docspark_folders"

        def schema(self):
            return "path string, length bigint, modificationTime timestamp, is_folder boolean"

        def reader(self, schema):
            import json

            return Reader(json.loads(self.options["folders"]))

    return Folders


def list_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """What is directly in each folder, listed by executors: ``path, length, modificationTime, is_folder``."""
    import json

    spark.dataSource.register(_folder_source())
    return spark.read.format(FOLDERS).option("folders", json.dumps(folders)).load()


def _python_reads(root: str) -> bool:
    from pyarrow import fs

    try:
        return "://" not in root or bool(fs.FileSystem.from_uri(root))
    except Exception:  # no such scheme, or no library for it
        return False


def list_files(
    spark: SparkSession, root: str, suffix: str | None = None, recursive: bool = False
) -> DataFrame:
    """Files below ``root`` as ``path, length, modificationTime``, empty ones too.

    Executors list folders, one partition for each, and ``recursive`` goes on with the
    folders of a level until there are none; the driver holds a level's folders, never
    files. Names that begin with ``_`` or ``.`` are left out when going down, as Spark
    does with the files of its writers. A store that only Spark reads is listed by
    Spark, which leaves empty files out.
    """
    root = re.sub("^file:/+", "/", root)  # as a path, whose characters stand for themselves
    if not _python_reads(root):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        found = reader.load(root).select("path", "length", "modificationTime")
        return found.filter(F.endswith("path", F.lit(suffix))) if suffix else found
    level, found = [root.rstrip("/") or "/"], None
    while level:
        listed = list_folders(spark, level)
        if recursive:
            name = F.regexp_extract("path", "[^/]*$", 0)
            listed = write_and_read(listed.where(~F.substr(name, F.lit(1), F.lit(1)).isin("_", ".")), "listing")
        files = listed.where("not is_folder").drop("is_folder")
        found = files if found is None else found.unionByName(files)
        level = [r.path for r in listed.where("is_folder").select("path").collect()] if recursive else []
    return found.filter(F.endswith("path", F.lit(suffix))) if suffix else found


def scan_files(
    spark: SparkSession, root: str, suffix: str | None = None, content: bool = False, recursive: bool = True
) -> DataFrame:
    """Files below ``root`` whose name ends with a case-sensitive suffix.

    A listing (``content=False``) is sorted by path and reads no bytes. Rows with
    bytes keep the scan's order: sorting them would shuffle every file's content.
    Spark's scan gives the bytes of files that have some and are within
    ``spark.sql.sources.binaryFile.maxLength``; empty files, and larger ones with NULL
    content, come from the listing. Readers of archives open those by path.
    """
    listed = list_files(spark, root, suffix, recursive)
    if not content:
        return listed.select("path", "length", "modificationTime").orderBy("path")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        # prunes while listing; the filter below repeats it without glob rules
        escaped = "".join("\\" + ch if ch in r"*?[]{}\^" else ch for ch in suffix)
        reader = reader.option("pathGlobFilter", f"*{escaped}")
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    scanned = reader.load(root).withColumn("path", plain_path(F.col("path")))
    if suffix:
        scanned = scanned.filter(F.endswith("path", F.lit(suffix)))
    columns = ["path", "length", "content", "modificationTime"]
    empty = F.when(F.col("length") == 0, F.lit(b""))
    rest = listed.where((F.col("length") == 0) | (F.col("length") > limit)).withColumn("content", empty)
    # the length filter reaches the scan, which would fail at a larger file
    return scanned.where((F.col("length") > 0) & (F.col("length") <= limit)).select(columns).unionByName(
        rest.select(columns)
    )


def attachment_rows(files: DataFrame) -> DataFrame:
    """Base64 content, MIME type and display name of each file, one line per value."""
    return files.select(
        "path",
        F.lit(ATTACHMENT_TYPE).alias("type"),
        F.translate(F.base64("content"), "\r\n", "").alias("data"),
        mime_type(F.col("path")).alias("mime_type"),
        file_basename(F.col("path")).alias("display_name"),
    )


def valid_png(files: DataFrame) -> DataFrame:
    """Add ``is_png``: not empty and starting with the PNG signature."""
    starts = F.substring("content", 1, 4) == F.lit(PNG_SIGNATURE)
    return files.withColumn("is_png", (F.col("length") > 0) & starts)
