"""Helpers that several operators share: words, written tables, schemas, components."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Callable

import docspark
import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import write_and_read

# bytes.lower() would do the same; the table says plainly that only A-Z change
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text; bytes.split() splits at just these."""
    raw = text_bytes(text)
    return (raw.translate(LOWER_ASCII) if lower else raw).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every input bit."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Growing:
    """A numpy array that takes more values at little cost each."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1024, kind), 0

    def extend(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            self.room = np.concatenate((self.room, np.zeros(end, self.room.dtype)))
        self.room[self.n : end] = values
        self.n = end


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, from the words' own hashes."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * MIX + word_hashes[j : j + n]
    return mixed(total)


_shipped: set[str] = set()


def ship() -> None:
    """Send this package to the executors, once per application, as --py-files would."""
    context = SparkContext.getOrCreate()
    if context.applicationId not in _shipped:
        root = pathlib.Path(docspark.__file__).parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="docspark-"), "docspark-package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def mapped(df: DataFrame, batches: Callable, schema: str | T.StructType, arrow: bool = False):
    """mapInPandas or mapInArrow with this package at hand on the executors."""
    ship()
    return (df.mapInArrow if arrow else df.mapInPandas)(batches, schema)


def per_text(values: Callable[[str | None], object], kind: str) -> Callable[[Column], Column]:
    """A vectorised column function that maps each whole text to a value."""
    ship()

    @F.pandas_udf(kind)
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([values(x) for x in texts.astype(object).where(texts.notna(), None)])

    return column


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table in the shared folder, so that lost executors redo nothing."""
    return write_and_read(df, f"llm-{purpose}")


def id_bitmap(ids: DataFrame, bits: int = 25):
    """A broadcast filter of the long ids of one column: 2**bits bits for any number of ids.

    Bit ``mixed(id) >> (64 - bits)`` is set for each id, so the filter lets others
    pass, the more the fuller it is, and never holds one back.
    """

    def words(batches):
        for batch in batches:
            at = np.unique(mixed(batch.iloc[:, 0].to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - bits))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            own = np.uint64(1) << (at & np.uint64(63))
            filled = np.bitwise_or.reduceat(own, start) if len(own) else own
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": filled.view(np.int64)})

    found = mapped(ids, words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = found.toPandas()
    filled = np.zeros((1 << bits) // 64, "<i8")
    filled[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(filled.tobytes()), bits


def components(links: DataFrame, purpose: str) -> DataFrame:
    """Connected components of undirected links ``(a, b)`` of long node ids.

    Returns ``(node, component)`` for each node that has a link, the component
    being its smallest node. Alternates large-star and small-star steps: every
    step joins links to one smallest neighbour per node (a map-side combined
    aggregate), so no node's neighbours are ever gathered, and the number of
    links never grows. Each round is written to the shared folder.
    """

    def with_smallest(edges: DataFrame) -> DataFrame:
        # under another name, Spark shuffles these few rows once more for the join, and
        # so may split the rows of a node with a large share of all links
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("w"), "m")
        return edges.join(least, F.col("u") == F.col("w"))

    def both(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select("v", "u"))

    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = written(edges.distinct(), purpose)
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found[0] == 0 or found == state:
            break
        state = found
        every = both(edges)
        # large star: neighbours above u go to the smallest of u and all its neighbours
        large = (
            with_smallest(every)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        # small star: u and its neighbours below u go to the smallest of these
        small = with_smallest(large).select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = written(small.select("e.*").where("u <> v").distinct(), purpose)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

