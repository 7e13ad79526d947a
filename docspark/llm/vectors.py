"""Embedding near-dedup by products of int8 tiles with rigorous error bounds.

A unit vector v is held as int8 codes q and a scale s, with the exact length e of what
is lost, v - s*q. The product of two tiles of codes is a product of small integers,
exact in floating point, and the cosine of a pair lies within e_a * (1 + e_b) + e_b of
it. Pairs surely below the threshold go, pairs surely above it are links, and only
those between are computed again in double precision.

Which tiles meet: all, so no link is left out. Vectors are cut into blocks that meet two
by two, each two in a task of their own with bounded memory; the pairs are as many as the
square of the vectors. A dense region needs no products inside: vectors within half the
threshold's angle of one pivot are linked to each other for certain, and only their number
counts. Where a caller allows a ``miss`` above 0, only vectors meet that share a bucket: the
signs of products with fixed random directions, some bits a table, in as many tables as
leave a pair at the threshold unmet with that chance at most. A pair is looked at in the
first table where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import components, mapped, written

LEAST_COSINE = 0.95
MISS = 0.0  # chance that a pair at the threshold is not looked at; 0 looks at all pairs
TILE = 4096  # rows of a block, where all are not so many that blocks have to grow
BUCKET = 1024  # rows a bucket has about, if directions split evenly
SAMPLE = 2000  # vectors among which dense regions are looked for
DENSE = 20  # of these within a region
_STEP = 2048  # rows of a product in memory
_SIDES = 16  # blocks that all rows make before there are more of them, as each row goes to as many tiles
_MOST = 65_536  # rows of a block at most
_SPLIT = 65_536  # buckets above this share of all rows may be cut to blocks
_SLACK = 1e-9  # above the rounding of any sum here
_COARSE = 1e-4  # above the rounding of a comparison in single precision

_ENCODED = "rep long, weight long, ball int, bucket int, place long, codes binary, scale double, lost double"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever their magnitude."""
    rows = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and lengths of what the codes lose."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    rest = units - scale[:, None] * codes
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + _SLACK


def directions(dim: int, number: int) -> np.ndarray:
    """Fixed random directions, of small whole numbers so that products with codes are exact."""
    draw = np.random.Generator(np.random.PCG64([dim, 20_230_517]))
    return np.rint(draw.standard_normal((number, dim)) * 64).astype(np.float64)


def table_plan(rows: int, least: float, miss: float, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a table and number of tables for so many distinct vectors."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / bucket)))
    if bits == 0 or miss <= 0:
        return 0, 1
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def bucket_keys(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table, from its codes alone."""
    if bits == 0:
        return np.zeros((len(codes), tables), np.int64)
    signs = codes.astype(np.float64) @ directions(codes.shape[1], bits * tables).T > 0
    return signs.reshape(len(codes), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows as exact whole numbers: single precision holds them up to 2**24."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def _pivots(spark, reps: DataFrame, least: float) -> list[list[np.ndarray]]:
    """Centres of dense regions among a bounded sample; they save work and change no result."""
    rows = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").collect()
    found = []
    for dim in sorted({len(r.embedding) for r in rows}):
        units = unit_rows(np.array([r.embedding for r in rows if len(r.embedding) == dim], np.float64))
        near = units @ units.T >= math.sqrt((1 + least) / 2) + _SLACK
        free = np.ones(len(units), bool)
        while True:
            count = (near & free).sum(axis=1)
            best = int(count.argmax())
            if count[best] < DENSE:
                break
            found.append(units[best])
            free &= ~near[best]
    return found


def _encoder(pivots, bits: int, tables: int, least: float):
    """Rows of every table: home bucket and place, codes and bounds. Balls count from 1."""
    half = math.sqrt((1 + least) / 2) + _SLACK  # the cosine of half the threshold's angle

    def batches(frames):
        for frame in frames:
            weight = frame["weight"].to_numpy(np.int64)
            reps = frame["rep"].to_numpy(np.int64)
            dims = frame["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for at in np.split(at, range(8192, len(at), 8192)):
                    units = unit_rows(np.stack(frame["embedding"].iloc[at].to_list()).astype(np.float64))
                    codes, scale, lost = quantised(units)
                    ball = np.zeros(len(at), np.int32)
                    for nth, pivot in reversed(list(enumerate(pivots.value, 1))):
                        if len(pivot) == dim:
                            ball[units @ pivot >= half] = nth
                    keys = bucket_keys(codes, bits, tables)
                    data = [c.tobytes() for c in codes]
                    for table in range(tables):
                        yield pd.DataFrame(
                            {
                                "rep": reps[at],
                                "weight": weight[at],
                                "ball": ball,
                                "bucket": np.full(len(at), table, np.int32),
                                # vectors of other lengths are in other places
                                "place": int(dim) << 40 | keys[:, table],
                                "codes": data,
                                "scale": scale,
                                "lost": lost,
                            }
                        )

    return batches


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked to, directly or by others."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _tile_links(bits: int, tables: int, least: float):
    """Links found in one tile, as counts and one edge a row; pairs only where the bound leaves them open.

    What is held beside the rows of the tile and their codes is one product of ``_STEP`` by ``_STEP``.
    """

    def links(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        column = {name: table[name].to_numpy() for name in ("rep", "weight", "ball", "side", "scale", "lost")}
        order = np.lexsort((column["rep"], column["side"]))
        rep, weight, ball, side, scale, lost = (c[order] for c in column.values())
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(len(order), -1)[order]
        own = key[0].as_py()
        keys = bucket_keys(codes, bits, own + 1) if own else None
        n = len(rep)
        count, label = np.zeros(n, np.int64), np.arange(n)

        def batch(a, b, counts):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), counts], ["a", "b", "n"])

        ends = np.cumsum(np.bincount(side, minlength=3))  # of rows that all meet, of one block, of the other
        corners = [(lo, to, ends[0], ends[0]) for lo in range(0, ends[0], _STEP) for to in range(lo, ends[0], _STEP)]
        corners += [
            (lo, to, ends[1], ends[2]) for lo in range(ends[0], ends[1], _STEP) for to in range(ends[1], ends[2], _STEP)
        ]
        for lo, to, lo_end, to_end in corners:
            x, y = slice(lo, min(lo + _STEP, lo_end)), slice(to, min(to + _STEP, to_end))
            product = tile_products(codes[x], codes[y])
            worst = lost[x].max() * (1 + lost[y].max()) + lost[y].max()
            floor = (least - worst - _COARSE) / scale[y]
            near = product * scale[x, None].astype(product.dtype) >= floor.astype(product.dtype)
            i, j = np.nonzero(near)
            products = product[i, j]
            i, j = i + lo, j + to
            cosine = products * (scale[i] * scale[j])
            reach = lost[i] * (1 + lost[j]) + lost[j]
            # those of one ball are linked without a product
            wanted = (cosine + reach >= least) & (i < j) & ((ball[i] == 0) | (ball[i] != ball[j]))
            if own:
                wanted &= ~(keys[i, :own] == keys[j, :own]).any(axis=1)
            known = cosine[wanted] - reach[wanted] >= least + _SLACK
            i, j = i[wanted], j[wanted]
            if not known.all():
                a, b = rep[i[~known]], rep[j[~known]]
                yield batch(a, b, pa.nulls(len(a), pa.int64()))
            i, j = i[known], j[known]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            a, b = label[i], label[j]
            apart = a != b
            if apart.any():
                label = _labels(n, a[apart], b[apart])[label]
        some = np.flatnonzero(count)
        yield batch(rep[some], rep[label[some]], pa.array(count[some]))

    return links


def _tiles(encoded: DataFrame, rows: int, tile: int) -> DataFrame:
    """Rows with the tile they go to: a bucket, or two blocks of a bucket too large for one.

    ``side`` is 0 where all of a tile meet, else the block that does not meet itself. Each row
    goes to as many tiles as its bucket has blocks: some ``_SIDES`` until blocks have ``_MOST`` rows.
    """
    place = ["bucket", "place"]
    sizes = encoded.groupBy(*place, "ball").agg(F.count(F.lit(1)).alias("size"))
    most = max(tile, min(_MOST, -(-rows // _SIDES)))
    # fewer than _SPLIT buckets of a table exceed this share, however many rows there are
    limit = max(most, -(-rows // _SPLIT))
    large = sizes.groupBy(*place).agg(F.sum("size").alias("whole")).where(F.col("whole") > limit)
    # a ball of more rows than a block has blocks of its own, of which no two have to meet
    alone = F.when((F.col("ball") > 0) & (F.col("size") > most), F.col("ball")).otherwise(0)
    balls = sizes.join(large, place).select(*place, "ball", "size", alone.alias("own"))
    groups = balls.groupBy(*place, "own").agg(F.ceil(F.sum("size") / most).alias("blocks"))
    before = Window.partitionBy(*place).orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        *place, "own", "blocks",
        F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"),
        F.sum("blocks").over(Window.partitionBy(*place)).alias("all"),
    )
    blocks = written(balls.join(groups, [*place, "own"]).drop("size"), "vector-blocks")
    placed = encoded.join(F.broadcast(blocks), [*place, "ball"], "left")
    names = [*encoded.columns, "tile", "side"]
    whole = placed.where("blocks is null").withColumn("tile", F.lit("")).withColumn("side", F.lit(0))
    cut = placed.where("blocks is not null").withColumn("g", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    others = F.filter(
        F.sequence(F.lit(0).cast("long"), F.col("all") - 1),
        lambda h: (F.col("own") == 0) | (h < F.col("first")) | (h >= F.col("first") + F.col("blocks")),
    )
    g, h = F.col("g"), F.col("h")
    spread = (
        cut.withColumn("h", F.explode(others))
        .withColumn("tile", F.concat_ws("/", F.least(g, h), F.greatest(g, h)))
        .withColumn("side", F.when(g == h, 0).when(g < h, 1).otherwise(2))
    )
    return whole.select(names).unionByName(spread.select(names))


def _dot(a: str, b: str):
    a, b = (F.transform(x, lambda y: y.cast("double")) for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_duplicates(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    miss: float = MISS,
    tile: int = TILE,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors`` (vec_id, embedding).

    Rows whose vectors have a cosine of ``least`` or more, in double precision, are
    linked. ``n_links`` counts the other rows linked directly, copies among them,
    ``component_id`` is the smallest id reachable and ``kept`` says that it is the
    row's own. Links are never false, and none is missed: all tiles are compared. With a
    ``miss`` above 0, a link between vectors exactly at ``least`` is missed with that chance,
    a closer one with less.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of unequal lengths. Rows that repeat an id count each. A row with
    a null id takes part; its ``kept`` is false and its component_id that of the rows
    it is linked to, null without any. An empty table gives an empty result; other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # copies are one vector from here on
    reps = (
        rows.where(usable)
        .groupBy("embedding")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
        .withColumn("rep", F.monotonically_increasing_id())  # kept by writing
    )
    reps = written(reps, "vector-copies")
    n_reps = reps.count()
    bits, tables = table_plan(n_reps, least, miss, bucket)
    pivots = spark.sparkContext.broadcast(_pivots(spark, reps, least))
    encoded = written(mapped(reps.select("rep", "weight", "embedding"), _encoder(pivots, bits, tables, least), _ENCODED), "vector-codes")
    tiles = _tiles(encoded, n_reps, tile)
    found = tiles.groupBy("bucket", "place", "tile").applyInArrow(
        _tile_links(bits, tables, least), "a long, b long, n long"
    )
    found = written(found, "vector-links")
    by_rep = reps.select("rep", "weight", "embedding")
    one = by_rep.select(F.col("rep").alias("a"), F.col("weight").alias("wa"), F.col("embedding").alias("ea"))
    two = by_rep.select(F.col("rep").alias("b"), F.col("weight").alias("wb"), F.col("embedding").alias("eb"))
    cosine = _dot("ea", "eb") / (F.sqrt(_dot("ea", "ea")) * F.sqrt(_dot("eb", "eb")))
    settled = (
        found.where("n is null").drop("n").join(one, "a").join(two, "b")
        .where(cosine >= least)
        .select("a", "b", "wa", "wb")
    )
    settled = written(settled, "vector-settled")
    counts = (
        found.where("n is not null").select(F.col("a").alias("rep"), "n")
        .unionByName(settled.select(F.col("a").alias("rep"), F.col("wb").alias("n")))
        .unionByName(settled.select(F.col("b").alias("rep"), F.col("wa").alias("n")))
        .groupBy("rep").agg(F.sum("n").alias("n"))
    )
    members = encoded.where("bucket = 0 and ball > 0").select("rep", "weight", "ball")
    balls = members.groupBy("ball").agg(F.sum("weight").alias("inside"), F.min("rep").alias("b"))  # a row per pivot
    balls = written(members.join(F.broadcast(balls), "ball").select("rep", "b", "inside"), "vector-balls")
    edges = (
        found.where("n is not null and a <> b").select("a", "b")
        .unionByName(settled.select("a", "b"))
        .unionByName(balls.select(F.col("rep").alias("a"), "b"))
    )
    groups = components(written(edges, "vector-edges"), "vectors")
    named = (
        reps.join(groups, reps.rep == groups.node, "left")
        .select(reps.rep, "embedding", "weight", "first", F.coalesce("component", "rep").alias("component"))
        .join(counts, "rep", "left")
        .join(balls.select("rep", "inside"), "rep", "left")
    )
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce("inside", "weight") - 1
    smallest = written(
        named.groupBy("component").agg(F.min("first").alias("component_id")), "vector-smallest"
    )
    labels = named.join(smallest, "component").select("embedding", n_links.alias("n_links"), "component_id")
    labelled = rows.where(usable).join(written(labels, "vector-labels"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return labelled.unionByName(alone).withColumn("kept", kept)


SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = named.vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM named
"""
