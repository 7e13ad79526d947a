"""SimHash near-dedup by segment popcounts.

A fingerprint is embedded as 32 bit counts, one per 2-bit segment. The Manhattan
distance of two such count vectors never exceeds the Hamming distance of the
fingerprints. The vector is cut to slabs of neighbouring segments, and the grid
has a cell for each choice of all but ``max_bits`` slabs and their counts: two
vectors at most ``max_bits`` apart differ in no more than so many slabs, hence
share a cell. The same holds for the bits of these slabs, so the rows of a cell meet by
them: chance alone fills a cell 650 times as often as it makes the bits equal. Rows that
meet are range-joined under the Manhattan bound, then checked bit by bit. Counts are held in unary (0: 00, 1: 01, 2: 11), which makes
the Manhattan distance a popcount of an exclusive or.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import components, per_text, words_of, written

SHINGLE = 4
MAX_BITS = 4
SLABS = 8
SEED = 42
_ODD = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a whole text; 0 if it has no word."""
    import xxhash

    words = words_of(text, lower=True)
    n = len(words)
    if n == 0:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = [digest(whole[a:b], SEED) for a, b in spans]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for texts of any length
        block = np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _counts(fp: Column) -> Column:
    """The 32 segment popcounts in unary, two bits each."""
    odd, up = F.lit(_ODD), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(up).bitwiseAND(odd)
    full = fp.bitwiseAND(up).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(full, 1))


def _slab_masks(slabs: int) -> list[int]:
    edge = [2 * round(32 * i / slabs) for i in range(slabs + 1)]
    return [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(slabs)]


def linked(fingerprints: DataFrame, max_bits: int = MAX_BITS, slabs: int = SLABS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints at most ``max_bits`` apart.

    ``fingerprints`` has one row per distinct ``fp``. A pair is given once, by the
    cell of its lowest slabs with equal bits. Spark splits the cells of skewed joins.
    Cells are never broadcast: Spark takes them for one row a fingerprint, 70 times too few.
    """
    if not max_bits < slabs <= 32:
        raise ValueError("the number of slabs must be above max_bits and at most 32")
    masks = _slab_masks(slabs)
    choices = [
        (sum(1 << i for i in chosen), _signed(sum(masks[i] for i in chosen)))
        for chosen in combinations(range(slabs), slabs - max_bits)
    ]
    counts = _counts(F.col("fp"))
    table = F.array(
        *[F.struct(F.lit(bits).alias("slabs"), F.lit(mask).alias("mask")) for bits, mask in choices]
    )
    cells = (
        fingerprints.where("fp is not null")
        .select("fp", F.explode(table).alias("c"))
        .select(
            "fp",
            F.col("c.slabs").alias("slabs"),
            counts.bitwiseAND(F.col("c.mask")).alias("cell"),
            F.col("fp").bitwiseAND(F.col("c.mask")).alias("bits"),
        )
    )
    a, b = cells.alias("a"), cells.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    moved = _counts(fa).bitwiseXOR(_counts(fb))
    near = (fa < fb) & (F.bit_count(moved) <= max_bits) & (F.bit_count(fa.bitwiseXOR(fb)) <= max_bits)
    for i, mask in enumerate(masks):
        rest = F.shiftright(F.col("a.slabs"), i)
        near &= (rest == 0) | (rest % 2 == 1) | (fa.bitwiseXOR(fb).bitwiseAND(F.lit(_signed(mask))) != 0)
    same = F.lit(True)
    for name in ("slabs", "cell", "bits"):
        same &= F.col(f"a.{name}") == F.col(f"b.{name}")
    return a.join(b.hint("merge"), same & near).select(fa.alias("a"), fb.alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(id, fp long, component_id)`` of each row: the smallest id it is linked to.

    Copies of a text share one fingerprint, and only distinct fingerprints meet
    in the grid. Null and wordless texts have fingerprint 0, linked like any
    other. A row with a null id takes part in links; a component in which every
    id is null has a null component_id. Repeated rows stay repeated. An empty
    table gives an empty result. Other columns are not read.
    """
    fp = per_text(lambda x: fingerprint(x, shingle), "long")
    prints = written(docs.select(F.col(id_col).alias("id"), fp(text_col).alias("fp")), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    groups = components(written(linked(distinct.select("fp"), max_bits), "simhash-links"), "simhash")
    named = distinct.join(groups, distinct.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = written(
        named.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-smallest"
    )
    labels = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_per_group(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, one row each.

    Rows without a doc_id name no document and go. Of several rows of one id that with the
    smallest hash of its columns stays, maps and variants aside. An empty table gives an empty result.
    """
    found = near_duplicates(docs, **parameters)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    plain = [c for c, kind in docs.dtypes if c in rest and "map<" not in kind and "variant" not in kind]
    one = F.min_by(F.struct(*rest), F.xxhash64(*plain)).alias("_row")
    whole = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(one)
    return whole.select(*["doc_id" if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns])
