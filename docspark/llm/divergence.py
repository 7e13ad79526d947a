"""Source divergence audit by in-mapper stripes.

A partition folds its documents into hash stripes, term to document frequency and
counts by source. Full tables of stripes are spilled as rows and merged by key. The
merged stripes give every divergence: for two sources, terms that both hold are
summed in the task that has their stripes, terms of one alone by how often each count
occurs, and terms of neither by their number. So no row is made for a term that a
source lacks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import mapped, written

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
# A-Z in small letters, letters and all bytes above ASCII as they are, the rest is space
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_STRIPES = 300_000  # terms a task holds before it spills
_PAIRS = 1 << 20  # pairs of counts that are compared at once
_SUMS = 1 << 20  # sums a task holds before it spills

_STRIPE_ROW = "lang string, term string, sources array<string>, counts array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_TERM_BYTES).split()


def _stripe_rows(stripes: dict) -> pa.RecordBatch:
    keys = list(stripes)
    arrays = [
        pa.array([k[0] for k in keys], pa.string()),
        pa.array([k[1].decode("utf-8", "replace") for k in keys], pa.string()),
        pa.array([list(stripes[k]) for k in keys], pa.list_(pa.string())),
        pa.array([list(stripes[k].values()) for k in keys], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "sources", "counts"])


def _folded(frames):
    """Stripes of a partition; the entry without a source is the document frequency."""
    from collections import Counter

    stripes: dict[tuple[str, bytes], dict[str | None, int]] = {}
    for frame in frames:
        langs, sources = frame.column(0).to_pylist(), frame.column(1).to_pylist()
        texts = frame.column(2).cast(pa.binary())
        for i, (lang, source) in enumerate(zip(langs, sources)):
            for term, n in Counter(terms_of(texts[i].as_py())).items():
                key = lang, term
                stripe = stripes.get(key)
                if stripe is None:
                    stripes[key] = {None: 1, source: n}
                else:
                    stripe[None] += 1
                    stripe[source] = stripe.get(source, 0) + n
            if len(stripes) >= _STRIPES:
                yield _stripe_rows(stripes)
                stripes = {}
    if stripes:
        yield _stripe_rows(stripes)


def _share(count: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    """``1 + floor(scale * (count + 1) / (total + terms))``, exact for counts of any size."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(11,0)")
    below = F.greatest(total + terms, F.lit(1)).cast("decimal(19,0)")
    return F.call_function("div", wide, below) + 1


def _surprise(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(frames):
    """For stripes of ``(group, p, p0)``, what terms that both of two groups hold add to their sum.

    That is ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``: the rest is added by counts.
    """
    sums: dict[tuple[int, int], int] = {}

    def add(first, second, values):
        order = np.lexsort((second, first))
        first, second, values = first[order], second[order], values[order]
        new = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(np.concatenate(([True], new)))
        added = np.add.reduceat(values, starts).tolist()
        for a, b, v in zip(first[starts].tolist(), second[starts].tolist(), added):
            sums[a, b] = sums.get((a, b), 0) + v

    def rows():
        a, b = zip(*sums)
        arrays = [pa.array(c, pa.int64()) for c in (a, b, list(sums.values()))]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "value"])

    for frame in frames:
        entries = frame.column(0)
        flat = entries.flatten()
        group, p, p0 = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        size = np.diff(entries.offsets.to_numpy())
        width = np.repeat(size, size)  # entries of the stripe that an entry stands in
        begin = np.repeat(np.cumsum(size) - size, size)
        ends = np.cumsum(width)
        cuts = np.searchsorted(ends, np.arange(_PAIRS, ends[-1] if len(ends) else 0, _PAIRS), "right")
        for part in np.split(np.arange(len(group)), np.unique(cuts)):
            if not len(part):
                continue
            n = width[part]
            i = np.repeat(part, n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[part], n)
            other = i != j
            i, j = i[other], j[other]
            if not len(i):
                continue
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            add(group[i], group[j], value)
            if len(sums) >= _SUMS:
                yield rows()
    if sums:
        yield rows()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how sources of a language differ.

    Terms are runs of letters and characters above ASCII, A-Z in small letters, and a
    language keeps those in ``least_docs`` of its documents. A group's share of a term
    is ``p = 1 + floor(1e9 * (count + 1) / (N + V))`` with its N kept occurrences and
    the language's V kept terms. Part ``pair`` sums ``floor((p - q)**2 / q)`` over all
    kept terms for each other source of the language, 0 if there are no terms; part
    ``term`` has the ``top_terms`` kept terms that the group holds more often than
    its language does.

    Null texts, languages and sources are empty strings; every group that occurs has
    its pairs, also without terms. Repeated rows count each, texts of any length are
    read whole, ties go by the item's bytes, an empty table gives an empty result.
    Other columns are not read.
    """
    named = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    stripes = mapped(named, _folded, _STRIPE_ROW, arrow=True)
    entry = F.explode(F.arrays_zip("sources", "counts"))
    # partitioned by term, which serves both aggregates
    flat = (
        stripes.repartition("lang", "term")
        .select("lang", "term", entry.alias("e"))
        .groupBy("lang", "term", F.col("e.sources").alias("source"))
        .agg(F.sum("e.counts").alias("n"))
    )
    in_source = F.col("source").isNotNull()
    kept = (
        flat.groupBy("lang", "term")
        .agg(
            F.sum(F.when(~in_source, F.col("n"))).alias("df"),
            F.sum(F.when(in_source, F.col("n"))).alias("total"),
            F.collect_list(F.when(in_source, F.struct("source", "n"))).alias("stripe"),
        )
        .where(F.col("df") >= least_docs)
        .drop("df")
    )
    kept = written(kept, "divergence-stripes")
    counts = kept.select("lang", "term", "total", F.explode("stripe").alias("e")).select(
        "lang", "term", "total", F.col("e.source").alias("source"), F.col("e.n").alias("n")
    )
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all_n"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = (
        named.select("lang", "source").distinct()
        .join(langs, "lang", "left")
        .join(sizes, ["lang", "source"], "left")
        .na.fill(0, ["terms", "all_n", "group_n"])
        .withColumn("p0", _share(F.lit(0).cast("long"), F.col("group_n"), F.col("terms")))
        .withColumn("id", F.monotonically_increasing_id())  # kept by writing
    )
    groups = written(groups, "divergence-groups")
    known = counts.join(groups, ["lang", "source"]).withColumn(
        "p", _share(F.col("n"), F.col("group_n"), F.col("terms"))
    )
    return _pairs(known, groups).unionByName(_terms(known, top_terms))


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    striped = known.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0")).alias("stripe"))
    both = mapped(
        striped.where("size(stripe) > 1").select("stripe"), _shared_terms, "a long, b long, value long", arrow=True
    )
    one = groups.select("lang", F.col("id").alias("a"), F.col("p0").alias("a0"), F.col("terms").alias("v"))
    other = groups.select("lang", F.col("id").alias("b"), F.col("p0").alias("b0"))
    neither = one.join(other, "lang").where("a <> b").select(
        "a", "b", (F.col("v") * _surprise(F.col("a0"), F.col("b0"))).alias("value")
    )
    # how many terms have a count: few numbers beside all terms
    seen = known.groupBy("lang", "id", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    p, p0, a0, b0 = F.col("p"), F.col("p0"), F.col("a0"), F.col("b0")
    by_first = seen.join(other, "lang").where("id <> b").select(
        F.col("id").alias("a"), "b", (F.col("k") * (_surprise(p, b0) - _surprise(p0, b0))).alias("value")
    )
    by_second = seen.join(one, "lang").where("id <> a").select(
        "a", F.col("id").alias("b"), (F.col("k") * (_surprise(a0, p) - _surprise(a0, p0))).alias("value")
    )
    parts = neither.unionByName(by_first).unionByName(by_second).unionByName(both)
    value = F.sum(F.col("value").cast("decimal(20,0)")).cast("long")
    first = groups.select(F.col("id").alias("a"), "lang", "source")
    second = groups.select(F.col("id").alias("b"), F.col("source").alias("item"))
    named = parts.groupBy("a", "b").agg(value.alias("value")).join(first, "a").join(second, "b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(known: DataFrame, top_terms: int) -> DataFrame:
    q = _share(F.col("total"), F.col("all_n"), F.col("terms"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (
        known.withColumn("q", q)
        .where("p > q")
        .select("lang", "source", F.col("term").alias("item"), _surprise(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= top_terms)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )


SQL = f"""
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
grouped AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS group_n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.group_n, 0) + l.v) AS p,
         1 + {SCALE}::HUGEINT * (k.total + 1) // (l.lang_n + l.v) AS q
  FROM grouped g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value
  FROM grouped g JOIN grouped o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN shares b ON b.lang = o.lang AND b.source = o.source AND b.term = a.term
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
