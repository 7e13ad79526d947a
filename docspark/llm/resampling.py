"""Importance resampling towards a target by hashed word features.

Features are runs of words, hashed to buckets by CRC-32. Distinct features of a batch
are grouped by length into matrices of bytes, and the CRCs of a matrix advance
together, one column at a time. Bucket counts of the documents and of the target
give each bucket's gain, and a document's weight is the mean gain of its features.
Adding Gumbel noise and taking the highest draws without replacement by weight.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import mapped, written

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
SHARE = 10  # hundredths of the documents of LEAST_WORDS words or more
SEED = "2024"
# A-Z in small letters; digits, letters and all bytes above ASCII as they are, the rest is space
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_KNOWN = 400_000  # features a task remembers
_CHUNK = 1 << 22  # bytes of text whose features are hashed together
_WIDEST = 256  # columns of a matrix; what is longer goes on row by row


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_of(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each, by matrices of features of one length."""
    table = _crc_table()
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
        width = int(lengths[rows[0]])
        held = min(width, _WIDEST)
        matrix = np.frombuffer(b"".join(features[r][:held] for r in rows.tolist()), np.uint8)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.reshape(len(rows), held).T):
            crc = table[(crc ^ column) & 0xFF] ^ (crc >> 8)
        crc ^= np.uint32(0xFFFFFFFF)
        if width > held:
            crc = np.array([zlib.crc32(features[r][held:], int(c)) for r, c in zip(rows.tolist(), crc)], np.uint32)
        out[rows] = crc
    return out


def words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_WORD_BYTES).split()


def features(own: list[bytes], longest: int = LONGEST_RUN) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by one space."""
    runs = list(own)
    for size in range(2, longest + 1):
        runs += [b" ".join(own[i : i + size]) for i in range(len(own) - size + 1)]
    return runs


def _chunks(frames, longest: int):
    """Rows of a batch with their words and features, a bounded amount of text at a time."""
    for frame in frames:
        texts = frame.column(frame.num_columns - 1).cast(pa.binary())
        first, size, held = 0, 0, []
        for i in range(len(texts)):
            text = texts[i].as_py()
            own = words(text)
            held.append((len(own), features(own, longest)))
            size += len(text or b"")
            if size >= _CHUNK or i + 1 == len(texts):
                yield frame, first, held
                first, size, held = i + 1, 0, []


class Buckets(dict):
    """What a bucket stands for, by feature; as many are kept as a task may hold."""

    def __init__(self, buckets: int, values: list[int] | None = None):
        super().__init__()
        self.buckets, self.values_of = buckets, values

    def learn(self, seen: set[bytes]) -> None:
        new = list(seen.difference(self))
        if len(self) + len(new) > _KNOWN:
            self.clear()
            new = list(seen)
        at = (crc32_of(new) % np.uint32(self.buckets)).tolist()
        self.update(zip(new, at if self.values_of is None else map(self.values_of.__getitem__, at)))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How often features of each bucket occur in a table of one text column.

    A task sends one row for each bucket it has seen, the driver gets one for each bucket.
    """

    def count(frames):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for _, _, held in _chunks(frames, longest):
            known.learn(set().union(*(f for _, f in held)))
            for _, own in held:
                if own:
                    total += np.bincount(np.fromiter(map(known.__getitem__, own), np.int64, len(own)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = mapped(texts, count, "bucket long, n long", arrow=True).groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in found.collect():
        total[row.bucket] = row.n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """``floor(1000 * ln((t+1) * (S+B) / ((s+1) * (T+B))))`` for each of the B buckets."""
    b = len(source)
    all_s, all_t = float(source.sum() + b), float(target.sum() + b)
    return [
        math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
        for s, t in zip(source.tolist(), target.tolist())
    ]


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise in thousandths, a function of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: list[int], longest: int = LONGEST_RUN, seed: str = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of each row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def batches(frames):
        known = Buckets(len(gains), gains)
        for frame, first, held in _chunks(frames, longest):
            known.learn(set().union(*(f for _, f in held)))
            ids = frame.column(0).slice(first, len(held)).to_pylist()
            weight = [sum(map(known.__getitem__, own)) // len(own) if own else 0 for _, own in held]
            columns = [
                ids,
                [n for n, _ in held],
                [len(own) for _, own in held],
                weight,
                [w + noise(i, seed) for w, i in zip(weight, ids)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(wanted, batches, ", ".join(f"{n} long" for n in names), arrow=True)


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document, all long.

    Of the documents with ``least_words`` words, ``share`` hundredths are drawn, those
    with the highest scores, and numbered from 1 by score and then by the smaller id;
    others have no rank. Both tables are read whole.

    Null, empty and wordless texts have no features and weight 0. Repeated rows count
    and are drawn each; rows without an id are judged alike, draw the noise of the
    empty id and come last among equal scores. Empty tables of documents give an empty
    result, and an empty target gains that depend on the documents alone. Other columns
    are not read.
    """
    gains = bucket_gains(bucket_counts(docs.select("text"), buckets, longest), bucket_counts(target.select("text"), buckets, longest))
    scored = written(weigh(docs, gains, longest, seed), "resampling-scores")
    able = F.col("n_words") >= least_words
    # scores are whole thousandths of logarithms: at most some 200,000 differ for any input
    found = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    steps = sorted(((r.score, r.n) for r in found), reverse=True)
    wanted, before, offsets = sum(n for _, n in steps) * share // 100, 0, []
    for score, n in steps:
        if before >= wanted:
            break
        offsets.append((score, before))
        before += n
    spark = docs.sparkSession
    higher = spark.createDataFrame(offsets, "at long, before long")
    lowest = F.lit(offsets[-1][0] if offsets else None).cast("long")
    chosen = F.coalesce(able & (F.col("score") >= lowest), F.lit(False))
    by_id = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    rank = (F.row_number().over(by_id) + F.col("before")).cast("long")
    top = (
        scored.where(chosen)
        .join(F.broadcast(higher), F.col("score") == F.col("at"))
        .withColumn("rank", rank)
        .withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    )
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return top.select(names).unionByName(rest.select(names))


def _sql() -> str:
    table = ", ".join(str(x) for x in _crc_table().tolist())  # made by the rule above
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hashed = f"""[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"""

    def cut(table: str, key: str) -> str:
        lowered = f"translate(coalesce(text, ''), '{alphabet}', '{alphabet.lower()}')"
        return f"SELECT {key}, unnest(regexp_extract_all({lowered}, '{hashed}')) AS w FROM {table}"

    return f"""
WITH crc AS (SELECT [{table}]::BIGINT[] AS steps),
doc_words AS ({cut("documents", "doc_id")}),
item_words AS ({cut("benchmark", "item_id")}),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words)),
buckets AS (
  SELECT w, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM vocabulary, crc),
source AS (SELECT bucket, count(*) AS s FROM doc_words JOIN buckets USING (w) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM item_words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM doc_words)::DOUBLE AS all_s, (SELECT count(*) FROM item_words)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + {BUCKETS})
                                 / ((s + 1.0::DOUBLE) * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM source LEFT JOIN wanted USING (bucket), totals),
summed AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gained
  FROM doc_words JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0 ELSE (gained - ((gained % n_features) + n_features) % n_features) // n_features END AS weight,
         ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN summed USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * {SHARE} // 100 AS drawn
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
       CASE WHEN rank <= drawn THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


SQL = _sql()
