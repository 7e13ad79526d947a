"""Quality rules: line frequency across the documents of a host.

Lines are normalised and hashed, the distinct documents of each host that hold a
line are counted, lines above a limit are removed, and documents that keep too
few words, or lose too large a share, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import LOWER_ASCII, mapped, text_bytes, window_hashes, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words in repeated windows
LINE_DOCUMENTS = 50  # distinct documents of a host that may hold a line
MOST_REMOVED = 50  # per cent of words on removed lines
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = window_hashes(hashes, WINDOW)
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def normal_line(line: bytes) -> tuple[bytes, int]:
    """A line in small ASCII letters with single spaces, and its number of words."""
    words = line.translate(LOWER_ASCII).split()
    return b" ".join(words), len(words)


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text hash, lines.

    Lines are ``(hash, words, times)`` of each distinct normalised line with a word.
    """
    import xxhash

    raw = text_bytes(text)
    points = np.frombuffer(raw, np.uint8)
    starts = (points & 0xC0) != 0x80
    words = raw.split()
    seen, dups, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        normal, n = normal_line(line)
        if n:
            dups += line in seen
            seen.add(line)
            key = xxhash.xxh64_intdigest(normal) - (1 << 63)
            lines[key, n] = lines.get((key, n), 0) + 1
    return (
        len(words),
        int((starts & ~_SPACE[points]).sum()),
        int(_SYMBOL[points].sum()),
        dups,
        repeated_words(words),
        xxhash.xxh64_intdigest(raw) - (1 << 63),
        [(h, n, times) for (h, n), times in lines.items()],
    )


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "array<struct<hash:long,words:long,times:long>>"


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in f"{_MEASURES}, text_hash, lines".split(", ")]
    for batch in batches:
        found = pd.DataFrame([measure(x) for x in batch["text"]], columns=names)
        found["lines"] = [[dict(zip(("hash", "words", "times"), x)) for x in own] for own in found["lines"]]
        found.insert(0, "host", batch["host"].to_numpy())
        found.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
        yield found


def quality(docs: DataFrame, host_col: str = "source", line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """Measures and verdict of each row of ``docs``.

    ``doc_id``, the measures, ``removed_words`` (on lines held by more than
    ``line_documents`` distinct documents of the host), ``base_failed`` and
    ``kept``: neither base_failed nor depleted, which is having lost more than
    half of its words. Null hosts form a host of their own, null ids
    count as no document. Null and empty texts have no words and fail. Repeated
    rows are judged alike and count once. Texts of any length are read whole, and an empty
    table gives an empty result. Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).alias("host"), "text")
    schema = f"doc_id long, host string, {_MEASURES}, text_hash long, lines {_LINES}"
    measured = written(mapped(narrow, _measured, schema), "quality")
    key = ["host", "doc_id", "text_hash"]
    lines = (
        measured.select(*key, F.explode("lines").alias("l"))
        .select(*key, "l.hash", "l.words", "l.times")
        .distinct()
    )
    # counted per host, line and document first, so a line in every document is no hot key
    common = (
        lines.groupBy("host", "hash")
        .agg(F.countDistinct("doc_id").alias("documents"))
        .where(F.col("documents") > line_documents)
        .select(F.col("host").alias("h"), F.col("hash").alias("x"))
    )
    removed = (
        lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("x")), "left_semi")
        .groupBy(*key)
        .agg(F.sum(F.col("words") * F.col("times")).alias("removed_words"))
        .select(F.struct(*key).alias("k"), "removed_words")
    )
    found = measured.drop("lines").join(removed, F.struct(*key).eqNullSafe(F.col("k")), "left")
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = 100 * gone > MOST_REMOVED * F.col("n_words")
    return found.select(
        "doc_id",
        *[x.split()[0] for x in _MEASURES.split(", ")],
        gone.alias("removed_words"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
    )


SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
    FROM (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w))),
rep AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win WHERE c > 1) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (
    SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
           translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
    FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (
    SELECT doc_id, sum(c - 1) AS n_dup_lines
    FROM (SELECT doc_id, line, count(*) AS c FROM lines GROUP BY ALL) GROUP BY doc_id),
common AS (
    SELECT source, normal FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) > {LINE_DOCUMENTS}),
gone AS (SELECT doc_id, sum(n) AS removed FROM lines SEMI JOIN common USING (source, normal) GROUP BY doc_id),
m AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
       AND 100 * removed_words <= {MOST_REMOVED} * n_words AS kept
FROM m
"""
