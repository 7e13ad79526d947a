"""Language identification by words first, backing off to shorter character n-grams.

A word that the model knows scores by its log frequency in each language. Any
other word scores by its longest n-grams of which at least one is known, from
five characters (with word borders) down to one.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import Growing, mapped, ship, written

SAMPLE_ROWS = 8_000  # labelled rows that a model is fitted on, about
MAX_WORDS = 20_000  # of each language: its most frequent words, and as many n-grams
MAX_GRAMS = 20_000
LONGEST = 5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits such as \u00b2
_CACHE_WORDS = 400_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in small letters."""
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def grams(word: str, size: int) -> list[str]:
    marked = f"<{word}>" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _counted(batches):
    """Counts of words and n-grams by language, over as much as a task reads at a time."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = Counter()
        for lang, text in zip(batch["lang"], batch["text"]):
            if text is not None:
                for word, n in Counter(words_of(text)).items():
                    counts[lang, word] += n
        found = Counter()
        for (lang, word), n in counts.items():
            found[lang, 0, word] += n
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    found[lang, size, gram] += n
        rows = [(lang, size, unit, n) for (lang, size, unit), n in found.items()]
        yield pd.DataFrame(rows, columns=["lang", "size", "unit", "n"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from labelled rows ``(doc_id, text, lang)``; rows with a null lang go.

    Above ``sample_rows`` labelled rows, about so many are taken by the hash of
    their id, whole texts each. The model keeps the ``MAX_WORDS`` most frequent words
    and ``MAX_GRAMS`` n-grams of every language that has a word, ties by the unit, so its size
    has a bound whatever the size of the table, and no language is lost beside a large
    one. Repeated rows count each; a table without words gives a model without languages.
    """
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang")
    share = min(1.0, sample_rows / max(1, rows.count()))
    limit = int(share * (1 << 30))
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit) if share < 1 else rows
    counts = (
        mapped(taken.select("lang", "text"), _counted, "lang string, size int, unit string, n long")
        .groupBy("lang", "size", "unit")
        .agg(F.sum("n").alias("n"))
    )
    counts = written(counts, "language-units")
    kind = F.col("size") > 0
    by_count = Window.partitionBy("lang", kind).orderBy(F.desc("n"), "size", "unit")
    most = F.when(kind, MAX_GRAMS).otherwise(MAX_WORDS)
    kept = counts.withColumn("nth", F.row_number().over(by_count)).where(F.col("nth") <= most)
    # a unit that one language keeps counts in all
    by_unit = (
        counts.join(kept.select("size", "unit").distinct(), ["size", "unit"], "left_semi")
        .groupBy("size", "unit")
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    )
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    n_of = [F.coalesce(F.col("by_lang")[lang], F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    found = by_unit.select("size", "unit", *n_of).toArrow()
    sizes = found["size"].to_numpy()
    counts_of = np.zeros((len(langs), len(sizes)))
    for i in range(len(langs)):
        counts_of[i] = found[f"n{i}"].to_numpy()
    table: list[dict[str, tuple]] = [{} for _ in range(LONGEST + 1)]
    for size in range(LONGEST + 1):
        at = np.flatnonzero(sizes == size)
        if len(at):
            smooth = counts_of[:, at] + 0.5
            logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
            # what a unit says of the language, not how rare it is
            logs -= logs.max(axis=0)
            table[size] = dict(zip(found["unit"].take(at).to_pylist(), zip(*logs.tolist())))
    return {"langs": langs, "table": table}


def word_scores(model: dict, word: str) -> tuple:
    table = model["table"]
    if word in table[0]:
        return table[0][word]
    for size in range(LONGEST, 0, -1):
        own = table[size]
        known = [own[g] for g in grams(word, size) if g in own]
        if known:
            return tuple(sum(column) / len(known) for column in zip(*known))
    return (0.0,) * len(model["langs"])


class Scorer:
    """Scores of whole texts; those of words seen are kept, up to a fixed number."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.scores = [Growing(np.float64) for _ in self.langs]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.at) > _CACHE_WORDS:
            self._clear()
        at = self.at
        new = [w for w in dict.fromkeys(words) if w not in at]
        if new:
            at.update(zip(new, range(len(at), len(at) + len(new))))
            for column, values in zip(self.scores, zip(*[word_scores(self.model, w) for w in new])):
                column.extend(values)
        codes = np.array([at[w] for w in words], np.int64)
        total = [float(column.room[codes].sum()) for column in self.scores]
        best = max(range(len(total)), key=total.__getitem__)  # ties: the first language by name
        score = 1 / math.fsum(math.exp(max(-700.0, x - total[best])) for x in total)
        return self.langs[best], min(1.0, score)


_scorers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior of equal priors, 0 to 1).

    Only the text is an input. A null text, one without a letter, or a model
    without languages gives ``und`` and 0. Columns of these names in ``docs``
    are replaced. Scores of words are kept between batches, up to a fixed number.
    """
    ship()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def column(texts: pd.Series) -> pd.DataFrame:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer = _scorers[key]
        found = [scorer.predict(x) for x in texts.astype(object).where(texts.notna(), None)]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    scored = docs.select(*rest, column("text").alias("_found"))
    return scored.select(*rest, "_found.lang_pred", "_found.score")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the rows that are not held out, then predict all rows of ``docs``.

    Adds ``held_out``, ``lang_pred`` and ``score``. A row with a null doc_id is
    neither held out nor learned from. Repeated rows are predicted each, texts of any length
    are read whole, and an empty table gives an empty result.
    """
    marked = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    learned = docs.where(~held_out(F.col("doc_id")))
    return predict(marked, fit(learned, sample_rows))


def with_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that have a language with at least this score."""
    found = identify(docs)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(
        *docs.columns
    )
