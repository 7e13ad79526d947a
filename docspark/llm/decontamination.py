"""Benchmark decontamination by canonical templates.

Numbers, measuring units and names become typed placeholders, so that a question
with other parameters has the same template. Windows of templates are joined by
hash, and the values that fill an item's slots must be replaced consistently
along each occurrence.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import MIX, Growing, mapped, mixed, text_bytes, window_hashes, written

WINDOW = 8
LEAST_COVERAGE = 0.3
LEAST_LITERALS = 4
BITMAP_BITS = 25  # the filter sent to tasks has 2**25 bits (4 MiB) for any benchmark
# names after the first word of a sentence, all in title case, or none (so that case counts for nothing)
FORMS = INNER_NAMES, ALL_NAMES, NO_NAMES = range(3)
LITERAL, NUMBER, UNIT, NAME, MEASURE, NOTHING = range(6)
_PLACEHOLDER = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>", MEASURE: "<measure>"}
UNITS = frozenset(
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs day days week weeks month"
    " months year years hour hours minute minutes second seconds meter meters metre metres mile"
    " miles gram grams liter liters litre litres dollar dollars cent cents euro euros usd eur gbp"
    " pound pounds percent kmh mph".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:e[+-]?\d+)?")
_MEASURE = re.compile(r"[$€£]?[+-]?\d[\d.,]*(?:%|°?[a-z°]{0,4})?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%€$£°]+$")
_ENDS = re.compile(r"[.!?:]['\")\]]*$")
_CACHE_WORDS = 800_000


def classify(raw: str) -> tuple[int, str, bool]:
    """Kind, canonical value and whether a sentence ends with this raw word.

    Names are words in title case; whether one starts a sentence, and so is no
    name, is decided from the word before it.
    """
    plain = raw.isalpha()
    ends = not plain and bool(_ENDS.search(raw))
    core = raw if plain else _EDGE.sub("", raw)
    low = core.lower()
    if not core:
        return NOTHING, "", ends
    if low in UNITS:
        return UNIT, low, ends
    if not core.isalpha():
        if _NUMBER.fullmatch(low):
            return NUMBER, low, ends
        if _MEASURE.fullmatch(low):
            return MEASURE, low, ends
    if len(core) > 1 and core[0].isupper() and core[1:].islower():
        return NAME, low, ends
    return LITERAL, low, ends


class _Codes(dict):
    """Codes of raw words; a new word gets one when it is asked for."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, raw: bytes) -> int:
        self[raw] = code = self.add(raw)
        return code


class Templates:
    """Template windows of texts. Known words are kept, up to a fixed number."""

    def __init__(self):
        self.at = _Codes(self._add)
        self.values: list[str] = []
        self.new: list[tuple[int, int, bool]] = []
        self.arrays = Growing(np.uint64), Growing(np.int8), Growing(bool)

    def _add(self, raw: bytes) -> int:
        import xxhash

        if raw.isalpha():  # letters of ASCII alone, as most words are
            low = raw.lower()
            value, ends = low.decode(), False
            title = len(raw) > 1 and raw[:1].isupper() and raw[1:].islower()
            kind = UNIT if value in UNITS else NAME if title else LITERAL
            self.values.append("" if kind == LITERAL else value)
            self.new.append((xxhash.xxh64_intdigest(low), kind, ends))
            return len(self.values) - 1
        if raw in (b"\x00", _BETWEEN):  # a line break, or the end of a text
            kind, value, ends = NOTHING, "", True
        else:
            kind, value, ends = classify(raw.decode("utf-8", "replace"))
        self.values.append("" if kind == LITERAL else value)  # only slots are asked for
        self.new.append((xxhash.xxh64_intdigest(value.encode("utf-8", "replace")), kind, ends))
        return len(self.values) - 1

    def read_all(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Codes, kinds and value hashes of all tokens of texts, which start a sentence, and whose they are."""
        if len(self.values) > _CACHE_WORDS:
            self.__init__()
        joined = b" \xff ".join(t.replace(b"\x00", b" ") for t in texts)
        raw = joined.replace(b"\n", b" \x00 ").split()
        codes = np.fromiter(map(self.at.__getitem__, raw), np.int64, len(raw))
        between = self.at[_BETWEEN]
        if self.new:
            for array, values in zip(self.arrays, zip(*self.new)):
                array.extend(values)
            self.new = []
        hashes, kinds, ends = (a.room[codes] for a in self.arrays)
        starts = np.concatenate(([True], ends[:-1]))[: len(codes)]
        own = np.cumsum(codes == between)
        real = kinds != NOTHING
        return codes[real], kinds[real], hashes[real], starts[real], own[real]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, kinds and value hashes of a text's tokens, and which start a sentence."""
        return self.read_all([text_bytes(text)])[:4]

    def tokens(self, text: str | None, form: int = INNER_NAMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, kinds and canonical hashes of a text's tokens."""
        codes, *rest = self.read(text)
        return codes, *_as_form(*rest, form)

    def slots(self, codes: np.ndarray, kinds: np.ndarray) -> list[str]:
        return [
            f"{_PLACEHOLDER[k]}{self.values[c]}"
            for c, k in zip(codes.tolist(), kinds.tolist())
            if k != LITERAL
        ]


_SCHEMA = "pos int, h long, slots array<string>"


def _as_form(kinds, values, starts, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and canonical hashes in one of the forms."""
    if form == INNER_NAMES:
        kinds = np.where((kinds == NAME) & starts, LITERAL, kinds)
    elif form == NO_NAMES:
        kinds = np.where(kinds == NAME, LITERAL, kinds)
    return kinds, np.where(kinds != LITERAL, kinds.astype(np.uint64), values)


def _windows(kinds: np.ndarray, hashes: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows and which of them are templates.

    A window with too few literal words stands for its own values alone.
    """
    windows = window_hashes(hashes, size)
    literal = np.concatenate(([0], np.cumsum(kinds == LITERAL)))
    enough = (literal[size:] - literal[:-size])[: len(windows)] >= LEAST_LITERALS
    if not enough.all():
        windows = np.where(enough, windows, mixed(window_hashes(values, size) ^ MIX))
    return windows, enough


def _item_windows(batches):
    cut = Templates()
    for batch in batches:
        rows = []
        for item, text in zip(batch["item_id"], batch["text"]):
            codes, kinds, values, starts = cut.read(text)
            size = min(WINDOW, len(codes))
            for form in FORMS if size else ():
                own, hashes = _as_form(kinds, values, starts, form)
                windows, enough = _windows(own, hashes, values, size)
                n = len(windows), int(enough.sum())
                rows += [
                    (item, form, *n, size, e, i, h, cut.slots(codes[i : i + size], own[i : i + size]))
                    for i, (h, e) in enumerate(zip(windows.view(np.int64).tolist(), enough.tolist()))
                ]
        yield pd.DataFrame(
            rows, columns=["item_id", "form", "n_windows", "n_templates", "size", "template", "pos", "h", "slots"]
        )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items' templates; an item below the window is one window by itself.

    Each item is there in three forms. Windows with fewer than four literal words say too
    little as templates and stand for their own values, so they match verbatim copies only.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return mapped(items, _item_windows, f"item_id long, form int, n_windows int, n_templates int, size int, template boolean, {_SCHEMA}")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MIX and of its inverse: with them a running sum gives the hashes of all windows."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = MIX, np.uint64(pow(int(MIX), -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


class _Sums:
    """Hashes of windows as ``window_hashes`` gives them, for tokens that share most of their windows."""

    def __init__(self):
        self.up, self.down = _powers(1 << 12)

    def totals(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) + 64 > len(self.up):
            self.up, self.down = _powers(2 * len(hashes) + 64)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.down[: len(hashes)])))

    def windows(self, totals: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return mixed((totals[at + size] - totals[at]) * self.up[at + size - 1])


def _form_windows(sums: _Sums, kinds, values, starts, at: np.ndarray, size: int):
    """``(form, positions, hashes, kinds)``: the windows at ``at`` in every form, each hashed once.

    Forms differ at names only: a window without one is the same in all, and one whose
    names all start sentences is the same with inner names as without any.
    """
    named = kinds == NAME
    inner = named & ~starts
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    names, inners, literals = upto(named), upto(inner), upto(kinds == LITERAL)
    within = lambda counts, i: counts[i + size] - counts[i]
    plain = sums.totals(values)

    def hashed(of, literal, i):
        found = sums.windows(sums.totals(of), i, size)
        few = within(literal, i) < LEAST_LITERALS
        if few.any():
            found[few] = mixed(sums.windows(plain, i[few], size) ^ MIX)
        return found

    slot = kinds.astype(np.uint64)
    every = hashed(np.where(kinds == LITERAL, values, slot), literals, at)
    some = np.flatnonzero(within(names, at))
    bare = every.copy()
    if len(some):
        bare[some] = hashed(np.where((kinds == LITERAL) | named, values, slot), literals + names, at[some])
    mid = bare.copy()
    some = np.flatnonzero(within(inners, at))
    if len(some):
        literal = (kinds == LITERAL) | (named & starts)
        mid[some] = hashed(np.where(literal, values, slot), upto(literal), at[some])
    return {INNER_NAMES: mid, ALL_NAMES: every, NO_NAMES: bare}


_BETWEEN = b"\xff"  # no text has this byte
_GROUP_BYTES = 1 << 20  # of texts that are read together


def _groups(frames):
    """Ids and texts of a batch's documents, so many together as make a good part of work."""
    for frame in frames:
        held, size = [], 0
        for doc, text in zip(frame["doc_id"], frame["text"]):
            held.append((doc, text_bytes(text)))
            size += len(held[-1][1])
            if size >= _GROUP_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _doc_windows(bitmap, sizes, bits):
    names = ["doc_id", "form", "size", "pos", "h", "slots"]

    def batches(frames):
        cut, sums, filled = Templates(), _Sums(), np.frombuffer(bitmap.value, np.uint8)

        for held in _groups(frames):
            codes, kinds, values, starts, doc = cut.read_all([text for _, text in held])
            first = np.searchsorted(doc, np.arange(len(held)))
            rows = []
            for size in sizes:
                at = np.arange(max(0, len(codes) - size + 1))
                at = at[doc[at] == doc[at + size - 1]]
                if not len(at):
                    continue
                for form, windows in _form_windows(sums, kinds, values, starts, at, size).items():
                    top = windows >> np.uint64(64 - bits)
                    known = np.flatnonzero((filled[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1)
                    own, _ = _as_form(kinds, values, starts, form) if len(known) else (kinds, None)
                    rows += [
                        (
                            held[doc[i]][0],
                            form,
                            size,
                            int(i - first[doc[i]]),
                            int(h),
                            cut.slots(codes[i : i + size], own[i : i + size]),
                        )
                        for i, h in zip(at[known].tolist(), windows[known].view(np.int64))
                    ]
            yield pd.DataFrame(rows, columns=names)

    return batches


def _bitmap(windows: DataFrame) -> bytes:
    """Which of the 2**BITMAP_BITS leading hash patterns occur: at most 4 MiB to the driver."""
    top = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = (
        windows.groupBy(F.shiftright(top, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) % 64 as int))")).alias("bits"))
        .toPandas()
    )
    filled = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    filled[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return filled.astype("<i8").tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds.

    ``(doc_id, item_id, coverage, same_values)``: the share of the item's template
    windows, or of all its windows, found in occurrences with consistent slots, in
    the first form that reaches ``least_coverage``, and whether all slots of these kept the item's values.
    An occurrence is inconsistent if one value of the item is replaced by two.

    Each document is filtered by a bitmap of fixed size before the join, whatever
    the size of the benchmark. Null and empty texts match nothing, all-placeholder
    texts their verbatim copies; rows with a null id take no part; repeated rows count once; empty
    tables give an empty result. Only ids and texts are read.
    """
    spark = docs.sparkSession
    items = written(
        item_windows(benchmark.where("item_id is not null").dropDuplicates(["item_id", "text"])),
        "leak-items",
    )
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    wanted = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = mapped(wanted, _doc_windows(bitmap, sizes, BITMAP_BITS), f"doc_id long, form int, size int, {_SCHEMA}")
    # by (size, h) for the join; a window in a third of all documents is split by Spark
    of_item = ["item_id", "form", "n_windows", "n_templates"]
    held = items.select(*of_item, "template", "size", "h", F.col("pos").alias("at"), F.col("slots").alias("own"))
    slots = F.arrays_zip(F.col("own").alias("own"), F.col("slots").alias("slots"))
    occurrence = (
        found.join(held, ["form", "size", "h"])
        .select("doc_id", *of_item, "template", "at", (F.col("pos") - F.col("at")).alias("shift"), slots.alias("pairs"))
        .groupBy("doc_id", *of_item, "shift")
        .agg(
            F.collect_set("at").alias("at"),
            F.collect_set(F.when(F.col("template"), F.col("at"))).alias("as_template"),
            F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        )
    )
    own = F.array_distinct(F.transform("pairs", lambda p: p["own"]))
    consistent = occurrence.where(F.size(own) == F.size("pairs"))

    def n_of(lists):
        return F.size(F.array_distinct(F.flatten(F.collect_list(lists))))

    by_form = consistent.groupBy("doc_id", *of_item).agg(
        F.greatest(
            n_of("at") / F.col("n_windows"),
            F.when(F.col("n_templates") > 0, n_of("as_template") / F.col("n_templates")),
        ).alias("coverage"),
        F.every(F.forall("pairs", lambda p: p["own"] == p["slots"])).alias("same_values"),
    )
    enough = F.when(F.col("coverage") >= least_coverage, F.col("form"))
    return (
        by_form.groupBy("doc_id", "item_id")
        .agg(F.min_by("coverage", enough).alias("coverage"), F.min_by("same_values", enough).alias("same_values"))
        .where("coverage is not null")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without an id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
