"""Token ids in a binary form: frequency ranks in byte-aligned variable length.

Each id is replaced by its rank by frequency, so that common ids take one byte.
A block holds the ranks of consecutive documents: one control byte for four
ranks, two bits each for a rank's length of 1 to 4 bytes, and apart from these
the ranks' little-endian bytes. Document lengths are coded in the same way. The
blocks are the rows of a table of files in ascending order of doc_id, next to a
table of the ranks. Decoding is a lookup of four lengths per control byte and
gathers of bytes, without a loop over ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import Growing, mapped, text_bytes, written
from docspark.session import work_folder

END_ID = 1
BLOCK_IDS = 1 << 20
PIECE_BYTES = 1 << 20
SLICE_BYTES = 8 << 20
_CACHE_WORDS = 800_000
_PLAIN = re.compile(rb"[!-&(-@\[-~]+")
_CUT = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order,
    take the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of control and data bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    out = np.zeros(n, np.uint32)
    for j in range(4):
        has = size > j
        if not has.any():
            break
        out[has] |= raw[starts[has] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def pieces(raw: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """Consecutive parts of a text, cut at ASCII white space if they can be."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(b" ", at, at + size), raw.rfind(b"\n", at, at + size))
        if end <= at:
            found = [x for x in (raw.find(b" ", at + size), raw.find(b"\n", at + size)) if x >= 0]
            if not found:
                break
            end = min(found)
        yield raw[at:end]
        at = end
    yield raw[at:]


def _small(words: list[bytes]) -> list[bytes]:
    """ASCII words in small letters; others as they are, since the tokenizer composes letters first."""
    return [w.lower() if w.isascii() else w for w in words]


class _Words(dict):
    """Numbers of words; a new word gets the next one and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of whole texts. The tokenizer sees each distinct word once.

    Only for tokenizers that treat white space as a border and drop it, lower-case
    what they read, and cut punctuation from letters; ``word_wise`` says whether a
    tokenizer is of this kind. Words seen are kept, up to a fixed number.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_wise = "Lowercase" in repr(self.tokenizer.normalizer) and "end_of_word_suffix=\"</w>\"" in repr(
            self.tokenizer.model
        )
        self.model = self.tokenizer.model
        self.spelt = {b: c for c, b in byte_of_char().items()}
        self._clear()

    def _new(self, word: bytes) -> list[int]:
        # The normaliser and the byte mapping leave small printable ASCII alone, and without
        # an apostrophe it is cut to runs of letters, single digits and runs of the rest.
        if word.isalpha() and word.islower():
            return [t.id for t in self.model.tokenize(word.decode())]
        if _PLAIN.fullmatch(word) and b"<|" not in word:
            cut = [p.decode() for p in _CUT.findall(word)]
            return [t.id for p in cut for t in self.model.tokenize(p)]
        # so do small Latin letters, composed as they are, whose bytes are spelt out
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250" and text == text.lower():
            return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.spelt))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joins(self, word: bytes) -> bool:
        """Whether a point or comma after this word may be one piece with its last characters."""
        if not word or word[-1] < 128:
            return not word[-1:].isalnum()
        text = word.decode("utf-8", "replace")
        # a small letter that stays one when composed and lowered
        if "\u00df" <= text[-1] <= "\u024f" and text[-1].islower():
            return False
        apart = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return any(apart(text + stop) != apart(text) + apart(stop) for stop in ".,")

    def _clear(self):
        self.at = _Words()
        self.lengths, self.starts, self.flat = Growing(np.int64), Growing(np.int64), Growing(np.uint32)
        self.joins = Growing(bool)
        self.stops = self._codes([b".", b","])

    def _codes(self, words: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if new := self.at.new:
            found = [self._new(w) for w in new]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.lengths.extend(lengths)
            self.starts.extend(self.flat.n + np.cumsum(lengths) - lengths)
            self.flat.extend(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())))
            self.joins.extend(list(map(self._joins, new)))
            new.clear()
        return codes

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many ids each word has."""
        size = self.lengths.room[codes]
        begin = np.cumsum(size) - size
        at = np.repeat(self.starts.room[codes] - begin, size) + np.arange(int(size.sum()))
        return self.flat.room[at], size

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        if not self.word_wise:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        raw = text_bytes(text)
        # names of special tokens count as they are written
        small = _small if b"<|" not in raw else list
        return np.concatenate([self._ids(self._codes(small(p.split())))[0] for p in pieces(raw)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many ids each has.

        Arrow splits the texts and finds their distinct words, so Python sees a
        word of a batch once. Points and commas before white space become words of
        their own, as the tokenizer cuts them off after letters and digits. A text
        in which one stands after anything else, or that may hold the name of a
        special token, is encoded by itself.
        """
        if len(self.at) > _CACHE_WORDS:
            self._clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.word_wise:
            alone = np.ones(len(texts), bool)
        else:
            alone = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(alone), "", texts)
        for stop in (". ", ", ", ".\n", ",\n"):
            plain = pc.replace_substring(plain, stop, " " + stop)
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        known = self._codes(_small([w.encode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]))
        codes = known[words.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        is_stop = (codes == self.stops[0]) | (codes == self.stops[1])
        wrong = np.flatnonzero(is_stop[1:] & self.joins.room[codes[:-1]]) + 1
        alone[np.searchsorted(ends, wrong, "right")] = True
        ids, size = self._ids(codes)
        upto = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))]
        counts = np.diff(upto)
        if alone.any():
            parts = np.split(ids, upto[1:-1])
            for i in np.flatnonzero(alone):
                parts[i] = self.encode(texts[int(i)].as_py())
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


_encoders: dict[str, Encoder] = {}


def _slices(docs: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Consecutive rows with some SLICE_BYTES of text together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(docs) else []
    for a, b in zip(starts, [*starts[1:], len(docs)]):
        yield docs.slice(a, b - a), texts.slice(a, b - a)


def _encoded(path: str, kind: str):
    def batches(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for frame in frames:
            for docs, texts in _slices(frame.column(0), frame.column(1)):
                ids, counts = encoder.encode_all(texts)
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), END_ID, kind)
                inside = np.ones(len(out), bool)
                inside[ends - 1] = False
                out[inside] = ids
                offsets = (np.concatenate(([0], ends)) * out.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(
                    pa.binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(out)]
                )
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(counts + 1), column], names=["doc_id", "n_tokens", "ids"]
                )

    return batches


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The values of all binary strings of a column, without a copy."""
    if not len(column):
        return np.zeros(0, kind)
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (int(ends[-1]) - int(ends[0])) // np.dtype(kind).itemsize, int(ends[0])) if data else np.zeros(0, kind)


def _counted(kind: str):
    def batches(frames):
        counts = np.zeros(0, np.int64)
        for frame in frames:
            own = np.bincount(_flat(frame.column(0), kind))
            if len(own) > len(counts):
                own, counts = counts, own
            counts[: len(own)] += own
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    return batches


def _blocks(ranks, kind: str):
    def batches(frames):
        from pyspark import TaskContext

        rank_of = np.frombuffer(ranks.value, "<u4")
        part, start, block = TaskContext.get().partitionId(), 0, 0
        held_ids, held_ids_n, docs, lengths = [], 0, [], []

        def row():
            values = rank_of[np.concatenate(held_ids)]
            control, data = pack(values)
            doc_control, doc_data = pack(np.array(lengths, np.uint32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([len(values)], pa.int64()),
                    *[pa.array([x], pa.binary()) for x in (doc_control, doc_data, control, data)],
                ],
                names=["part", "block", "start", "docs", "n_ids", "doc_control", "doc_data", "control", "data"],
            )

        for frame in frames:
            for doc, ids in zip(frame.column(0).to_pylist(), frame.column(1)):
                held_ids.append(np.frombuffer(ids.as_buffer(), kind))
                held_ids_n += len(held_ids[-1])
                docs.append(doc)
                lengths.append(len(held_ids[-1]))
                if held_ids_n >= BLOCK_IDS:
                    yield row()
                    start, block = start + held_ids_n, block + 1
                    held_ids, held_ids_n, docs, lengths = [], 0, [], []
        if docs:
            yield row()

    return batches


_BLOCK = (
    "part int, block int, start long, docs array<bigint>, n_ids long,"
    " doc_control binary, doc_data binary, control binary, data binary"
)


def _id_kind(path: str) -> str:
    """Two bytes hold the ids of small vocabularies until their ranks are known."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None) -> str:
    """Encode ``docs (doc_id, text)`` with an end id each, to files below ``folder``.

    Documents are written in ascending order of doc_id, null ids first, rows of
    one id ordered by their ids. A null or empty text is the end id alone. Texts of any length
    are encoded whole, in pieces cut at white space; an empty table gives empty tables.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = _id_kind(tokenizer)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = written(
        mapped(narrow, _encoded(tokenizer, kind), "doc_id long, n_tokens long, ids binary", arrow=True), "token-ids"
    )
    # one row per id of the vocabulary, whatever the number of documents
    counts = mapped(encoded.select("ids"), _counted(kind), "id long, n long", arrow=True).groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    id_of = counts["id"].to_numpy(np.int64).astype("<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 0, "<u4")
    rank_of[id_of] = np.arange(len(id_of))
    spark = docs.sparkSession
    ranks = [(int(i), int(r)) for r, i in enumerate(id_of)]
    spark.createDataFrame(ranks, "id long, rank long").coalesce(1).write.parquet(f"{folder}/ranks")
    ordered = encoded.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    shared = spark.sparkContext.broadcast(rank_of.tobytes())
    mapped(ordered, _blocks(shared, kind), _BLOCK, arrow=True).write.parquet(f"{folder}/blocks")
    return folder


def _decoded(ids):
    def batches(frames):
        id_of = np.frombuffer(ids.value, "<u4")
        for frame in frames:
            for r in frame.to_pylist():
                n = unpack(r["doc_control"], r["doc_data"], len(r["docs"])).astype(np.int64)
                values = id_of[unpack(r["control"], r["data"], r["n_ids"])].astype("<u4")
                ends = np.cumsum(n)
                starts = ends - n
                whole = memoryview(values.tobytes())
                crcs = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * len(n), pa.int32()),
                        pa.array(r["docs"], pa.int64()),
                        pa.array(starts + r["start"]),
                        pa.array(n),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return batches


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, decoded from the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    ids = spark.sparkContext.broadcast(ranks["id"].to_numpy(np.int64).astype("<u4").tobytes())
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row per partition that wrote files
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    docs = mapped(blocks, _decoded(ids), "part int, doc_id long, start long, n_tokens long, ids_crc32 long", arrow=True)
    return docs.join(offsets, "part").select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as files in the shared folder and return what the files hold."""
    folder = write_tokens(docs, work_folder(docs.sparkSession, "llm-tokens"), tokenizer)
    return read_tokens(docs.sparkSession, folder)
