import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24])))
def test_packing_round_trip(values):
    control, data = tokens.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokens.unpack(control, data, len(values)).tolist() == values


ENCODER = tokens.Encoder(tokens.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcXYZ éñßŉ.,!?'\"-*<|>\n\t\x0b\x1c 09st漢́ ", max_size=40) | st.text(max_size=40))
def test_encoding_equals_the_tokenizer(text):
    want = ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text).tolist() == want
    ids, counts = ENCODER.encode_all(pa.array([text, None, "one, two. Three", text]))
    more = ENCODER.tokenizer.encode("one, two. Three", add_special_tokens=False).ids
    assert ids.tolist() == want + more + want and counts.tolist() == [len(want), 0, len(more), len(want)]


ODD = "aI\u0130\u0958\ufb1d\ufb2aJ\u030c\u0301\u0307\u00e9\u00df\u00b2\u00bd\u2167\u216e\u2460\u6f22\u30cf\u3099\u0e33\ufb01\U0001f600.,;' \n"


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=8), max_size=6))
def test_points_after_letters_that_change(parts):
    texts = [p + stop for p in parts for stop in (". x", ", ", ".\n", "")]
    want = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = ENCODER.encode_all(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_every_letter_before_a_point():
    """All characters of the first planes, in one text each that the tokenizer reads whole."""
    texts = [f"a{chr(c)}. b{chr(c)}, c" for c in [*range(33, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800)]]
    want = [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, counts = ENCODER.encode_all(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_pieces_are_cut_at_white_space():
    raw = b"aa bb\ncc" + b"d" * 50 + b" ee  ff"
    for size in range(1, 70):
        parts = list(tokens.pieces(raw, size))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def expected(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = (ENCODER.tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_of_the_whole_table(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    found = sorted(tuple(r) for r in tokens.tokenized(documents.repartition(5)).collect())
    assert found == expected(rows)


def test_ranks_are_by_frequency(spark, documents, folder):
    tokens.write_tokens(documents, folder)
    ranks = {r.id: r.rank for r in spark.read.parquet(f"{folder}/ranks").collect()}
    counts = np.bincount(np.concatenate([np.append(ENCODER.encode(r.text), 1) for r in documents.collect()]))
    order = [counts[i] for i in sorted(ranks, key=ranks.get)]
    assert order == sorted(order, reverse=True) and len(ranks) == np.count_nonzero(counts)


def test_odd_rows(odd_docs, no_docs):
    rows = tokens.tokenized(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in rows)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    ids = [i for _, _, i in spans]
    assert ids == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    end = zlib.crc32(np.array([1], "<u4").tobytes())
    assert {(r.n_tokens, r.ids_crc32) for r in rows if r.doc_id in (3, 4, 5)} == {(1, end)}
    assert tokens.tokenized(no_docs).count() == 0


def test_decomposed_capitals_as_the_tokenizer_reads_them():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    for text in ("J\u030c", "Plain T\u0308x H\u0331 and W\u030a, Y\u030a. J\u030c END"):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want
        assert encoder.encode_all(pa.array([text]))[0].tolist() == want
