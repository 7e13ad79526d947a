import random
import re

from docspark.llm import wordpieces


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_small_vocabularies_equal_greedy_matching():
    draw = random.Random(4)
    for _ in range(60):
        pieces = {bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 7))) for _ in range(draw.randrange(1, 14))}
        automaton = wordpieces.Automaton(sorted(pieces))
        for _ in range(80):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randrange(0, 16)))
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_whole_table_equals_greedy_matching(documents):
    pieces = set(wordpieces.read_vocabulary(wordpieces.default_vocabulary()))
    longest, known = max(map(len, pieces)), {}

    def count(word):
        if word not in known:
            n, at = 0, 0
            while at < len(word):
                at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
                n += 1
            known[word] = n
        return known[word]

    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in wordpieces.token_counts(documents).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", texts[r.doc_id].encode())
        assert (r.n_words, r.n_tokens) == (len(words), sum(count(b" " + w) for w in words))


def test_odd_rows(odd_docs, no_docs):
    rows = wordpieces.token_counts(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[6].n_words == 60_000 and by[9].n_tokens == 1
    assert all((by[i].n_words, by[i].n_tokens) == (0, 0) for i in (3, 4, 5))
    assert wordpieces.token_counts(no_docs).count() == 0
