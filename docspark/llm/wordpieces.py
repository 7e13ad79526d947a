"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over bytes. Each node has a failure link: the node at
which matching goes on once the longest pieces at the front of its string are
taken off, and the number of pieces taken. Both are computed once for the
vocabulary, so a word is counted in one pass over its bytes, and no piece is ever
built. A word is matched with its leading space, as pieces that begin words hold
one; a vocabulary with all single bytes leaves nothing unknown.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import per_text, text_bytes
from docspark.llm.tokens import byte_of_char, pieces

_CACHE_WORDS = 600_000
ROOT = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file that can match inside a word."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    special = {t["content"] for t in parsed.get("added_tokens", [])}
    byte = byte_of_char()
    found = [bytes(byte[c] for c in piece) for piece in parsed["model"]["vocab"] if piece not in special]
    return [p for p in found if p]


class Automaton:
    """Trie, failure links and numbers of popped pieces of a vocabulary."""

    def __init__(self, vocabulary: Iterable[bytes]):
        step: dict[int, int] = {}  # node * 256 + byte to node
        parent, byte, piece = [-1], [0], [False]
        for p in vocabulary:
            node = ROOT
            for b in p:
                key = node << 8 | b
                if key not in step:
                    step[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    piece.append(False)
                node = step[key]
            piece[node] = True
        n = len(parent)
        fail, pops = [-1] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            children[parent[node]].append(node)
        queue = deque(children[ROOT])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            if piece[node]:
                fail[node], pops[node] = ROOT, 1
                continue
            at, popped = fail[parent[node]], pops[parent[node]]
            while at != -1 and (at << 8 | byte[node]) not in step:
                at, popped = fail[at], popped + pops[at]
            if at != -1:
                fail[node], pops[node] = step[at << 8 | byte[node]], popped
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; -1 if some byte is in no piece."""
        step, fail, pops = self.step, self.fail, self.pops
        node, total = ROOT, 0
        for b in word:
            while (node << 8 | b) not in step:
                if node == ROOT or fail[node] == -1:
                    return -1
                total += pops[node]
                node = fail[node]
            node = step[node << 8 | b]
        while node != ROOT:
            if fail[node] == -1:
                return -1
            total += pops[node]
            node = fail[node]
        return total


_automata: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def text_tokens(text: str | None, path: str) -> tuple[int, int]:
    """Words and tokens of a whole text; an unmatchable word is one token."""
    if path not in _automata:
        _automata[path] = Automaton(read_vocabulary(path)), {}
    automaton, known = _automata[path]
    n_words = n_tokens = 0
    for part in pieces(text_bytes(text)):
        words = part.split()
        n_words += len(words)
        counts = Counter(words)
        if len(known) > _CACHE_WORDS:
            known.clear()
        for word in counts:
            if word not in known:
                known[word] = abs(automaton.count(b" " + word))
        n_tokens += sum(known[word] * n for word, n in counts.items())
    return n_words, n_tokens


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of each row of ``docs``.

    A null, empty or blank text has none of either. Repeated rows stay repeated,
    ids may be null, other columns are not read. Texts of any length are read whole, and an
    empty table gives an empty result. The file of the vocabulary must
    be where ``vocabulary`` says on every executor.
    """
    path = vocabulary or default_vocabulary()
    counts = per_text(lambda x: text_tokens(x, path), "array<bigint>")(F.col("text"))
    found = docs.select("doc_id", counts.alias("_counts"))
    return found.select(
        "doc_id", F.col("_counts")[0].alias("n_words"), F.col("_counts")[1].alias("n_tokens")
    )
