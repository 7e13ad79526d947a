import re
from collections import Counter, defaultdict

from docspark.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dups, len(inside)


def test_measures_and_verdict_equal_brute_force(spark, documents):
    limit = 3
    rows = documents.select("doc_id", "source", "text").collect()
    holders = defaultdict(set)
    normal = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).translate({c: c + 32 for c in range(65, 91)})
    for r in rows:
        for line in r.text.split("\n"):
            holders[r.source, normal(line)].add(r.doc_id)
    for r in quality.quality(documents, line_documents=limit).collect():
        source, text = next((x.source, x.text) for x in rows if x.doc_id == r.doc_id)
        n, chars, symbols, dups, repeated = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeated)
        gone = sum(len(normal(x).split(" ")) for x in text.split("\n") if normal(x) and len(holders[source, normal(x)]) > limit)
        assert r.removed_words == gone
        failed = n < 20 or 100 * repeated > 30 * n
        assert r.base_failed == failed
        assert r.kept == (not failed and 2 * gone <= n)


def test_a_line_of_many_documents_depletes_those_that_hold_little_else(spark, prose):
    common = prose(40, 5)
    rows = [(i, "h", f"{prose(30, 100 + i)}\n{common}") for i in range(60)]
    rows += [(100 + i, "h", f"{prose(300, 300 + i)}\n  {common.upper()} ") for i in range(5)]
    rows += [(200, "other", f"{prose(30, 7)}\n{common}")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not any(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(5)) and kept[200]


def test_odd_rows(odd_docs, no_docs):
    rows = quality.quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id}
    by8 = odd_docs.where("doc_id = 8").first()
    assert by[1].kept and by[6].kept and by[6].n_words == 60_000
    assert all(by[i].base_failed and not by[i].kept and by[i].n_words == 0 for i in (3, 4, 5))
    assert (by[8].n_words, by[8].word_chars) == plain(by8.text)[:2]
    assert quality.quality(no_docs).count() == 0
