import math
from collections import Counter, defaultdict

from docspark.llm import language


def by_hand(rows, words=language.MAX_WORDS, units=language.MAX_GRAMS):
    """The rules on plain counts: a function from a text to its language and score."""
    def letters(text):
        return "".join(c if c.isalpha() else " " for c in text.lower()).split()

    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in letters(text or "") if lang is not None else []:
            counts[lang][0, w] += 1
            for size in range(1, 6):
                marked = f"<{w}>" if size > 1 else w
                counts[lang].update((size, marked[i : i + size]) for i in range(len(marked) - size + 1))
    langs, kept = sorted(counts), set()
    for own in counts.values():
        order = sorted(own, key=lambda u: (-own[u], u[0], u[1].encode()))
        kept |= {*[u for u in order if u[0] == 0][:words], *[u for u in order if u[0]][:units]}
    sums = {(lang, size): sum(counts[lang][u] + 0.5 for u in kept if u[0] == size) for lang in langs for size in range(6)}

    def unit(u):
        logs = [math.log((counts[lang][u] + 0.5) / sums[lang, u[0]]) for lang in langs]
        return [x - max(logs) for x in logs]

    def word(w):
        if (0, w) in kept:
            return unit((0, w))
        for size in range(5, 0, -1):
            marked = f"<{w}>" if size > 1 else w
            known = [unit((size, marked[i : i + size])) for i in range(len(marked) - size + 1) if (size, marked[i : i + size]) in kept]
            if known:
                return [sum(c) / len(known) for c in zip(*known)]
        return [0.0] * len(langs)

    def predict(text):
        found = letters(text or "")
        if not found or not langs:
            return "und", 0.0
        total = [sum(c) for c in zip(*map(word, found))]
        best = max(range(len(total)), key=total.__getitem__)
        return langs[best], 1 / sum(math.exp(max(-700.0, x - total[best])) for x in total)

    return predict


def test_equals_the_rules_by_hand(spark, documents, monkeypatch):
    docs = documents.select("doc_id", "text", "lang")
    asked = [(r.text, r.lang) for r in docs.collect()]
    for words, units in ((language.MAX_WORDS, language.MAX_GRAMS), (60, 90)):
        monkeypatch.setattr(language, "MAX_WORDS", words)
        monkeypatch.setattr(language, "MAX_GRAMS", units)
        want = by_hand(asked, words, units)
        for r in language.predict(docs.limit(60), language.fit(docs)).collect():
            lang, score = want(r.text)
            assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9)


def test_a_rare_language_keeps_its_units(spark, prose, monkeypatch):
    monkeypatch.setattr(language, "MAX_WORDS", 20)
    monkeypatch.setattr(language, "MAX_GRAMS", 20)
    rows = [(i, prose(300, i), "large") for i in range(30)] + [(99, "\u0436\u0443\u043a \u0436\u0430\u0431\u0430", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model["langs"] == ["large", "rare"]
    found = language.predict(docs, model).where("doc_id = 99").first()
    assert found.lang_pred == "rare" and found.score > 0.9


def test_numbers_are_no_letters():
    model = {"langs": ["aa", "bb"], "table": [{"m": (0.0, -1.0)}, {}, {}, {}, {}, {}]}
    scorer = language.Scorer(model)
    for text in ("\u00b2", "\u00bd \u2460", "\u2167", "12\u00b3"):
        assert scorer.predict(text) == ("und", 0.0)
    assert language.words_of("m\u00b2 \u00c4b\u00bdc d1e") == ["m", "\u00e4b", "c", "d", "e"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_the_text_is_an_input(spark, documents):
    model = language.fit(documents.select("doc_id", "text", "lang"))
    a = language.predict(documents.select("doc_id", "text"), model)
    b = language.predict(documents.selectExpr("-doc_id AS doc_id", "text", "'xx' AS lang", "'s' AS source"), model)
    as_set = lambda df: {(abs(r.doc_id), r.lang_pred, r.score) for r in df.collect()}
    assert as_set(a) == as_set(b)


def test_backoff_to_shorter_grams():
    tables = [{"known": (0.0, -5.0)}, {"q": (-3.0, 0.0)}, {"<z": (-1.0, 0.0)}, {}, {}, {}]
    model = {"langs": ["aa", "bb"], "table": tables}
    assert language.word_scores(model, "known") == (0.0, -5.0)
    assert language.word_scores(model, "zebra") == (-1.0, 0.0)
    assert language.word_scores(model, "aq") == (-3.0, 0.0)
    assert language.word_scores(model, "xy") == (0.0, 0.0)
    scorer = language.Scorer(model)
    assert scorer.predict("known, KNOWN!")[0] == "aa" and scorer.predict("zz q")[0] == "bb"
    assert scorer.predict("123 ...") == scorer.predict(None) == ("und", 0.0)


def test_odd_rows(odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        blank = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == blank and r.held_out in (True, False)
    assert language.identify(no_docs).count() == 0
    kept = language.with_language(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL").count() == 0
