import numpy as np

from docspark.llm import decontamination as dec

QUESTION = "A train leaves Leeds with 120 passengers and arrives in York after 45 minutes, losing 30 passengers; how many passengers of the 120 remain on board?"
ITEMS = [
    (1, QUESTION),
    (2, "Two farmers share the harvest of a small field in equal parts every single autumn."),
    (3, "12 14 16"),
    (4, "what is the capital of peru"),
    (5, None),
    (6, ""),
    (None, "a row without an id is not an item of the benchmark at all"),
]


def found(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): (round(r.coverage, 2), r.same_values) for r in dec.leaks(rows, items).collect()}


def test_other_parameters_are_the_same_question(spark):
    other = QUESTION.replace("Leeds", "Bath").replace("York", "Hull").replace("120", "99").replace("45", "20").replace("30", "7")
    mixed = QUESTION.replace("with 120", "with 99")  # 120 becomes 99 at one place only
    docs = [
        (1, f"Before it. {QUESTION} And after."),
        (2, f"Before it.\n{other}"),
        (3, mixed),
        (4, "A train leaves with some passengers and arrives late in the evening, how many passengers remain?"),
        (5, "Say what is the capital of Peru"),
        (6, "1 2 3 4 5 6 7 8 9 10 Anna Bert Carl Dora Emil Fritz Gustav"),
        (7, None),
        (8, ""),
    ]
    rows = found(spark, docs)
    assert rows[1, 1][1] is True and rows[1, 1][0] > 0.9
    assert rows[2, 1][1] is False and rows[2, 1][0] > 0.9
    assert (3, 1) not in rows
    assert set(rows) <= {(1, 1), (2, 1), (5, 4)}


def test_windows_equal_brute_force(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    cut, size = dec.Templates(), dec.WINDOW
    hashes = lambda text: dec.window_hashes(cut.tokens(text)[2], size).tolist()
    own = {r.item_id: hashes(r.text) for r in benchmark.collect()}
    want = {}
    for r in documents.collect():
        there = set(hashes(r.text))
        for item, windows in own.items():
            share = sum(w in there for w in windows) / max(1, len(windows))
            if share >= dec.LEAST_COVERAGE:
                want[r.doc_id, item] = share
    got = {(r.doc_id, r.item_id): r.coverage for r in dec.leaks(documents, benchmark).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_classes_of_words():
    kind = lambda w: dec.classify(w)[:2]
    assert kind("1,200.5") == (dec.NUMBER, "1,200.5") and kind("(12)") == (dec.NUMBER, "12")
    assert kind("km") == (dec.UNIT, "km") and kind("5km") == (dec.MEASURE, "5km") and kind("$5") == (dec.MEASURE, "$5")
    assert kind("Paris,") == (dec.NAME, "paris") and kind("NATO") == (dec.LITERAL, "nato")
    assert kind("--") == (dec.NOTHING, "") and dec.classify("end.")[2] and not dec.classify("mid,")[2]
    codes, kinds, _ = dec.Templates().tokens("The man met Anna. He left\nParis on 3 May")
    assert kinds.tolist() == [0, 0, 0, dec.NAME, 0, 0, 0, 0, dec.NUMBER, dec.NAME]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "nothing like any of the other texts here at all")], "item_id long, text string")
    assert dec.leaks(odd_docs, items).count() == 0
    kept = dec.without_leaks(odd_docs, items)
    assert kept.count() == odd_docs.count() and sorted(kept.columns) == sorted(odd_docs.columns)
    texts = odd_docs.where("doc_id = 2").selectExpr("doc_id AS item_id", "text", "text AS h", "text AS pos")
    assert {r.doc_id for r in dec.leaks(odd_docs, texts).collect()} == {1, 2}
    assert dec.leaks(no_docs, items).count() == 0 and dec.leaks(odd_docs, texts.limit(0)).count() == 0


def leaks_of(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): (r.coverage, r.same_values) for r in dec.leaks(docs, items).collect()}


def test_leading_names_and_changed_case(spark):
    tom = "Tom buys 12 pens. Tom sells 5 pens. Tom finds 3 pens. How many pens has he?"
    german = "Der Bauer bringt Korn, Hafer, Mais und Heu zum Markt nach Ulm"
    docs = [tom.replace("Tom", "Ann"), german.lower(), german.upper(), QUESTION.upper(), tom.replace("Tom", "Ann", 2)]
    rows = leaks_of(spark, [tom, german, QUESTION], docs)
    assert rows[0, 0] == (1, False)
    assert rows[1, 1][0] == rows[2, 1][0] == 1 and rows[3, 2][1]
    assert rows.get((4, 0), (0,))[0] < 1  # a name became two


def test_windows_of_few_literals_match_verbatim(spark):
    names = "Anna, Bert, Carl, Dora and Emil"
    docs = ["so 12 14 16 it is", "so 12 14 17 it is", f"with {names} there", "with Anna, Bert, Carl, Dora and Otto there"]
    rows = leaks_of(spark, ["12 14 16", f"for {names}"], [*docs, f"for {names}"])
    assert rows[0, 0] == (1, True) and rows[4, 1] == (1, True)
    assert set(rows) == {(0, 0), (4, 1)}
    # a question with other values stays found by its templates, however many numbers follow
    item = "we count the apples of the old tree: " + " ".join(map(str, range(40)))
    assert leaks_of(spark, [item], [item.replace("3", "7 ")])[0, 0][0] >= 0.3


def test_windows_hashed_once_equal_those_of_each_form(documents):
    cut, sums = dec.Templates(), dec._Sums()
    texts = [r.text.encode() for r in documents.limit(80).collect()] + [b"", b"Tom", b"Tom Ann 12 km 3. Bob said Eve 4"]
    codes, kinds, values, starts, doc = cut.read_all(texts)
    first = np.searchsorted(doc, np.arange(len(texts)))
    for size in (1, 3, 8):
        at = np.arange(len(codes) - size + 1)
        at = at[doc[at] == doc[at + size - 1]]
        got = dec._form_windows(sums, kinds, values, starts, at, size)
        for i, text in enumerate(texts):
            own = dec.Templates().read(text.decode())
            here = at[doc[at] == i]
            assert (here - first[i] == np.arange(max(0, len(own[0]) - size + 1))).all()
            for form in dec.FORMS:
                form_kinds, hashes = dec._as_form(*own[1:], form)
                want, _ = dec._windows(form_kinds, hashes, own[2], size)
                assert (got[form][doc[at] == i] == want).all()
