import math
import re
from collections import Counter

from docspark.llm import licences, queries


def cosine_scan(files, templates, least):
    """Best licence of each path by plain TF-IDF cosines of all lines and blocks."""
    terms = lambda x: re.findall("[a-z0-9]+", x.lower())
    texts = [t for _, t in files if t is not None]
    n, df = len(texts), Counter(w for t in texts for w in set(terms(t)))
    known = {w for _, t in templates for w in terms(t)}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in known else 0))) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(terms(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(licence, vector(t)) for licence, t in templates]
    best = {}
    for path, text in files:
        for unit in set((text or "").split("\n")) | set(re.split(r"\n[ \t]*\n", text or "")):
            v = vector(unit)
            for licence, t in vectors:
                shared = sum(v[w] * t[w] for w in v.keys() & t.keys())
                if shared and (score := round(shared / norm(v) / norm(t), 9)) >= least:
                    best[path] = min(best.get(path, (0, "")), (-score, licence))
    return {p: (licence, -minus) for p, (minus, licence) in best.items()}


def test_own_licences_equal_brute_force(spark, documents):
    rows = [(f"d/{r.doc_id}", r.text) for r in documents.collect()]
    rows += [
        ("x/1", "Released under the  MIT license!"),
        ("x/2", "some words\nLicensed under the Apache License,\nVersion 2.0\n\nmore words here"),
        ("x/3", "the license of the and version"),
        ("x/4", licences.TEMPLATES[5][1]),
        ("x/5", "all rights"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    found = licences.own_licences(files, licences.default_templates(spark)).collect()
    want = cosine_scan(rows, licences.TEMPLATES, licences.LEAST_COSINE)
    assert {r.path: r.licence for r in found} == {p: licence for p, (licence, _) in want.items()}
    assert all(abs(r.score - want[r.path][1]) < 1e-6 for r in found)
    assert {"x/1", "x/2", "x/4"} <= want.keys()


def test_nearest_directory_gives_the_licence(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0", "Released under the MIT License"
    rows = [
        ("LICENSE", apache),
        ("a/LICENSE.txt", mit),
        ("a/b/c/code.py", "nothing"),
        ("a/own.py", apache),
        ("top.py", None),
        ("d/e/f.py", ""),
        ("ab/x.py", "nothing"),
        ("g/licenses.py", mit),
        ("g/h.py", "nothing"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    found = {r.path: (r.own_licence, r.licence, r.licence_from) for r in licences.scan(files).collect()}
    assert found["a/b/c/code.py"] == (None, "MIT", "a")
    assert found["a/own.py"] == ("Apache-2.0", "Apache-2.0", None)
    assert found["top.py"] == found["d/e/f.py"] == found["ab/x.py"] == (None, "Apache-2.0", "")
    assert found["g/h.py"] == (None, "Apache-2.0", "")


def test_odd_rows(spark, odd_docs, no_docs):
    files = odd_docs.selectExpr("*", "CAST(doc_id AS STRING) AS path", "'x' AS licence", "'y' AS norm", "'z' AS unit")
    rows = licences.scan(files).collect()
    assert len(rows) == files.count() and all(r.licence is None for r in rows)
    twice = spark.createDataFrame([("p/COPYING", "All rights reserved")] * 2 + [("p/q", None)], "path string, text string")
    assert sorted((r.path, r.licence) for r in licences.scan(twice).collect()) == [
        ("p/COPYING", "reserved"),
        ("p/COPYING", "reserved"),
        ("p/q", "reserved"),
    ]
    assert licences.scan(no_docs.selectExpr("'p' AS path", "text")).count() == 0


def test_no_python_on_the_executors(spark, documents):
    files = documents.selectExpr("CAST(doc_id AS STRING) AS path", "text")
    plan = licences.scan(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_licence_files_as_a_whole(spark):
    mit = licences.FULL_TEXTS[0][1]
    wrapped = "Copyright (c) 2020 Somebody\n\n" + "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    rows = [(f"{name.lower()}/LICENSE", f"Copyright 2021 Somebody Else\n{text}") for name, text in licences.FULL_TEXTS]
    rows += [("w/COPYING.txt", mit.replace(". ", ".\n\n")), ("w/a.c", ""), ("v/readme", wrapped), ("u/LICENSE", "word " * 200)]
    files = spark.createDataFrame(rows, "path string, text string")
    found = {r.path: r for r in licences.scan(files).collect()}
    for name, _ in licences.FULL_TEXTS:
        assert found[f"{name.lower()}/LICENSE"].licence == name
    assert found["w/COPYING.txt"].licence == found["w/a.c"].licence == "MIT" and found["w/a.c"].licence_from == "w"
    assert found["u/LICENSE"].licence is None
    for name, text in (("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later")):
        one = spark.createDataFrame([("p/x", text)], "path string, text string")
        assert licences.scan(one).first().own_licence == name


def test_whole_texts_equal_brute_force(spark, documents):
    rows = [(f"f{r.doc_id}/LICENSE", r.text) for r in documents.limit(60).collect()]
    rows += [(f"g/{i}-NOTICE", text[: 300 + 200 * i]) for i, (_, text) in enumerate(licences.FULL_TEXTS)]
    rows = [(p if "NOTICE" not in p else f"g{p[2]}/NOTICE", t.replace("\n", " ")) for p, t in rows]
    files = spark.createDataFrame(rows, "path string, text string")
    found = licences.whole_files(files, licences._templates(spark, licences.FULL_TEXTS)).collect()
    want = cosine_scan(rows, licences.FULL_TEXTS, licences.LEAST_COSINE)
    assert {r.path: (r.licence, round(r.score, 6)) for r in found} == {p: (n, round(x, 6)) for p, (n, x) in want.items()} != {}


def test_inheritance_over_three_levels_of_the_whole_table(spark):
    rows = queries.op4_licences(spark, "/root/testdata/sf0.01").collect()
    best = {}
    for r in rows:
        folder, _, name = r.path.rpartition("/")
        if name.startswith("LICENSE") and r.own_licence:
            best[folder] = min(best.get(folder, (0, "")), (-r.score, r.own_licence))
    depths = Counter()
    for r in rows:
        folder, want = r.path.rpartition("/")[0], (None, None)
        while r.own_licence is None and folder:
            if folder in best:
                want = best[folder][1], folder
                depths[folder.count("/")] += 1
                break
            folder = folder.rpartition("/")[0]
        assert (r.licence, r.licence_from) == ((r.own_licence, None) if r.own_licence else want)
    assert len(rows) == 1000 and set(depths) == {0, 1, 2}
