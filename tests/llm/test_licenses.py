import math
from collections import Counter

from tidewise.llm import licenses

MIT = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"


def brute_score(notice):
    rows, idf, unseen = licenses.template_weights()
    w = {t: n * idf.get(t, unseen) for t, n in Counter(licenses._terms(notice)).items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    dots = Counter()
    for name, template, term, weight in rows:
        dots[name, template] += w.get(term, 0) * weight
    return min(((-round(min(d / norm, 1), 9), name) for (name, _), d in dots.items()), default=None)


def test_inheritance(spark):
    files = [(1, "a/LICENSE", MIT), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/y.py", "# SPDX-License-Identifier: Apache-2.0\ncode"),
             (4, "z/x.py", "no"), (5, "a/b/COPYING", "GNU General Public License Version 3"), (6, None, None), (7, "ab/x", "q"), (8, "a/x.py", ""), (9, "a/LICENSE", None)]
    got = {r.file: (r.license, r.how, r.from_dir) for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: (None, None, None),
                   5: ("GPL-3.0", "own", None), 6: (None, None, None), 7: (None, None, None), 8: ("MIT", "inherited", "a"), 9: ("MIT", "inherited", "a")}


def test_root_license(spark):
    files = [(1, "LICENSE", MIT), (2, "x/y/z", "q"), (3, "w", "q"), (3, "w", "q")]
    got = sorted((r.file, r.license, r.from_dir) for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect())
    assert got == [(1, "MIT", None), (2, "MIT", ""), (3, "MIT", ""), (3, "MIT", "")] or [g[:2] for g in got] == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (3, "MIT")]


def test_scores_equal_brute_force(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "this licence is not one of the known ones at all, really", "Released under the MIT License. Enjoy it.", "Copyright 2020 Someone. All rights reserved.", "public domain"]
    table = spark.createDataFrame([(i, f"d/{i}", f"text before\n{x}\ntext after") for i, x in enumerate(lines)], "file long, path string, text string")
    got = {r.file: (r.license, r.score) for r in licenses.scan(table).collect()}
    for i, x in enumerate(lines):
        score, name = min(brute_score(x), brute_score(f"text before\n{x}\ntext after"))
        want = (name, -score) if -score >= licenses.THRESHOLD else (None, None)
        assert got[i][0] == want[0] and (want[1] is None or abs(got[i][1] - want[1]) < 1e-8)


def test_edge_cases(edge_docs, no_docs):
    as_files = lambda t: t.selectExpr("doc_id as file", "source as path", "text", "*")
    assert licenses.scan(as_files(edge_docs).drop("text").withColumnRenamed("source", "text")).count() == edge_docs.count()
    assert licenses.scan(edge_docs.selectExpr("doc_id as file", "source as path", "text", "digest", "row")).count() == edge_docs.count()
    assert licenses.scan(no_docs.selectExpr("doc_id as file", "source as path", "text")).count() == 0


def test_variants_and_versions(spark):
    """Each notice has its licence, or none if that has no template or it names several."""
    want = {"Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "CC BY-ND 4.0": "CC-BY-ND-4.0", "CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0",
            "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.": "CC-BY-NC-ND-3.0",
            "BSD 2-Clause": "BSD-2-Clause", "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "BSD 4-Clause License": None,
            "GNU Affero General Public License, version 3": "AGPL-3.0", "GNU Lesser General Public License, version 2.1": "LGPL-2.1", "GNU Library General Public License, version 2": "LGPL-2.0",
            "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "GPLv3": "GPL-3.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
            "Eclipse Public License, version 2.0": "EPL-2.0", "SPDX-License-Identifier: ISC": "ISC", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
            "Apache-2.0": "Apache-2.0", "MIT": "MIT", "mit": None, "SPDX-License-Identifier: OFL-1.1": None, "Licensed under MIT or Apache-2.0": None, "MIT No Attribution License": None,
            licenses.BSD: "BSD-2-Clause", licenses.BSD + "\n" + licenses.NEITHER: None}
    texts = list(want)
    table = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], "file long, path string, text string")
    got = {texts[r.file]: r.license for r in licenses.scan(table).collect()}
    assert got == want
