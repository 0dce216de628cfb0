"""Licence scan: headers and licence files against templates, then inheritance
from the nearest ancestor directory (operator 3).

A file's notices are its lines that speak of licences, and its paragraphs (lines
up to a blank one) that do; a licence file (by name, such as LICENSE or
COPYING) is compared as a whole as well. Each is a sparse TF-IDF vector; its
cosine with every template is a join on terms with the templates' weights (a
fixed table of a few hundred rows, broadcast) and a sum. A file's licence is
that of its best notice with a cosine of THRESHOLD or more. Names, variants and
versions (``tells``) must be the same in a notice and its template, so a notice
of a licence that has no template, or of several, is no match.

A directory's licence is that of its licence files. A file without a licence of
its own inherits from its nearest ancestor directory that has one: directories
are expanded to their ancestors (the distinct directories, not the files) and
joined with the licensed ones by path; files then join their own directory.
That join is salted over SALT parts, so a directory that holds a third of the
files is spread.

Terms that no template has count in a notice's length with the largest inverse
frequency, so a long text with a few licence words is no match.

Defined results: null texts have no notice; files without a path inherit
nothing; repeated rows get equal results; of equally good matches the smaller
licence name wins. An empty table gives an empty table. Other columns play no
part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

THRESHOLD, SALT = 0.5, 16

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _versions(full: str, short: str, version: str) -> list[str]:
    return [f"Licensed under the {full}, version {version}.", f"{full} - v {version}", f"Licensed under the {full} {version}.", f"{short} {version}"]


def _gnu(full: str, short: str, version: str) -> list[str]:
    """Notices of a version, "3" or "3.0"; the short name is one word with its v."""
    both = [version] if "." in version else [version, version + ".0"]
    found = [f"This program is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {version} of the License"]
    for v in both:
        found += [f"This work is licensed under the {full}, version {v}.", f"{full} Version {v}", f"Licensed under the {short} {v}.", f"Licensed under the {short}v{v}.", f"{short} {v}", f"{short}v{v}",
                  f"SPDX-License-Identifier: {short}-{v}"]
    return found


def _creative(short: str, full: str, version: str) -> list[str]:
    port = {"4.0": "International", "3.0": "Unported"}.get(version, "Generic")
    found = [f"Licensed under CC {short} {version}.", f"CC {short} {version}"]
    for name in {full, full.replace("NoDerivatives", "NoDerivs")}:
        found += [f"This work is licensed under a Creative Commons {name} {version} {port} License.", f"Creative Commons {name} {version}"]
    return sorted(found)


#: Short notices by licence: what headers and licence files say of themselves.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "Apache License Version 2.0 Terms and conditions for use, reproduction, and distribution"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Simplified BSD License", BSD, BSD.replace("1.", "").replace("2.", "")],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license",
                     BSD.replace("THIS", "3. " + NEITHER + " THIS"), BSD.replace("1.", "").replace("2.", "").replace("THIS", NEITHER + " THIS")],
    "ISC": ["Licensed under the ISC License.", "ISC License (ISC)",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSL-1.0": ["Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "EPL-1.0": _versions("Eclipse Public License", "EPL", "1.0"),
    "EPL-2.0": _versions("Eclipse Public License", "EPL", "2.0"),
    "GPL-3.0": [*_gnu("GNU General Public License", "GPL", "3"), "GNU General Public License Version 3"],
    "GPL-2.0": [*_gnu("GNU General Public License", "GPL", "2"), "GNU General Public License Version 2"],
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "LGPL", "3"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "LGPL", "2.1"),
    "LGPL-2.0": _gnu("GNU Library General Public License", "LGPL", "2"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "AGPL", "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", *_versions("Mozilla Public License", "MPL", "2.0")],
    "MPL-1.1": _versions("Mozilla Public License", "MPL", "1.1"),
    **{f"CC-{short}-{v}": _creative(short, full, v) for short, full in CREATIVE.items() for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}

# its identifier alone, and as SPDX writes it
for _name, _texts in TEMPLATES.items():
    if _name != "Proprietary":
        _texts += [t for t in (_name, f"SPDX-License-Identifier: {_name}") if t not in _texts]

#: Names of licences that are no common words.
NAMES = ("apache", "bsd", "gnu", "gpl", "gplv", "lgpl", "lgplv", "agpl", "agplv", "mpl", "epl", "isc", "bsl", "cc0", "unlicense", "mozilla", "eclipse")
#: Terms that tell licences and their variants apart, besides versions; some
#: belong to licences without a template.
TELLING = {*NAMES, "mit", "boost", "organization", "cc", "creative", "commons", "attribution", "sa", "sharealike", "nc", "noncommercial", "nd", "noderivatives", "noderivs",
           "lesser", "affero", "library general", "clause", "simplified", "clear", "style", "neither", "retain", "merchantability", "fee", "advertising", "exception", "exceptions",
           "proprietary", "ofl", "sil", "artistic", "zlib", "cddl", "eupl", "edl", "wtfpl", "php", "postgresql", "psf", "sspl", "osl", "afl", "gfdl", "fdl"}
VERSION = r"[0-9](\.[0-9]+)*"

#: What a line must hold to be looked at.
CUE = (r"(?im)licen[sc]|copyright|copying|all rights reserved|permission is hereby|permission to use|redistribution and use|public domain|free software|creative commons"
       r"|\bcc[ -]by\b|^\W*(?-i:MIT)\W*$|\b(?:" + "|".join(n + "[0-9]" if n.endswith("v") else n + r"\b" for n in NAMES) + ")")
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
WORD = r"cc0|library general|[a-z]+|[0-9]+(?:\.[0-9]+)*"


def _terms(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def tells(term: str) -> bool:
    """Whether a term is part of a licence's name, variant or version."""
    return term in TELLING or re.fullmatch(VERSION, term) is not None


def template_weights() -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, template, term, weight) of unit length, the terms' inverse
    frequencies, and that of a term that no template has."""
    texts = [(name, t) for name, texts in TEMPLATES.items() for t in texts]
    df = Counter(term for _, t in texts for term in set(_terms(t)))
    unseen = math.log(len(texts) + 1) + 1
    idf = {term: math.log((len(texts) + 1) / (n + 1)) + 1 for term, n in df.items()}
    rows = []
    for i, (name, t) in enumerate(texts):
        weight = {term: n * idf[term] for term, n in Counter(_terms(t)).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rows += [(name, i, term, w / norm) for term, w in weight.items()]
    return rows, idf, unseen


def notices(files: DataFrame) -> DataFrame:
    """file, notice (text): lines and paragraphs that speak of licences, and
    whole licence files."""
    text = F.col("text").cast("string")
    some = files.filter(text.rlike(CUE) | F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))).select("file", "path", text.alias("text"))
    cue = lambda x: x.rlike(CUE)
    lines = F.filter(F.split("text", r"\r?\n"), cue)
    paragraphs = F.filter(F.split("text", r"\r?\n[ \t]*\r?\n"), cue)
    whole = F.when(F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)), F.array("text")).otherwise(F.array().cast("array<string>"))
    return some.select("file", F.explode(F.array_distinct(F.concat(lines, paragraphs, whole))).alias("notice"))


def matches(spark: SparkSession, found: DataFrame) -> DataFrame:
    """file, license, score: the best template of any of its notices."""
    rows, idf, unseen = template_weights()
    named: dict[int, list[str]] = {}
    for _, i, term, _ in rows:
        named.setdefault(i, []).extend([term] if tells(term) else [])
    rows = [(*row, " ".join(sorted(named[row[1]]))) for row in rows]
    weights = spark.createDataFrame(rows, "license string, template int, term string, weight double, names string")
    terms = spark.createDataFrame(list(idf.items()), "term string, idf double")
    # equal notices once; from here on a notice is its digest, not its text
    texts = found.withColumn("h", F.md5(F.col("notice").cast("binary"))).dropDuplicates(["h"])
    counts = texts.select("h", F.explode(F.regexp_extract_all(F.lower("notice"), F.lit(WORD), 0)).alias("term")).groupBy("h", "term").agg(F.count("*").alias("tf"))
    counts = counts.join(F.broadcast(terms), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    telling = F.col("term").isin(sorted(TELLING)) | F.col("term").rlike(f"^{VERSION}$")
    names = F.array_join(F.array_sort(F.collect_set(F.when(telling, F.col("term")))), " ").alias("names")
    norms = counts.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), names)
    dots = counts.join(F.broadcast(weights), "term").groupBy("h", "license", "template", "names").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.join(norms, ["h", "names"]).withColumn("score", F.round(F.least(F.col("dot") / F.col("norm"), F.lit(1.0)), 9)).filter(F.col("score") >= THRESHOLD)
    first = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    best = best.groupBy("h").agg(first).select("h", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))
    return found.select("file", F.md5(F.col("notice").cast("binary")).alias("h")).join(best, "h").groupBy("file").agg(first.alias("best")).select("file", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def _directory(path: Column) -> Column:
    """The directory of a path, the root being the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """file, license, how ('own', 'inherited' or null), score, from_dir of each
    row of ``files`` (file, path, text)."""
    spark = files.sparkSession
    named = files.select("file", F.col("path").cast("string").alias("path"), "text").withColumn("row", F.monotonically_increasing_id())
    kept = stored(named.select("row", "file", "path", F.when(F.col("text").cast("string").rlike(CUE) | F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)), F.col("text")).alias("text")), "license-files")
    own = stored(matches(spark, notices(kept.select(F.col("row").alias("file"), "path", "text"))), "license-matches")
    own = own.withColumnRenamed("file", "row")
    rows = kept.select("row", "file", "path", _directory(F.col("path")).alias("dir"))
    first = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    licensed = rows.filter(F.col("path").rlike(LICENSE_FILE)).join(own, "row").groupBy("dir").agg(first.alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    dirs = rows.filter("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.array_distinct(steps)).alias("from_dir")).join(licensed, "from_dir")
    nearest = above.groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "license", "score")).alias("n"))
    salted = nearest.select(F.col("dir").alias("d"), F.col("n.from_dir").alias("from_dir"), F.col("n.license").alias("dir_license"), F.col("n.score").alias("dir_score"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt_d"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    rows = rows.join(salted, (F.col("dir") == F.col("d")) & (F.col("salt") == F.col("salt_d")), "left").join(own, "row", "left")
    mine = F.col("license").isNotNull()
    return rows.select("file", F.coalesce("license", "dir_license").alias("license"),
                       F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("how"),
                       F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
                       F.when(~mine, F.col("from_dir")).alias("from_dir"))
