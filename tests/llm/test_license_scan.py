import math
import re
from collections import Counter

from seqengine.llm.license_scan import SPEAKS, TEMPLATES, corpus_paths, scan_licenses

FILES = [
    ("/r/LICENSE", "Released under the MIT License."),
    ("/r/a.txt", "nothing here"),
    ("/r/p/COPYING.md", "This work is licensed under the GNU General Public License, version 3."),
    ("/r/p/b.txt", "first line\nLicensed under the Apache License, Version 2.0. And more."),
    ("/r/p/q/c.txt", None),
    ("/r/p/q/d.txt", "We had a licence to fish in the river, he said, and the public liked it."),
    ("/s/e.txt", ""),
    ("/s/f.txt", "x" * 5000 + "\nLicensed under CC BY-NC 4.0.\n" + "y " * 5000),
    (None, "Released under the MIT License."),
    ("/r/a.txt", "nothing here"),
]


def test_inheritance(spark):
    files = spark.createDataFrame([(i, p, t, "own") for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string, license string")
    found = {r.doc_id: (r.own_license, r.license, r.from_dir) for r in scan_licenses(files).collect()}
    assert found[0] == ("MIT", "MIT", None) and found[1] == (None, "MIT", "/r") and found[9] == found[1]
    assert found[2] == ("GPL-3.0", "GPL-3.0", None) and found[3] == ("Apache-2.0", "Apache-2.0", None)
    assert found[4] == (None, "GPL-3.0", "/r/p") and found[5] == (None, "GPL-3.0", "/r/p")
    assert found[6] == (None, None, None) and found[7][0] == "CC-BY-NC-4.0" and found[8][0] == "MIT"
    assert scan_licenses(files.limit(0)).isEmpty()


def test_scores_like_brute_force(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string")
    # sentences and blocks of each file; the one of file 7 is not compared with a longer block, as lines and blocks with the word count too
    said = []
    for path, text in FILES:
        text = text or ""
        joined = " ".join(text.split())
        own = {joined, *text.split("\n")}
        own |= {s for x in list(own) for s in re.sub("([.;!?]) ", "\\1\n", x).split("\n")}
        said += [s for s in own if re.search(SPEAKS, s, re.IGNORECASE)]
    everything = said + [t for _, t in TEMPLATES]
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    df = Counter(w for s in everything for w in set(words(s)))
    weigh = lambda t: {w: n * (math.log((1 + len(everything)) / (1 + df[w])) + 1) for w, n in Counter(words(t)).items()}

    def cosine(a, b):
        a, b = weigh(a), weigh(b)
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    scores = {r.doc_id: r.own_score for r in scan_licenses(files).filter("own_score is not null").collect()}
    of = {0: FILES[0][1], 2: FILES[2][1], 3: "Licensed under the Apache License, Version 2.0.", 7: "Licensed under CC BY-NC 4.0.", 8: FILES[8][1]}
    assert set(scores) == set(of)
    for i, s in of.items():
        assert abs(scores[i] - max(cosine(s, t) for _, t in TEMPLATES)) < 1e-5


WRAPPED = {
    "gpl.py": (
        "GPL-3.0",
        """#!/usr/bin/env python
# frob -- does things
# Copyright (C) 2019 A. Person
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.

import os
""",
    ),
    "bsd/LICENSE": (
        "BSD-3-Clause",
        """Copyright (c) 2011, Some People
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.
    * Neither the name of the organization nor the
      names of its contributors may be used to endorse or promote products
      derived from this software without specific prior written permission.
""",
    ),
    "isc/LICENSE": (
        "ISC",
        """Copyright 2015 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.
""",
    ),
    "apache/LICENSE": (
        "Apache-2.0",
        """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
""",
    ),
    "apache.java": (
        "Apache-2.0",
        """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *      http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
package a;
""",
    ),
    "mit/LICENSE": (
        "MIT",
        """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
""",
    ),
    "mpl.c": (
        "MPL-2.0",
        """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
""",
    ),
    "none.md": (None, "Released under the Foo Licence of 1999.\n\nA licence to kill, and a copyright on nothing."),
}


def test_headers_and_files(spark):
    """Wrapped and commented texts as they are usually found."""
    files = spark.createDataFrame([(f"/{path}", text) for path, (_, text) in WRAPPED.items()], "path string, text string").selectExpr("1L as doc_id", "path", "text")
    found = {r.path[1:]: r.own_license for r in scan_licenses(files).collect()}
    assert found == {path: name for path, (name, _) in WRAPPED.items()}


def test_ties_and_files_of_a_directory(spark):
    """Two licence files of a directory: the greatest cosine, then the first name; equal templates: the first name."""
    notice = "Some wording that grants a licence to whoever reads it"
    files = [("/d/LICENSE", notice), ("/d/COPYING", notice + " or not quite so much"), ("/d/x", "own"), ("/d/x", "own"), ("x", None), (None, None)]
    files = spark.createDataFrame(files, "path string, text string").selectExpr("2L as doc_id", "path", "text", "'z' as license", "'y' as uid", "0 as key")
    found = scan_licenses(files, templates=[("Z", notice), ("B", notice), ("C", notice + " or not quite so much")]).collect()
    assert sorted(((r.path or "", r.license, r.from_dir) for r in found), key=str) == sorted([("/d/LICENSE", "B", None), ("/d/COPYING", "C", None), ("/d/x", "B", "/d"), ("/d/x", "B", "/d"), ("x", None, None), ("", None, None)], key=str)


def test_templates_are_compared(spark):
    assert all(re.search(SPEAKS, text, re.IGNORECASE) for _, text in TEMPLATES)


def test_paths(docs_of):
    rows = {r.doc_id: r.path for r in corpus_paths(docs_of([(0, ""), (50, ""), (1051, ""), (None, "")])).collect()}
    assert rows == {0: "/corpus/0/LICENSE", 50: "/corpus/0/1/LICENSE", 1051: "/corpus/1/21/1051.txt", None: None}
