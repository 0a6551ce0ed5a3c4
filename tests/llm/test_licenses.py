"""License inheritance over nested directories, against the rule applied path by path."""

import re

from casewright.llm import licenses

GRANT = {"MIT": "Released under the MIT License", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3", "CC0-1.0": "Licensed under CC0 1.0", "Apache-2.0": "Licensed under the Apache License, Version 2.0"}
FILES = [
    ("LICENSE", "MIT"), ("readme", None), ("a/x.py", None), ("a/b/COPYING.txt", "GPL-3.0"), ("a/b/x.py", None), ("a/b/c/d/x.py", None), ("a/b/c/own.py", "Apache-2.0"), ("a/b/c/LICENSE-none", None),
    ("a/bc/x.py", None), ("a/b2/LICENCE", "CC0-1.0"), ("a/b2/c/x.py", None), ("a/b2/c/unlicense", "Apache-2.0"), ("a/license.d/x.py", None), ("a/notlicense", "CC0-1.0"), ("/r/x.py", None), ("/r/LICENSE.md", "GPL-3.0"), ("/r/s/t/x.py", None), ("", None),
]


def brute(files):
    given = {p.rpartition("/")[0]: name for p, name in files if name and re.match(licenses.LICENSE_FILE, p.rpartition("/")[2])}
    out = {}
    for path, name in files:
        above = path.rpartition("/")[0]
        while above not in given and above:
            above = above.rpartition("/")[0]
        out[path] = (name, "own") if name else (given[above], "inherited") if above in given else (None, "none")
    return out


def scanned(spark, files):
    rows = [(k, p, GRANT[name] + "." if name else "plain words") for k, (p, name) in enumerate(files)]
    return {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}


def test_nearest_directory_above_gives_its_license(spark):
    want = brute(FILES)
    assert {o for _, o in want.values()} == {"own", "inherited"} and want["a/b/c/d/x.py"] == ("GPL-3.0", "inherited") and want["a/bc/x.py"] == ("MIT", "inherited")
    assert scanned(spark, FILES) == want


def test_without_a_file_at_the_root_some_have_none(spark):
    want = brute(FILES[1:])
    assert {o for _, o in want.values()} == {"own", "inherited", "none"}
    assert scanned(spark, FILES[1:]) == want


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Doe. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD2_FILE = """Copyright (c) 2019, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
BSD3_FILE = BSD2_FILE + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """# Copyright 2021 The Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
import os
"""
GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {}
"""
TEXTS = {
    MIT_FILE: "MIT", BSD2_FILE: "BSD-2-Clause", BSD3_FILE: "BSD-3-Clause", APACHE_HEADER: "Apache-2.0", GPL_HEADER: "GPL-3.0", GPL_HEADER.replace("version 3", "version 2").replace("software:", "software;"): "GPL-2.0",
    "// SPDX-License-Identifier: MIT\nx = 1": "MIT", "Copyright 2020 X. All rights reserved.": "Proprietary", "Some prose.\nReleased under the MIT License\nMore prose that goes on": "MIT",
    "we spoke of the license with him, mit Freude, by the name of law": None, "": None,
}


def test_license_texts_and_headers(spark):
    rows = [(k, f"d{k}/LICENSE" if k < 3 else f"d{k}/x.py", t) for k, t in enumerate(TEXTS)]
    got = {r.file_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert list(TEXTS.values()) == [got[k] for k in range(len(TEXTS))]


def test_no_passage_that_reaches_the_threshold_is_left_out():
    """Cues and the bound on passages against the cosine itself, on random passages."""
    import math
    import random
    from collections import Counter

    rows, idf, unknown = licenses.template_weights(licenses.TEMPLATES)
    weights = {}
    for t, term, w in rows:
        weights.setdefault(t, {})[term] = w
    held, rng = set(licenses.cues(licenses.TEMPLATES)), random.Random(3)
    ratio = 0.36 / 0.64 * unknown**2 / max(idf.values()) ** 2 * 0.99
    hits = 0
    for _ in range(3000):
        body = [w for w in licenses.terms_of(" ".join(rng.choice(licenses.TEMPLATES[rng.choice(list(licenses.TEMPLATES))]) for _ in range(rng.randint(1, 2)))) if rng.random() < 0.7]
        body += [f"zz{rng.randint(0, 30)}" for _ in range(rng.randint(0, 8))]
        tf = Counter(body)
        norm = math.sqrt(sum((n * idf.get(t, unknown)) ** 2 for t, n in tf.items()))
        best = max((sum(n * idf.get(t, unknown) * w.get(t, 0) for t, n in tf.items()) / norm for w in weights.values()), default=0) if norm else 0
        if best >= licenses.THRESHOLD:
            hits += 1
            known = sum(n for t, n in tf.items() if t in idf)
            assert held & tf.keys() and known**2 >= ratio * sum(t not in idf for t in tf)
    assert hits > 500
