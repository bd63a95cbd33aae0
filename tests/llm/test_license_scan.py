import random
import re

from cloakframe.llm import license_scan as scans
from cloakframe.llm.license_scan import BASE, rules, scan


def brute(text):
    """Rows by definition: every rule on every text, without keywords, and suppression pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + " ".join(words) + " " if words else ""
    at = lambda i: line[:i].count(" ")
    found = []
    for n, r in enumerate(rules()):
        found += [(at(m.start()), at(m.end()), r.priority, n) for m in re.finditer(f" (?:{r.pattern})(?= )", line)]
    beats = lambda c, x: c[0] <= x[0] and c[1] >= x[1] and (c[2] > x[2] or c[2] == x[2] and (c[1] - c[0] > x[1] - x[0] or c[1] - c[0] == x[1] - x[0] and c[3] < x[3]))
    stay = sorted(x for x in found if not any(beats(c, x) for c in found))
    base = sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels = {label for _, label in base}
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {rules()[n].label for *_, n in stay})), [(rules()[n].label, p, a, b) for a, b, p, n in stay]


TEXTS = [
    "Released under the MIT License. Copyright (c) 2020", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "This work is licensed under CC BY-NC-SA 4.0 International; see https://creativecommons.org/licenses/by-nc-sa/4.0/", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published",
    "dual licensed: MIT license and Apache license version 2, cc by nc, cc by-nc under the mit license", "gnu.org/licenses/gpl-3.0.html or www.gnu.org/licenses/old-licenses/lgpl-2.1", "Mozilla Public License, v. 2.0; EPL-2.0; BSD 3-Clause license", None, "", "  \t", "permitted submitters emit limits",
    "Creative Commons Attribution-NonCommercial 4.0 International License and Creative Commons Attribution 4.0", "All Rights Reserved. Proprietary and confidential. GNU General Public License, version 3 or any later version", "été MIT license 你好 under the mit license",
]


def test_against_brute_force(spark):
    r = random.Random(1)
    pieces = [t for t in TEXTS if t and t.strip()] + ["the", "and so on.", "license", "version 2.0", "GPL", "bsd"]
    texts = TEXTS + [" ".join(r.choices(pieces, k=r.randint(1, 6))) for _ in range(60)] + ["x " * 30_000 + "under the MIT license " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in scan(df).collect():
        want = brute(texts[row.doc_id])
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels) == want[:6], texts[row.doc_id]
        assert [tuple(d) for d in row.detections] == want[6]
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)


def test_rules_are_many_sound_and_hold_their_keywords(spark):
    table = rules()
    assert len(table) > 300 and len({r.label for r in table}) > 100
    for r in table:
        re.compile(r.pattern)
        assert not re.search(r"^ | $|  ", r.pattern) and r.keyword == r.keyword.strip().lower()
    # without the prefilter nothing more is found
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    free = tuple(scans.Rule(r.label, t, r.pattern, r.priority) for r in table for t in ("",))
    assert [r.detections for r in scan(df, table=free).orderBy("doc_id").collect()] == [r.detections for r in scan(df).orderBy("doc_id").collect()]


def test_priority_and_containment(spark):
    table = tuple(scans.Rule(a, k, p, n) for a, k, p, n in [("long-low", "one", "one two three", 40), ("short-high", "two", "two", 100), ("short-low", "two", "two three", 40), ("same", "two", "two", 100), ("next", "three", "three four", 60)])
    df = spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string")
    got = [(d.label, d.first, d.next) for d in scan(df, table=table).first().detections]
    assert got == [("long-low", 1, 4), ("short-high", 2, 3), ("next", 3, 5)]


def test_edges(spark, edge_docs, empty_docs):
    out = scan(edge_docs)
    assert out.count() == 12 and out.columns[: len([c for c in edge_docs.columns if c.lower() not in scans.OURS])][0] == "doc_id"
    assert scan(empty_docs).count() == 0
