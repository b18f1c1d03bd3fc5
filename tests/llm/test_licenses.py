import re

from pyspark.sql import functions as F

from tablewise.llm import licenses as L

from .conftest import rows_of_documents

TEXTS = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU GENERAL\npublic---license; gnu general public license gnu general public license", "Not licensed under the MIT license", "mit license mit license mit license",
    "SPDX-License-Identifier: GPL-2", "GNU General Public License v2 or (at your option) any later version", "all rights reserved. Copyright (c) 2021", "CC\t/BY", "ccby cc b y",
    "mit license", "the mit licence", "commit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licence: bsd", "I like bsd a lot, license it",
    "Dedicated to the public domain", "Creative Commons Attribution-ShareAlike 4.0 International", "published under the terms of the mozilla public license 1.1", None, "", " .,;\x00 ", "é MIT License ÉÉ cc by",
    "apache license " * 300 + "x", "license " * 2000,
]
PATTERNS = [(n, r, re.compile(r["pattern"])) for n, r in enumerate(L.RULES)]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = []
    for label, phrase in L.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    form = "".join(f" {w} " for w in words)
    found = []
    for n, r, p in PATTERNS:
        for m in p.finditer(form):
            found.append((form[:m.start()].count(" ") // 2, form[:m.end()].count(" ") // 2, r["level"], n, r["label"]))
    kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and (o[0] < d[0] or o[1] > d[1] or o[2:4] < d[2:4]) for o in found if o is not d)]
    named = {d[4] for d in kept if d[4]}
    return (len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted({x for _, x in base} | named)), max((L.CONFIDENCE[d[2]] for d in kept if d[4]), default=0.0))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_against_brute_force(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)]
    got = L.label_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string, words int, base string")).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_edge_rows(docs, no_docs):
    got = sorted((str(r.doc_id), tuple(r[c] for c in COLUMNS)) for r in L.label_licenses(docs).collect())
    assert got == sorted((str(r[0]), brute(r[1])) for r in rows_of_documents())
    assert L.label_licenses(no_docs).count() == 0


def test_labels(spark):
    want = [(TEXTS[0], "mit"), (TEXTS[1], "cc-by,cc-by-nc-4.0"), (TEXTS[2], "apache,apache-2.0"), (TEXTS[3], "gpl,gpl-3"), (TEXTS[5], "mit"), (TEXTS[7], "gpl-2"),
            (TEXTS[8], "gpl,gpl-2-or-later"), (TEXTS[14], ""), (TEXTS[16], "bsd"), (TEXTS[18], "public-domain"), (TEXTS[19], "cc-by-sa-4.0"), (TEXTS[20], "mpl-1.1"),
            ("released under the python software foundation license version 2", "psf-2"), ("nothing of the kind", "")]
    got = L.label_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == [x for _, x in want]


def test_spans(spark):
    got = L.scan(spark.createDataFrame([("a b Licensed under the MIT License now, not licensed under the ISC licence",)], "text string")).first().licenses
    assert [(d.label, d.start, d.stop, d.level) for d in got] == [("mit", 2, 7, 1), ("", 8, 14, 0)]


def test_every_rule_passes_the_gates():
    assert len(L.RULES) > 300
    for r in L.RULES:
        p = r["pattern"]
        # words that a match must hold, as the patterns write them
        seen = p.replace("(?:", "").replace(")", "")
        assert "licen" in p or "  by " in seen and " cc " in seen or any(all(w in seen for w in t.split()) for t in L.TRIGGERS), p
        assert r["keyword"] in p


def test_gate_lets_every_hit_through(spark):
    # without the gate the words are the same: the test of the raw text loses nothing
    rows = [(t,) for t in TEXTS if t]
    d = spark.createDataFrame(rows, "text string").select("text", L._gate(F.col("text")).alias("g"), L.worded(F.col("text")).alias("w"))
    for r in d.collect():
        if not r.g:
            assert not any(p.search(r.w) for _, _, p in PATTERNS), r.text
