"""Licence detection by ordered signature rules (operator 13), DataFrame functions only.

A text is written as its words, each between spaces; rules are regular
expressions over that form. A cheap test of the raw text for trigger strings
comes first, then a rule is tried only if its keyword occurs. Each match is an
interval of words with the level of its rule. An interval inside another one of
a level at least as good is suppressed, so "gnu general public license" inside
"licensed under the gnu general public license version 3" does not count again,
and a denial ("not licensed under ...") hides the grant it holds. Intervals are
sorted by start and longest first, and one pass with the furthest end seen so
far on each level decides. No shuffle; a row's intervals stay in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal

#: Runs of digits, letters and everything beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base rule and their labels.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

# Licences. Label, versions (None: without), names (token patterns; "?" ends an optional token), identifiers.
FAMILIES = [
    ("gpl", [None, "1", "2", "3"], ["gnu? general public licen[cs]e", "gnu gpl", "gpl"], ["gpl"]),
    ("lgpl", [None, "2", "2 1", "3"], ["gnu? (?:lesser|library) general public licen[cs]e", "gnu? lgpl"], ["lgpl"]),
    ("agpl", [None, "1", "3"], ["gnu? affero general public licen[cs]e", "gnu? agpl"], ["agpl"]),
    ("gfdl", [None, "1 1", "1 2", "1 3"], ["gnu? free documentation licen[cs]e"], ["gfdl"]),
    ("apache", [None, "1", "1 1", "2", "2 0"], ["apache software? licen[cs]e"], ["apache"]),
    ("mit", [None], ["mit licen[cs]e", "expat licen[cs]e"], ["mit"]),
    ("isc", [None], ["isc licen[cs]e"], ["isc"]),
    ("bsd", [None], ["(?:revised|modified|simplified|new)? bsd style? licen[cs]e"], ["bsd"]),
    ("bsd-2-clause", [None], ["bsd 2 clause licen[cs]e", "2 clause bsd licen[cs]e"], ["bsd 2 clause"]),
    ("bsd-3-clause", [None], ["bsd 3 clause licen[cs]e", "3 clause bsd licen[cs]e"], ["bsd 3 clause"]),
    ("bsd-4-clause", [None], ["bsd 4 clause licen[cs]e", "4 clause bsd licen[cs]e"], ["bsd 4 clause"]),
    ("0bsd", [None], ["zero clause bsd licen[cs]e"], ["0bsd"]),
    ("mpl", [None, "1 0", "1 1", "2 0"], ["mozilla public licen[cs]e"], ["mpl"]),
    ("epl", [None, "1 0", "2 0"], ["eclipse public licen[cs]e"], ["epl"]),
    ("cddl", [None, "1 0", "1 1"], ["common development and distribution licen[cs]e"], ["cddl"]),
    ("cpl", [None, "1 0"], ["common public licen[cs]e"], ["cpl"]),
    ("eupl", [None, "1 0", "1 1", "1 2"], ["european union public licen[cs]e"], ["eupl"]),
    ("artistic", [None, "1 0", "2 0"], ["artistic licen[cs]e"], ["artistic"]),
    ("bsl", [None, "1 0"], ["boost software licen[cs]e"], ["bsl"]),
    ("busl", [None, "1 1"], ["business source licen[cs]e"], ["busl"]),
    ("zlib", [None], ["zlib licen[cs]e"], ["zlib"]),
    ("psf", [None, "2"], ["python software foundation licen[cs]e"], ["psf"]),
    ("php", [None, "3 0", "3 01"], ["php licen[cs]e"], ["php"]),
    ("ofl", [None, "1 0", "1 1"], ["sil? open font licen[cs]e"], ["ofl"]),
    ("odbl", [None, "1 0"], ["open database licen[cs]e"], ["odbl"]),
    ("odc-by", [None, "1 0"], ["open data commons attribution licen[cs]e"], ["odc by"]),
    ("postgresql", [None], ["postgresql licen[cs]e"], ["postgresql"]),
    ("unlicense", [None], ["the unlicen[cs]e"], ["unlicen[cs]e"]),
    ("wtfpl", [None, "2"], ["do what the fuck you want to public licen[cs]e"], ["wtfpl"]),
    ("ms-pl", [None], ["microsoft public licen[cs]e"], ["ms pl"]),
    ("ms-rl", [None], ["microsoft reciprocal licen[cs]e"], ["ms rl"]),
    ("sspl", [None, "1"], ["server side public licen[cs]e"], ["sspl"]),
    ("elastic", [None, "2 0"], ["elastic licen[cs]e"], ["elastic"]),
    ("vim", [None], ["vim licen[cs]e"], ["vim"]),
    ("openssl", [None], ["openssl licen[cs]e"], ["openssl"]),
    ("cc0", [None, "1 0"], ["cc0", "creative commons zero"], ["cc0"]),
    ("cc-by", [None, "1 0", "2 0", "2 5", "3 0", "4 0"], ["cc by", "creative commons attribution"], ["cc by"]),
    ("cc-by-sa", [None, "1 0", "2 0", "2 5", "3 0", "4 0"], ["cc by sa", "creative commons attribution share ?alike"], ["cc by sa"]),
    ("cc-by-nc", [None, "1 0", "2 0", "2 5", "3 0", "4 0"], ["cc by nc", "creative commons attribution non ?commercial"], ["cc by nc"]),
    ("cc-by-nd", [None, "1 0", "2 0", "2 5", "3 0", "4 0"], ["cc by nd", "creative commons attribution no ?derivatives"], ["cc by nd"]),
    ("cc-by-nc-sa", [None, "1 0", "2 0", "2 5", "3 0", "4 0"], ["cc by nc sa", "creative commons attribution non ?commercial share ?alike"], ["cc by nc sa"]),
    ("cc-by-nc-nd", [None, "1 0", "2 0", "2 5", "3 0", "4 0"], ["cc by nc nd", "creative commons attribution non ?commercial no ?derivatives"], ["cc by nc nd"]),
]

# Texts and notices without a licence's name. Label, pattern.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2.0", "you may not use this file except in compliance with the licen[cs]e"),
    ("public-domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential unauthorized copying"),
    ("copyright", "copyright c? (?:19|20)[0-9][0-9]"),
]

# Licences whose notices often allow later versions.
LATER = {"gpl", "lgpl", "agpl", "gfdl"}
#: Levels, best first, and how sure a match on each of them is: identifier or denial, grant, name with version, name.
CONFIDENCE = [1.0, 0.9, 0.7, 0.5]
#: Every rule holds one of these strings in a word; texts without any of them have no match.
TRIGGERS = ["licen", "spdx", "gpl", "cc0", "creative", "copyright", "permission", "redistribution", "warrant", "public domain", "reserved", "confidential", "free software"]
_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed) (?:under|by) the? terms? of? the?"


def pattern(tokens: str) -> str:
    """Regular expression over " w  w " forms of words: tokens between spaces, each a word's pattern, optional with a "?" at its end."""
    out = []
    for t in tokens.split(" "):
        plain = t[:-1] if t.endswith("?") else t
        out.append(f"(?: (?:{plain}) )?" if t.endswith("?") else f" (?:{plain}) ")
    return "".join(out)


def _tokens(name: str) -> str:
    """A written blank "x ?y" stands for one word or two: share alike, sharealike."""
    words = name.split(" ")
    out = []
    for w in words:
        if w.startswith("?") and out:
            out[-1] = out[-1] + r"(?:\x20\x20)?" + w[1:]
        else:
            out.append(w)
    return " ".join(out)


def _keyword(tokens: str) -> str:
    """The longest run of plain letters in a token that a match must hold, as it stands in the text of words."""
    plain = [t for t in tokens.split(" ") if t.isalnum()]
    return max(plain, key=len, default="licen")


def build_rules() -> list[dict]:
    """All rules in order: keyword, level, label (empty: a denial) and pattern."""
    rules = []

    def add(level: int, label: str, tokens: str, keyword: str):
        rules.append({"keyword": keyword, "level": level, "label": label, "pattern": pattern(tokens)})

    for label, versions, names, ids in FAMILIES:
        for name in map(_tokens, names):
            add(0, "", f"not {_GRANT} {name}", _keyword(name))
    for label, versions, names, ids in FAMILIES:
        for v in sorted(versions, key=lambda x: (x is None, x)):
            full = label if v is None else f"{label}-{v.replace(' ', '.')}"
            number = "" if v is None else f" (?:version|v)? v?{v}"
            for i in ids:
                add(0, full, f"spdx licen[cs]e identifier {i}" + ("" if v is None else f" {v}"), "spdx")
                add(1, full, f"(?:licen[cs]ed|licen[cs]e) (?:under|is)? the? {i}{number}", _keyword(i))
            for name in map(_tokens, names):
                add(1, full, f"{_GRANT} {name}{number} (?:international|unported|generic|licen[cs]e)?", _keyword(name))
                add(2 if v else 3, full, f"{name}{number}", _keyword(name))
                if v and label in LATER:
                    add(1, f"{full}-or-later", f"{name} (?:either|as|published|by|the|free|software|foundation)?{number} of? the? licen[cs]e? or at? your? option? any? (?:later|newer)", _keyword(name))
    for label, tokens in NOTICES:
        add(1, label, tokens, _keyword(tokens))
    return rules


RULES = build_rules()


def worded(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each between two spaces of its own."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NO_WORD, "  ")), F.lit(" "))


def _words(piece: Column) -> Column:
    """Number of words of a piece of a worded text."""
    return ((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("int")


def places(words: Column, regex: Column) -> Column:
    """array(struct(start, stop)): words from start, and below stop, of each match in a worded text."""
    pieces = F.split(words, regex, -1)
    matches = F.regexp_extract_all(words, regex, F.lit(0))
    nothing = F.array().cast("array<struct<start:int,stop:int>>")

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + _words(pair["piece"])
        stop = start + _words(pair["match"])
        return F.struct(stop.alias("at"), F.concat(s["found"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("found"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), nothing.alias("found")), step, lambda s: s["found"])).otherwise(nothing)


def _gate(text: Column) -> Column:
    """Can a text hold any match? Lower-casing beyond ASCII only adds texts here."""
    low = F.lower(text)
    hit = low.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")
    for t in TRIGGERS:
        a, *b = t.split(" ")
        hit = hit | (low.contains(a) & low.contains(b[0]) if b else low.contains(a))
    return hit


def detections(words: Column, rules: list[dict]) -> Column:
    """All matches in a worded text: array of struct(start, back, level, rule, stop, label), by start and longest first."""
    by_word: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        by_word.setdefault(r["keyword"], []).append({"rule": i, "level": r["level"], "label": r["label"], "pattern": r["pattern"]})
    groups = literal([{"keyword": k, "rules": v} for k, v in sorted(by_word.items())], "array<struct<keyword:string,rules:array<struct<rule:int,level:int,label:string,pattern:string>>>>")
    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    found = F.transform(tried, lambda r: F.transform(places(words, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["stop"]).alias("back"), r["level"].alias("level"), r["rule"].alias("rule"), p["stop"].alias("stop"), r["label"].alias("label"))))
    return F.array_sort(F.flatten(found))


def survivors(found: Column) -> Column:
    """Matches that lie in no other one of a level at least as good; of equal intervals on one level the first rule's stays."""
    levels = range(len(CONFIDENCE))
    start = F.struct(*[F.lit(-1).alias(f"t{i}") for i in levels], F.filter(found, lambda d: F.lit(False)).alias("kept"))

    def step(s: Column, d: Column) -> Column:
        reach = F.element_at(F.array(*[s[f"t{i}"] for i in levels]), d["level"] + 1)
        tops = [F.when(d["level"] <= i, F.greatest(s[f"t{i}"], d["stop"])).otherwise(s[f"t{i}"]).alias(f"t{i}") for i in levels]
        return F.struct(*tops, F.when(reach >= d["stop"], s["kept"]).otherwise(F.concat(s["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, start, step, lambda s: s["kept"])


def scan(docs: DataFrame, text: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """``docs`` with a column ``licenses``: array of struct(label, start, stop, level, rule) of the matches that stay.

    Words are counted from 0; denials have an empty label. Null and empty texts
    have none. A column of that name is replaced.
    """
    words = F.when(_gate(F.col(text)), worded(F.col(text)))
    out = docs.withColumn("licenses", words).withColumn("licenses", detections(F.col("licenses"), RULES if rules is None else rules))
    kept = F.transform(survivors(F.col("licenses")), lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), d["stop"].alias("stop"), d["level"].alias("level"), d["rule"].alias("rule")))
    return out.withColumn("licenses", F.coalesce(kept, F.array().cast("array<struct<label:string,start:int,stop:int,level:int,rule:int>>")))


def label_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """Base places and licence labels of each row of ``docs``.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels
    and score (the confidence of the best match with a label, 0 if there is
    none). Null and empty texts have no words, no labels (empty strings) and a
    score of 0; repeated rows are judged alike; other columns are not looked at.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = scan(d, "text", rules).withColumn("words", F.when(_gate(F.col("text")), worded(F.col("text"))))
    starts = F.array(*[F.struct(F.lit(label).alias("label"), F.transform(places(F.col("words"), F.lit(pattern(phrase))), lambda p: p["start"]).alias("at")) for label, phrase in sorted(BASE.items())])
    d = d.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), "licenses",
                 F.when(F.col("words").isNotNull(), F.filter(starts, lambda x: F.size(x["at"]) > 0)).alias("base"))
    at = F.flatten(F.transform("base", lambda x: x["at"]))
    base = F.coalesce(F.transform("base", lambda x: x["label"]), F.array().cast("array<string>"))
    named = F.filter("licenses", lambda x: x["label"] != "")
    sure = F.array(*[F.lit(c) for c in CONFIDENCE])
    return d.select("doc_id", "n_words", F.greatest(F.coalesce(F.size(at), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
                    F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base, F.transform(named, lambda x: x["label"]))), ",").alias("labels"),
                    F.coalesce(F.array_max(F.transform(named, lambda x: F.element_at(sure, x["level"] + 1))), F.lit(0.0)).alias("score"))
