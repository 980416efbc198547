import random
import re

from samples import ALNUM, LOW, prose

from careloom.llm import licenses, signatures

SCHEMA = "doc_id long, text string, n_words string, labels int, detections binary"


def brute(text, every_rule=signatures.rules()):
    """All rules on all texts, without keywords, and suppression by comparing all pairs."""
    words = ALNUM.findall((text or "").translate(LOW))
    said = " ".join(words)
    places = sorted((i, label) for label, phrase in signatures.BASE for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split())
    hits = []
    for k, rule in enumerate(every_rule):
        for m in re.finditer(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])", said):
            first = said[: m.start()].count(" ")
            hits.append((rule.rank, -(m.group().count(" ") + 1), first, k))
    kept = []
    for rank, minus, first, k in sorted(hits):
        end = first - minus
        if not any((r < rank and f < end and first < e) or (f <= first and end <= e) or (first <= f and e <= end) for r, f, e, _ in kept):
            kept.append((rank, first, end, k))
    base = {label for _, label in places}
    labels = base | {every_rule[k].label for *_, k in kept}
    score = max((signatures.CONFIDENCE[r] for r, *_ in kept), default=0.0)
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score)


LINES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3 or any later version.", "SPDX-License-Identifier: BSD-3-Clause",
    "GNU  Lesser\nGeneral-Public License v2.1", "see https://creativecommons.org/licenses/by-sa/3.0/", "All rights reserved.",
    "cc by cc by", "the mit license mit license", "Creative Commons Attribution-NonCommercial-ShareAlike 2.5", "http://www.apache.org/licenses/LICENSE-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "mit", "gpl", "public domain dedication",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including copies",
    "© 2019 somebody", "Copyright (c) 2001 2002", "license", "licensed under the terms of some other license", "GPLv2 or later", "Mozilla Public License 2.0",
]


def sample():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample([*LINES, prose(rng, 30), prose(rng, 8)], k=rng.randint(1, 6)))) for i in range(150)]
    rows += [(200 + i, line) for i, line in enumerate(LINES)]
    rows += [(300, None), (301, ""), (302, "  \n"), (None, LINES[0]), (0, LINES[1]), (303, prose(rng, 20000) + " MIT License " + "x" * 60000)]
    return [(*r, "x", 1, b"k") for r in rows]


def test_against_brute_force(spark):
    rows = sample()
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    data = sorted(([*r][:-1] for r in got.collect()), key=repr)
    assert data == sorted(([r[0], *brute(r[1])] for r in rows), key=repr)


def test_labels():
    want = {
        LINES[0]: "apache,apache-2.0", LINES[1]: "mit", LINES[2]: "cc-by,cc-by-nc-4.0", LINES[3]: "gpl,gpl-3.0-or-later", LINES[4]: "bsd-3-clause",
        LINES[5]: "lgpl-2.1", LINES[6]: "cc-by-sa-3.0", LINES[10]: "cc-by-nc-sa-2.5", LINES[11]: "apache-2.0", LINES[16]: "mit", LINES[13]: "", LINES[19]: "",
        LINES[21]: "gpl-2.0-or-later", LINES[22]: "mpl-2.0",
    }
    assert {k: brute(k)[5] for k in want} == want


def spelled(parsed, rng):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "MAX_REPEAT":
            lo, hi, inner = arg
            out += "".join(spelled(inner, rng) for _ in range(rng.randint(lo, min(int(hi), lo + 3))))
        elif op == "SUBPATTERN":
            out += spelled(arg[-1], rng)
        elif op == "BRANCH":
            out += spelled(rng.choice(arg[1]), rng)
        elif op == "IN":
            out += "0" if str(arg[0][0]) == "CATEGORY" and "DIGIT" in str(arg[0][1]) else "w" if str(arg[0][0]) == "CATEGORY" else chr(rng.choice(arg)[1])
        else:
            raise ValueError(op)
    return out


def test_keywords_stand_in_every_match():
    """No rule matches the empty text, and no match lacks a keyword of its rule."""
    rng = random.Random(1)
    rules = signatures.rules()
    assert len(rules) >= 300 and [r.rank for r in rules] == sorted(r.rank for r in rules)
    scanner = licenses.Scanner(rules)
    for i, r in enumerate(rules):
        for _ in range(30):
            words = spelled(re._parser.parse(r.pattern), rng).split()
            assert words and i in scanner.gated({scanner.keywords[w] for w in words if w in scanner.keywords}), (r, words)
            assert any(h.rule == i and h.start == 0 for h in scanner.hits(words, [i]))


def test_words_of_detections(spark):
    row = licenses.scan_licenses(spark.createDataFrame([(1, "x, under the MIT-License y", "", 1, b"")], SCHEMA)).first()
    assert [d.asDict() for d in row.detections] == [{"label": "mit", "rank": 3, "first_word": 2, "n_words": 3, "words": "the mit license"}]


def test_empty(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
