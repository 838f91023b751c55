"""License detections: base phrases against a word-by-word search, rules by example and by gate."""

import random
import re
import time

import pytest

from leafloom.llm import license_scan as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for phrase, label in ls.BASE_PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_rules_are_hundreds_and_ordered():
    own = ls.rules()
    assert len(own) > 300 and [r.priority for r in own] == sorted(r.priority for r in own)
    for r in own:
        re.compile(r.pattern)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
        ("see the BSD 3-Clause License for details", "bsd-3-clause"),
        ("submit the limit; summit license", ""),
        ("nothing here", ""),
    ],
)
def test_examples(text, labels):
    assert ",".join(ls.Scanner(ls.rules())(text.encode())[5]) == labels


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under GPLv3", "gpl-3"),
        ("released under GPL2", "gpl-2"),
        ("distributed under the GNU GPLv2+", "gpl-2"),
        ("provided under LGPLv3", "lgpl-3"),
        ("License: LGPLv2.1", "lgpl-2.1"),
        ("published under AGPLv3", "agpl-3"),
        ("MPLv2 license", "mpl-2"),
        ("license CDDLv1.0", "cddl-1"),
        ("Expat License", "mit"),
        ("X11 License", "mit"),
        ("FreeBSD License", "bsd-2-clause"),
        ("released under ASL 2.0", "apache-2"),
        ("licensed under the ASL2", "apache-2"),
    ],
)
def test_spellings_in_one_word(text, labels):
    assert ",".join(ls.Scanner(ls.rules())(text.encode())[5]) == labels


def spellings(parsed):
    """Texts that a parsed pattern matches, with every choice in it; a repeat has its least length, and
    one letter or digit stands for all."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            ways = [chr(arg)]
        elif op == "IN":
            ways = [chr(v) if str(o) == "LITERAL" else {"CATEGORY_NOT_SPACE": "x"}.get(str(v), "7") for o, v in arg]
        elif op == "SUBPATTERN":
            ways = spellings(arg[3])
        elif op == "ASSERT_NOT":
            ways = [""]
        elif op == "BRANCH":
            ways = [w for b in arg[1] for w in spellings(b)]
        else:
            assert op == "MAX_REPEAT"
            ways = [w * arg[0] for w in spellings(arg[2])] if arg[0] else ["", *spellings(arg[2])]
        out = [a + w for a in out for w in ways]
    return out


def test_every_spelling_passes_its_gates():
    scanner = ls.Scanner(ls.rules())
    for i, r in enumerate(scanner.own):
        for text in set(spellings(re._parser.parse(r.pattern))):
            line = f" {text} "
            assert scanner.compiled[i].search(line)
            assert i in scanner.open(dict(x[1] for x in scanner.automaton.iter(line)), line), (r.label, text)


class Ungated(ls.Scanner):
    """All rules are run over every text."""

    def __init__(self, own):
        super().__init__([ls.Rule(r.label, ("",), r.pattern, r.priority, r.weight) for r in own])

    def __call__(self, text):
        line = " " + " ".join(w.decode() for w in ls.words(text)) + " "
        hits = [(*m.span("name" if "name" in c.groupindex else 0), r.priority, i) for i, (r, c) in enumerate(zip(self.own, self.compiled)) for m in c.finditer(line)]
        return sorted({self.own[h[3]].label for h in ls.suppress(hits)})


def test_gated_and_ungated_labels_are_equal():
    """Over a spelling of every rule, with words of other licenses around it."""
    rnd = random.Random(8)
    gated, ungated = ls.Scanner(ls.rules()), Ungated(ls.rules())
    every = [rnd.choice(spellings(re._parser.parse(r.pattern))) for r in gated.own]
    for k, text in enumerate(every):
        text = f"file {text} {rnd.choice(['and', 'license', 'or later', 'under the'])} {every[rnd.randrange(len(every))] if k % 3 == 0 else 'end'}"
        base = {label for phrase, label in ls.BASE_PHRASES.items() if f" {phrase} " in f" {text} "}
        assert gated(text.encode())[5] == sorted({*ungated(text.encode()), *base}), text


@pytest.mark.parametrize(
    "text, labels",
    [
        ("it under the terms of the GNU General Public License version 2", "gpl-2"),
        ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2-or-later"),
        ("GPL-2.0-or-later", "gpl-2-or-later"),
        ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2"),
        ("see https://opensource.org/licenses/MIT", "mit"),
        ("http://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
        ("Redistributions and use in source and binary forms", ""),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("This program is under GPLv2 and that one under LGPLv2.1", "gpl-2,lgpl-2.1"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ],
)
def test_notices_addresses_and_spellings(text, labels):
    assert ",".join(ls.Scanner(ls.rules())(text.encode())[5]) == labels


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under the BSD license", "bsd"),
        ("released under the GPL", "gpl"),
        ("licensed under the Apache License", "apache"),
        ("GNU GPL v3", "gpl-3"),
        ("AGPL-3.0-only", "agpl-3"),
        ("the LGPL", "lgpl"),
        ("Artistic License 2.0", "artistic-2"),
        ("Elastic License 2.0", "elastic-2"),
        ("Server Side Public License", "sspl"),
        ("GNU General Public License v3.0", "gpl-3"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2,mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "classpath-exception,gpl-2-or-later"),
        ("SPDX-License-Identifier: (LGPL-2.1-only OR (MIT AND BSD-3-Clause)) AND ISC", "bsd-3-clause,isc,lgpl-2.1,mit"),
        ("Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
        ("Business Source License 1.1", "busl-1.1"),
    ],
)
def test_families_expressions_and_newer_names(text, labels):
    assert ",".join(ls.Scanner(ls.rules())(text.encode())[5]) == labels


def test_labels_of_whole_texts_against_all_rules(spark, sf):
    """Every rule is run over every whole text of the table, among them those that name licenses."""
    gated, ungated = ls.Scanner(ls.rules()), Ungated(ls.rules())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = 0
    for text in texts:
        labels = gated((text or "").encode())[5]
        base = {label for phrase, label in ls.BASE_PHRASES.items() if f" {phrase} " in " " + " ".join(w.decode() for w in ls.words((text or "").encode())) + " "}
        assert labels == sorted({*ungated((text or "").encode()), *base})
        held += bool(labels)
    assert held


def test_many_base_places_take_time_in_proportion():
    scanner = ls.Scanner(ls.rules())
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        got = scanner(b"lorem cc by nc ipsum " * n)
        took.append(time.process_time() - began)
        assert got[:4] == (5 * n, n, 1, 5 * n - 4)
    assert took[1] < 8 * took[0] + 1


def test_suppression_by_containment_and_priority():
    assert ls.suppress([(0, 10, 2, 5), (0, 10, 1, 7), (2, 8, 0, 1), (8, 14, 3, 2), (20, 22, 4, 3)]) == [(0, 10, 1, 7), (20, 22, 4, 3)]
    assert ls.suppress([(0, 10, 3, 0), (8, 14, 1, 1), (12, 20, 2, 2), (20, 21, 9, 3)]) == [(8, 14, 1, 1), (20, 21, 9, 3)]
    # What a loser hid stays hidden, but a loser turns nothing away itself.
    assert ls.suppress([(0, 10, 1, 0), (8, 18, 2, 1), (16, 24, 3, 2)]) == [(0, 10, 1, 0), (16, 24, 3, 2)]


def test_suppression_against_its_definition():
    rnd = random.Random(5)
    for _ in range(300):
        hits = [(a, a + rnd.randrange(1, 8), rnd.randrange(4), i) for i, a in enumerate(rnd.randrange(20) for _ in range(rnd.randrange(9)))]
        best = {}
        for h in sorted(hits, key=lambda h: h[2:]):
            best.setdefault(h[:2], h)
        outer = [h for h in best.values() if not any(o is not h and o[0] <= h[0] and h[1] <= o[1] for o in best.values())]
        want = []
        for h in sorted(outer, key=lambda h: (h[2], h[0] - h[1], h[0])):
            if all(o[1] <= h[0] or h[1] <= o[0] for o in want):
                want.append(h)
        assert ls.suppress(hits) == sorted(want)


def test_table_against_brute_force(spark, sf):
    rnd = random.Random(4)
    bits = ["Under the MIT\tLicense", "apache license VERSION 2", "cc-by.nc", "été", "under", "the", "x\x00y", "\n"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "Under the MIT license"), (3, rows[3][1]), (202, "word " * 60000 + "cc by nc")]
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id bigint, text string, labels string, score int")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.scan_licenses(docs).collect()]
    assert sorted(got, key=repr) == sorted([(d, *brute(t)) for d, t in rows], key=repr)
    for r in ls.scan_licenses(docs).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert ls.scan_licenses(docs.limit(0)).collect() == []
