import re

from tallyweave.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w = words(text)
    at = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def brute_labels(text):
    norm = " ".join(words(text))
    found = []
    for r in L.rules():
        for m in re.finditer(r.pattern, norm):
            a = norm[: m.start()].count(" ")
            found.append((a, a + m[0].count(" "), r))
    kept = [
        r
        for i, (a, b, r) in enumerate(found)
        if not any(i != j and c <= a and b <= d and ((c, d) != (a, b) or (q.priority, q.label, j) < (r.priority, r.label, i)) for j, (c, d, q) in enumerate(found))
    ]
    base = {r.label for _, _, r in found if r.base}
    return ",".join(sorted(base | {r.label for r in kept})), 1.0 if base else max((r.weight for r in kept), default=0.0)


TEXTS = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "under the mit license UNDER THE MIT LICENSE, apache-license version 2 cc-by-nc; CC BY NC",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the GNU Lesser General Public License v2.1 or MPL",
    "SPDX-License-Identifier: BSD-3-Clause",
    "creative commons attribution noncommercial sharealike 4.0 international license",
    "It's in the public domain. All rights reserved. İmit license K license",
    "mit license " * 3000,
    "Éclair under the mit licenseé and undér the mit license",
    "permission is hereby granted, free of charge, to any person obtaining a copy",
    "The Apache License, Version 2.0 \n(the \"License\")",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0",
    "See https://creativecommons.org/licenses/by-nc-sa/4.0/ and https://www.gnu.org/licenses/gpl-3.0.html",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work, CC0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "\u212Aernel wor\u212A under the MIT LICENSE, openssl license \u0130sc license",
]


def test_rules_are_hundreds():
    assert len(L.rules()) > 400 and len(L._rows(L.SIGNATURES)) > 100
    names = {x[0] for x in L._rows(L.NAMES)}
    assert len({x[4] for x in L._rows(L.SIGNATURES)}) == len(L._rows(L.SIGNATURES)) and len({x[0] for x in L._rows(L.SIGNATURES)} & names) > 55


def test_matches_brute_force(spark):
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "1 as norm", "2 as found")
    got = {r.doc_id or 0: r for r in L.scan(rows).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        if t is None or len(t) < 1000:
            assert (r.labels, r.score) == brute_labels(t), t
    assert [got[i].labels for i in range(14, 20)] == ["apache-2", "cc-by-nc-sa,gpl-3", "gpl-3,gpl-text", "cc0", "cc-by-nc", "mit,openssl"]
    assert got[5].labels == "gpl-3" and got[7].labels == "bsd-3" and got[8].labels == "cc-by-nc-sa"
    assert L.scan(rows.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    frame = QUERIES["op3_licenses"](spark, sf_dir)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString() and "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    for r in frame.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert (r.labels, r.score) == brute_labels(texts[r.doc_id])


def test_phrases_without_the_word_license(spark):
    texts = [
        "Released under GPL 3",
        "distributed under the terms of MPL 2.0",
        "available under CC0",
        "shared under Creative Commons Attribution 4.0",
        "Proprietary and confidential",
        "redistributed to you under the BSD 3-clause",
        "this is provided as is, without warranty of any kind, and offered under zlib",
        "covered under the MIT X11, and published under an ISC public",
        "we discovered under Apache ruins",
    ]
    texts += [f"{verb} {to}under {name}" for verb in "released distributed redistributed available published provided covered issued offered shared".split() for to in ("", "to you ") for name in ("the mit", "gpl 2", "terms of mpl")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_labels(t) for t in texts]
    assert [got[i][0] for i in range(6)] == ["gpl-3", "mpl-2", "cc0", "cc-by", "proprietary", "bsd-3"] and got[8] == ("", 0.0)


def test_anchors_are_in_their_phrases():
    for priority, _, anchors, phrase in L._rows(L.PHRASES):
        heads = re.match(r"\(\?:([^)]*)\) \(\?:to you \)\?under ", phrase)
        forms = [f"{v} {to}under".replace("[cs]", "s") for v in heads[1].split("|") for to in ("", "to you ")] if heads else [phrase.replace("licen[cs]e", "license")]
        assert all(any(a in f for a in anchors.split("/")) for f in forms), priority
