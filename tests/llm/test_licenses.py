"""License scans, against SQL and a plain scan of every word with every rule."""

from __future__ import annotations

import re
import string

import duckdb
import pytest

from tests.parity import assert_same, connect
from tidemark.llm import licenses
from tidemark.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RULES = [(rule, re.compile(rule["pattern"])) for rule in licenses.rules()]

TEXTS = [
    None,
    "",
    " \n\t!?",
    "MIT License",
    "mit  LICENSE, mit-license; Mit_License apache license general public LICENSE",
    "Released under the MIT license. Apache License, Version 2.0.",
    "licensed under the GNU General Public License, version 3 or later",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "SPDX-License-Identifier: MIT and all rights reserved",
    "License: BSD-3-Clause. See https://opensource.org/licenses/BSD-3-Clause for it",
    "CC BY-NC-SA 4.0 https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Creative Commons Attribution-ShareAlike International 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published",
    "das ist mit Lizenz und mit licensé und mit licenKe",
    "MIİT license mıt license KIT mité license émit license",
    "gnu lesser general public license version 2.1 gnu general public license 2",
    "distributed with the terms and conditions of the Mozilla Public License v 2.0",
    "mit " * 50 + "license",
    "日本語 mit license \U0001f600 zlib license\x00isc license\x7funlicense",
    "apache license 2.0 " * 40,
]


def brute(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = [(label, i) for i in range(len(words)) for phrase, label in licenses.BASE if words[i : i + len(phrase.split())] == phrase.split()]
    spans = []
    for i in range(len(words)):
        here = " ".join(words[i : i + licenses.WIDTH]) + " "
        hit = next(((rule, m) for rule, p in RULES if (m := p.match(here))), None)
        if hit:
            spans.append((hit[0]["label"], i, i + hit[1].group().count(" ") - 1, hit[0]["priority"], hit[0]["weight"]))
    kept = [d for d in spans if not any(e[1] < d[1] and e[2] >= d[2] and e[3] >= d[3] for e in spans)]
    starts = [i for _, i in base]
    joined = lambda labels: ",".join(sorted(set(labels)))
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        joined(label for label, _ in base),
        joined([label for label, _ in base] + [d[0] for d in kept]),
        max((d[4] for d in kept), default=0.0),
        ",".join(f"{d[0]}:{d[1]}:{d[2]}" for d in kept),
    )


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_parity(spark, sf):
    assert assert_same(QUERIES["op12_licenses"](spark, f"/root/testdata/{sf}"), connect(sf), ORACLES["op12_licenses"]) > 0


def test_equals_every_rule_at_every_word_and_sql(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3]), (3, TEXTS[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.license_digest(frame)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
    assert assert_same(out, con, licenses.oracle_sql()) == len(rows)


def test_labels_found(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.license_digest(frame).collect()}
    assert labels[0] == labels[1] == labels[2] == ""
    assert labels[4] == "apache,gpl,mit" and labels[5] == "apache,apache-2.0,mit" and labels[6] == "gpl,gpl-3.0"
    assert labels[7] == "gpl-2.0" and labels[8] == "mit,proprietary" and labels[9] == "bsd-3-clause"
    assert labels[10] == "cc-by-nc-sa-4.0" and labels[11] == "cc-by-sa-4.0" and labels[12] == "mit"
    assert labels[14] == labels[15] == "" and labels[16] == "gpl,gpl-2.0,lgpl-2.1" and labels[17] == "mpl-2.0"
    assert labels[18] == "mit" and labels[19] == "isc,mit,unlicense,zlib"


def test_rules_are_ordered_gated_and_short():
    ordered = licenses.rules()
    assert len(ordered) > 300 and [r["priority"] for r in ordered] == sorted((r["priority"] for r in ordered), reverse=True)
    for rule in ordered:
        assert re.fullmatch("[a-z0-9]+", rule["keyword"]) and rule["pattern"].startswith("^" + rule["keyword"])
        assert rule["pattern"].endswith(" ") and rule["needs"] in rule["pattern"]
        longest = re.sub(r"\{1,8\}", " x x x x x x x x", rule["pattern"])
        assert longest.count(" ") <= licenses.WIDTH, rule
    opens = {r["keyword"] for r in ordered}
    assert {phrase.split(" ")[0] for phrase, _ in licenses.BASE} <= opens
    assert not opens & {"the", "a", "of", "this", "is"}


def test_a_second_keyword_never_hides_a_match():
    for rule, pattern in RULES:
        for text in TEXTS:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
            for i in range(len(words)):
                here = " ".join(words[i : i + licenses.WIDTH]) + " "
                if pattern.match(here):
                    assert rule["needs"] in here and words[i] == rule["keyword"]


def test_native_without_shuffle_and_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "mit license", 5, "x", 1)], "doc_id long, text string, base int, `a.b` string, detections int")
    plan = licenses.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)
    row = licenses.scan(frame).first()
    assert row["a.b"] == "x" and [tuple(d)[:3] for d in row["detections"]] == [("mit", 0, 1)]
    assert licenses.license_digest(frame).first().labels == "mit"
    assert licenses.license_digest(frame.limit(0)).collect() == []


def test_very_long_texts(spark):
    text = ("lorem ipsum " * 50 + "licensed under the apache license, version 2.0. ") * 3000
    row = licenses.license_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("spans").first()
    assert (row.n_words, row.n_base, row.first_word) == (108 * 3000, 3000, 103) and row.last_word == 108 * 2999 + 103
    assert row.labels == "apache,apache-2.0"
