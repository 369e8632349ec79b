"""The license scan against brute force: all rules on all texts, suppression by comparing all pairs."""

from __future__ import annotations

import random
import re

from ledgerflow.llm.license_scan import BASE_PHRASES, BASE_WEIGHT, license_report, rules

SCHEMA = "doc_id bigint, text string, words string, kept int, `label` string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    joined = "".join(f" {w}" for w in words) + " "
    places = []
    for phrase, label in BASE_PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    found = []
    for number, rule in enumerate(rules()):
        for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", joined):
            first = joined[: m.start()].count(" ") - 1
            found.append((first, -(first + m.group().count(" ")), -rule.priority, number, rule))
    found.sort(key=lambda d: d[:4])
    left = [
        d[4]
        for n, d in enumerate(found)
        if not any(e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in found[:n])
    ]
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {r.label for r in left})),
        max([r.weight for r in left] + [BASE_WEIGHT] * bool(base), default=0.0),
    )


def texts():
    rng = random.Random(8)
    parts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc by cc by",
             "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License v2 or any later version",
             "SPDX-License-Identifier: mpl 2.0", "the Mozilla Public License, v. 2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             "redistribution and use in source and binary forms, with or without modification, are permitted", "All rights reserved", "mit", "licença", "apache\nLICENSE",
             "apache licenses", "xmit license", "either version 2 of the License, or (at your option) any later version", "été ÉTÉ 12_3", "public domain", "is in the public domain",
             "free software", "AGPL", "GNU LGPL 2.1 or later", "Kelvin", "gnu general public license"]
    rows = [(i, p) for i, p in enumerate(parts)]
    rows += [(100 + i, " ".join(rng.choices(parts, k=rng.choice([2, 5, 9])))) for i in range(80)]
    rows += [(300, None), (301, ""), (302, " .,! "), (None, parts[0]), (None, parts[0]), (3, parts[3]), (303, "word " * 20_000 + "MIT License " * 500)]
    return rows


def test_report_matches_brute_force(spark):
    got = [tuple(r) for r in license_report(table(spark, texts())).collect()]
    expected = [(i, *brute(t)) for i, t in texts()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_rules_and_plan(spark):
    assert len(rules()) > 300 and len({r.priority for r in rules()}) > 4
    for rule in rules():
        re.compile(rule.regex)
    report = license_report(table(spark, texts()))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join|from_json", plan)  # the rule table is a constant
    assert license_report(table(spark, [])).count() == 0


def test_later_and_longer_suppress(spark):
    rows = [(1, "under GNU General Public License version 2 or any later version")]
    (row,) = license_report(table(spark, rows)).collect()
    assert row["labels"] == "gpl,gpl-2.0-or-later" and row["first_word"] == row["last_word"] == 1


def test_many_matches_in_one_text(spark):
    # 20,000 matches of several rules: time in proportion to the text, not to its square.
    text = "word " + "MIT License " * 20_000 + "released under the Apache License, Version 2.0"
    (row,) = license_report(table(spark, [(1, text)])).collect()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (40_009, 20_001, 1, 40_004)
    assert (row["base_labels"], row["labels"], row["score"]) == ("apache,mit", "apache,apache-2.0,mit", 1.0)
