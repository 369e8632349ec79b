"""License scans by ordered signature rules.

Text
    A-Z count as a-z; words are runs of a-z, digits and non-ASCII characters.
    Rules see the words of the whole text joined by single spaces.

Rules
    Every rule is a regex (whose spaces are those between words) with a
    label, a priority, a weight and a keyword, a literal without which it
    cannot match. They come from two hand-written
    tables: licence families (names, versions, wordings of a notice) and
    sentences of licence texts. Rules with the same keyword stand together,
    and only those whose keyword occurs in a text are run on it.

Overlaps
    A detection is an interval of words. In the order of start, longest
    first, then priority, then rule, a detection goes if an interval before
    it with at least its priority contains it. (That is: any contained in
    another of higher priority, or of the same and longer or earlier.)

The base phrases are counted at all their places and keep their labels
whatever the rules say. ``score`` is the highest weight of what is left (a
base phrase alone weighs ``BASE_WEIGHT``), 0 without any.

Null text counts as empty: no words, no places, empty labels. An empty table
gives an empty answer. All of it is DataFrame operations within a row:
nothing is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import text_of

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_WEIGHT = 0.5
# What is no word character, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# label: (names as words, versions as words)
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "gpl": (("gnu general public license", "gnu gpl"), ("1 0", "1", "2 0", "2", "3 0", "3")),
    "lgpl": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), ("2 0", "2", "2 1", "3 0", "3")),
    "agpl": (("gnu affero general public license", "affero general public license", "gnu agpl"), ("1 0", "1", "3 0", "3")),
    "gfdl": (("gnu free documentation license", "gnu fdl"), ("1 1", "1 2", "1 3")),
    "apache": (("apache license", "apache software license"), ("1 0", "1 1", "2 0")),
    "mit": (("mit license", "mit licence", "expat license"), ()),
    "x11": (("x11 license", "mit x11 license"), ()),
    "isc": (("isc license", "isc licence"), ()),
    "bsd": (("bsd license", "bsd licence", "berkeley software distribution license"), ()),
    "bsd-2-clause": (("bsd 2 clause", "2 clause bsd", "simplified bsd license", "freebsd license"), ()),
    "bsd-3-clause": (("bsd 3 clause", "3 clause bsd", "new bsd license", "revised bsd license", "modified bsd license"), ()),
    "bsd-4-clause": (("bsd 4 clause", "4 clause bsd", "original bsd license"), ()),
    "0bsd": (("zero clause bsd", "bsd zero clause", "0bsd license"), ()),
    "cc-by": (("cc by", "creative commons attribution"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-sa": (("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc": (("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nd": (("cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-sa": (("cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-nd": (("cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc0": (("cc0", "creative commons zero"), ("1 0",)),
    "mpl": (("mozilla public license", "mozilla public licence"), ("1 0", "1 1", "2 0")),
    "epl": (("eclipse public license",), ("1 0", "2 0")),
    "cpl": (("common public license",), ("0 5", "1 0")),
    "cddl": (("common development and distribution license",), ("1 0", "1 1")),
    "edl": (("eclipse distribution license",), ("1 0",)),
    "eupl": (("european union public licence", "european union public license"), ("1 0", "1 1", "1 2")),
    "osl": (("open software license",), ("1 0", "2 0", "2 1", "3 0")),
    "afl": (("academic free license",), ("1 1", "2 0", "2 1", "3 0")),
    "artistic": (("artistic license", "perl artistic license"), ("1 0", "2 0")),
    "boost": (("boost software license",), ("1 0",)),
    "zlib": (("zlib license", "zlib libpng license"), ()),
    "libpng": (("libpng license",), ()),
    "unlicense": (("the unlicense", "unlicense org"), ()),
    "wtfpl": (("do what the fuck you want to public license", "wtfpl"), ("2",)),
    "openssl": (("openssl license",), ()),
    "python": (("python software foundation license", "psf license", "python license"), ("2", "2 0")),
    "php": (("php license",), ("3 0", "3 01")),
    "ruby": (("ruby license",), ()),
    "postgresql": (("postgresql license", "postgresql licence"), ()),
    "ncsa": (("university of illinois ncsa open source license", "ncsa open source license"), ()),
    "ofl": (("sil open font license", "open font license"), ("1 0", "1 1")),
    "ms-pl": (("microsoft public license",), ()),
    "ms-rl": (("microsoft reciprocal license",), ()),
    "cecill": (("cecill license", "cecill free software license"), ("1 0", "2 0", "2 1")),
    "qpl": (("q public license",), ("1 0",)),
    "lppl": (("latex project public license",), ("1 0", "1 2", "1 3")),
    "sleepycat": (("sleepycat license",), ()),
    "vim": (("vim license",), ()),
    "odbl": (("open database license", "odc open database license"), ("1 0",)),
    "pddl": (("public domain dedication and license",), ("1 0",)),
    "ogl": (("open government licence", "open government license"), ("1 0", "2 0", "3 0")),
    "upl": (("universal permissive license",), ("1 0",)),
    "mulan": (("mulan psl", "mulan permissive software license"), ("1", "2")),
    "blueoak": (("blue oak model license",), ("1 0 0",)),
    "sspl": (("server side public license",), ("1",)),
    "busl": (("business source license",), ("1 1",)),
    "elastic": (("elastic license",), ("2 0",)),
    "polyform": (("polyform noncommercial license", "polyform small business license"), ("1 0 0",)),
    "openrail": (("openrail", "creative ml openrail m"), ()),
    "ssh-open": (("ssh open license",), ()),
    "w3c": (("w3c software notice and license", "w3c license"), ()),
    "ijg": (("independent jpeg group license",), ()),
    "json": (("the json license", "json license"), ()),
    "beerware": (("beer ware license", "beerware license"), ()),
    "proprietary": (("end user license agreement", "proprietary license", "commercial license agreement"), ()),
}

# (label, keyword, regex) of sentences in licence texts and notices.
SENTENCES: tuple[tuple[str, str, str], ...] = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice shall be included", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit-0", "without restriction including", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("isc", "permission to use copy modify and", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote products", r"(?:neither the name|the names?) of(?: [^ ]+){1,12} may be used to endorse or promote products derived"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache org licenses license 2 0", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "except in compliance with the license", r"you may not use this (?:file|work) except in compliance with the license"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", "version 2 of the license", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "version 3 of the license", r"either version 3 of the license or at your option any later version"),
    ("gpl", "gnu org licenses", r"(?:see )?(?:https? )?(?:www )?gnu org licenses(?: gpl)?"),
    ("lgpl-2.1-or-later", "version 2 1 of the license", r"either version 2 1 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla org mpl 2 0", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla public license v 2 0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licenses by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "licenses by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "licenses by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "licenses by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-sa-3.0", "licenses by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain", r"(?:is|are|placed|released|dedicated)(?: hereby)?(?: placed| released| dedicated)?(?: in| into| to)? the public domain"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "boost org license 1 0", r"(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("epl-2.0", "eclipse org legal epl", r"(?:https? )?(?:www )?eclipse org (?:legal|org documents) epl (?:v20|2 0)"),
    ("ofl-1.1", "scripts sil org ofl", r"(?:https? )?scripts sil org ofl"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential and proprietary", r"(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("warranty-disclaimer", "without warranty of any kind", r"(?:provided as is )?without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", "without warranties or conditions", r"without warranties or conditions of any kind either express or implied"),
)

# Every keyword contains one of these; texts without any are not looked at further.
ANCHORS = (
    "licen", "gnu ", " bsd ", "cc by", "cc0", "creative commons", "wtfpl", "mulan", "openrail", "permission ", "source and binary",
    "redistributions ", "endorse or", "all advertising", "free software", "mozilla", "public domain", "publicdomain", "free and unenc",
    "provided as is", "eclipse org", "sil org", "all rights", "unauthorized copying", "proprietary", "without warrant", "without restr",
)

NOTICE = r"(?:licensed|released|distributed|available|published|covered|provided|made available|redistributed)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?"
VERSION = r"(?: licen[sc]e)?(?: version | v | v|v| )"
LATER = r"(?: only)?(?: or| and)?(?: at your option)? (?:any later version|later versions?|later)"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    weight: float


def _spelled(label: str, version: str) -> str:
    number = version.replace(" ", ".")
    return f"{label}-{number}" if "." in number else f"{label}-{number}.0"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules: a name, a notice, a version, both, a later version, a tag; then the sentences."""
    found: list[Rule] = []
    for label, (names, versions) in FAMILIES.items():
        found.append(Rule(label, "spdx license identifier", rf"spdx license identifier {label.replace('-', ' ')}(?: [0-9]+)*(?: only| or later)?", 6, 1.0))
        for name in names:
            found.append(Rule(label, name, name, 1, 0.5))
            found.append(Rule(label, name, NOTICE + name, 2, 0.8))
            for version in versions:
                number = _spelled(label, version)
                found.append(Rule(number, name, name + VERSION + version, 3, 0.9))
                found.append(Rule(number, name, NOTICE + name + VERSION + version, 4, 1.0))
                if label in ("gpl", "lgpl", "agpl", "gfdl"):
                    found.append(Rule(f"{number}-or-later", name, name + VERSION + version + LATER, 5, 1.0))
    found += [Rule(label, keyword, regex, 4, 0.9) for label, keyword, regex in SENTENCES]
    if loose := [r.keyword for r in found if not any(a in f" {r.keyword} " for a in ANCHORS)]:
        raise ValueError(f"keywords without an anchor: {loose}")
    return tuple(dict.fromkeys(found))


def _whole_words(regex: str) -> str:
    return f"(?i)(?<= )(?:{regex})(?= )"


def word_text(text: Column) -> Column:
    """The words, each with a space before it, and a space at the end."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), SEPARATORS, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also inside the functions of arrays."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, joined) -> Column:
    """``joined`` (a sum, a maximum) of each value and all before it.

    By doubling: each turn joins every place with the one 1, 2, 4, ... before
    it, so an array is copied a logarithm of its length times, not once for
    every element.
    """
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def turn(state: Column, n: Column) -> Column:
        earlier = lambda i: F.get(state, i - F.call_function("shiftleft", F.lit(1), n))
        return F.transform(state, lambda x, i: F.coalesce(joined(x, earlier(i)), x))

    return F.aggregate(turns, values, turn)


def _places(words: Column, regex: Column) -> Column:
    """array<struct<first, last>> of all matches, in words from 0."""
    matches, between = F.regexp_extract_all(words, regex, F.lit(0)), F.split(words, regex, -1)
    # Of each match its words, and those with the words before it since the last one. Behind the last match is no match.
    sizes = F.filter(
        F.zip_with(matches, between, lambda m, b: F.struct(_spaces(m).alias("own"), (_spaces(m) + _spaces(b)).alias("all"))),
        lambda s: s["own"].isNotNull(),
    )

    def placed(sizes: Column) -> Column:
        ends = _running(F.transform(sizes, lambda s: s["all"]), lambda x, y: x + y)
        return F.zip_with(ends, sizes, lambda end, s: F.struct((end - 1 - s["own"]).cast("int").alias("first"), (end - 1).cast("int").alias("last")))

    return _let(sizes, placed)


def _rule_table() -> Column:
    """array<struct<keyword, rules>>, constant: one literal, parsed when the query is planned."""
    by_keyword: dict[str, list[dict]] = {}
    for number, rule in enumerate(rules()):
        spelled = {"regex": _whole_words(rule.regex), "label": rule.label, "priority": rule.priority, "weight": rule.weight, "number": number}
        by_keyword.setdefault(rule.keyword, []).append(spelled)
    table = json.dumps([{"keyword": f" {k} ", "rules": v} for k, v in by_keyword.items()])
    rule_type = "struct<regex:string,label:string,priority:int,weight:double,number:int>"
    return F.from_json(F.lit(table), f"array<struct<keyword:string,rules:array<{rule_type}>>>")


def _detections(words: Column, lowered: Column, table: Column) -> Column:
    """array<struct<first, back, down, number, last, priority, label, weight>> of all rules, in the order in which they suppress each other."""
    met = F.filter(table, lambda group: F.contains(lowered, group["keyword"]))

    def of_rule(rule: Column) -> Column:
        return F.transform(
            _places(words, rule["regex"]),
            lambda p: F.struct(
                p["first"].alias("first"), (-p["last"]).alias("back"), (-rule["priority"]).alias("down"), rule["number"].alias("number"),
                p["last"].alias("last"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"),
            ),
        )

    return F.array_sort(F.flatten(F.flatten(F.transform(met, lambda group: F.transform(group["rules"], of_rule)))))


def _unsuppressed(detections: Column) -> Column:
    """array<struct<label, weight>> of those that no earlier one of at least their priority reaches beyond."""
    priorities = max(r.priority for r in rules())

    def kept(found: Column) -> Column:
        def furthest(p: int) -> Column:
            return _running(F.transform(found, lambda d: F.when(d["priority"] >= p, d["last"]).otherwise(-1)), F.greatest)

        # ends[p][i]: the furthest end of the intervals up to the i-th with at least priority p.
        ends = F.array(*map(furthest, range(priorities + 1)))
        free = _let(ends, lambda ends: F.filter(found, lambda d, i: F.coalesce(F.get(F.get(ends, d["priority"]), i - 1), F.lit(-1)) < d["last"]))
        return F.transform(free, lambda d: F.struct(d["label"].alias("label"), d["weight"].alias("weight")))

    return _let(detections, kept)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_text(text_of(text_col)).alias("words"))
    phrase = F.lit(_whole_words("|".join(BASE_PHRASES)))
    words, lowered = F.col("words"), F.col("lowered")
    rows = rows.select("doc_id", "words", F.lower("words").alias("lowered"))
    anchored = F.lit(False)
    for anchor in ANCHORS:
        anchored = anchored | F.contains(lowered, F.lit(anchor))
    rows = rows.select("doc_id", "words", F.when(anchored, lowered).alias("lowered"))  # null: no rule can match
    base = F.when(lowered.isNotNull(), _places(words, phrase)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    named = F.array(*[F.when(lowered.isNotNull() & words.rlike(_whole_words(p)), F.lit(label)) for p, label in BASE_PHRASES.items()])
    kept = F.when(lowered.isNotNull(), _unsuppressed(_detections(words, lowered, _rule_table()))).otherwise(
        F.array().cast("array<struct<label:string,weight:double>>")
    )
    rows = rows.select(
        "doc_id",
        (_spaces(words) - 1).cast("bigint").alias("n_words"),
        F.transform(base, lambda p: p["first"].cast("bigint")).alias("places"),
        F.array_sort(F.array_distinct(F.array_compact(named))).alias("base"),
        kept.alias("kept"),
    )
    labels = F.array_sort(F.array_union(F.col("base"), F.transform("kept", lambda k: k["label"])))
    weights = F.concat(F.transform("kept", lambda k: k["weight"]), F.transform("base", lambda _: F.lit(BASE_WEIGHT)), F.array(F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.array_max(weights).alias("score"),
    )
