"""License rules against the same rules run one by one, without keywords, in Python."""

import random
import re
import re._parser as parser

import pytest

from labelloom.llm import licenses, queries

FORM = {f: i for i, f in enumerate(licenses.FORMS)}
RULES = licenses.rules()
COMPILED = {p: re.compile(rf"(?<= )(?:{p})(?= )") for p in [*(r.pattern for r in RULES), *(phrase for phrase, _ in licenses.BASE)]}


def line(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", f" {lowered} ")


def spans(words, pattern):
    out = []
    for m in COMPILED[pattern].finditer(words):
        start = words[: m.start()].count(" ") - 1
        out.append((start, start + m[0].count(" ") + 1))
    return out


def brute(text):
    words = line(text)
    base = sorted((a, b, label) for phrase, label in licenses.BASE for a, b in spans(words, phrase))
    found = sorted((a, -b, FORM[r.form], no, r.label) for no, r in enumerate(RULES) for a, b in spans(words, r.pattern))
    kept = [d for i, d in enumerate(found) if not any(-e[1] >= -d[1] for e in found[:i])]
    left = []
    for i, d in enumerate(kept):
        sides = ([kept[i - 1]] if i and -kept[i - 1][1] > d[0] else []) + (
            [kept[i + 1]] if i + 1 < len(kept) and kept[i + 1][0] < -d[1] else [])
        if not any(s[2] < d[2] for s in sides):
            left.append((d[0], -d[1], d[4], list(licenses.FORMS)[d[2]]))
    return len(words.split(" ")) - 2, base, left


def sample(pattern, r):
    """A text the pattern matches."""
    def make(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += "x" if arg[0][0] is parser.NEGATE or str(arg[0][0]) == "CATEGORY" else chr(arg[r.randrange(len(arg))][1])
            elif name == "BRANCH":
                out += make(r.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += make(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(make(arg[2]) for _ in range(r.randint(arg[0], min(int(arg[1]), 3))))
            else:
                assert name == "ASSERT_NOT", name
        return out

    return make(parser.parse(pattern))


def scanned(spark, texts, extra="label string, words int, found string"):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")
    got = licenses.scan(df).orderBy("doc_id").collect()
    return [(r.n_words, [tuple(b) for b in r.base], [tuple(f)[:4] for f in r.found]) for r in got]


def test_hundreds_of_rules_whose_keywords_stand_in_every_match():
    r = random.Random(1)
    assert len(RULES) > 300 and len(set(RULES)) == len(RULES)
    for rule in RULES:
        for _ in range(8):
            text = f" {sample(rule.pattern, r)} "
            assert rule.keyword in text and rule.hint in text, (rule, text)
            assert COMPILED[rule.pattern].search(text), (rule, text)


def test_equals_brute_force(spark):
    """Samples of every rule, neighbours that overlap, odd separators, null and empty texts."""
    r = random.Random(2)
    filler = ["the", "License", "mit", "é", "2", "0", "public", "GNU", "under the", "version", "licensed under", "LICENSE:", "bsd"]
    texts = [None, "", " ", "...", "MIT", "MIT license", "a\x0bMIT license", "mit licenseé", "mit-LICENSE mit_license", "İ mit license K"]
    texts += [sample(rule.pattern, r).title() for rule in RULES]
    for _ in range(250):
        parts = [sample(r.choice(RULES).pattern, r) if r.random() < 0.4 else r.choice(filler) for _ in range(r.randint(1, 12))]
        texts.append(r.choice([" ", "-", ", ", "\n"]).join(parts).replace(" ", r.choice([" ", "  ", "\t"])))
    assert scanned(spark, texts) == [brute(t) for t in texts]


def test_very_many_detections_in_one_text(spark):
    """Thousands of places in one text, also across the runs in which they are suppressed."""
    text = "MIT License. Apache License, Version 2.0; general public license! " * 700 + "x " * 50_000
    assert scanned(spark, [text]) == [brute(text)]


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("Released under the MIT License.", {"mit"}),
    ("BSD 3-Clause License", {"bsd-3-clause"}),
    ("See https://www.apache.org/licenses/LICENSE-2.0 for the terms", {"apache-2.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
    ("nothing to see here, mit freundlichen Grüßen", set()),
])
def test_examples(text, labels):
    assert {d[2] for d in brute(text)[2]} == labels


def test_query_on_the_table(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        n, base, found = brute(r.text)
        starts = [b[0] for b in base]
        want[r.doc_id] = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[2] for b in base})),
                          ",".join(sorted({b[2] for b in base} | {d[2] for d in found})),
                          max((licenses.FORMS[d[3]] for d in found), default=0.0))
    got = queries.op12_licenses(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
