"""License scans with ordered signature rules, in SQL functions only.

A text is brought to one line: A-Z lower-cased, words (runs of ``a-z``, ``0-9`` and characters beyond ASCII) parted by
one blank, so rules see no punctuation or line breaks.

Method.  The rules are regular expressions over that line, written for each family of licenses (names, versions, notices,
tags, addresses) and for the wording of license texts, and ordered by form: tag, notice, address, text, name with version, name.  Each family has a keyword and
each rule a further one; a rule runs only where the line holds both.  Detections are word intervals.  Sorted by start,
length and order of the rules, one that lies within an earlier one is suppressed (of equal ones the rule that comes
first stays); where two neighbours overlap in part, the one of the lower order goes.  Three plain phrases are
reported as they stand (``base``), whether or not a rule suppresses them.

Scale.  One pass over the texts, nothing is shuffled and no Python runs.  A rule that matches costs one pass over its text; detections are
suppressed in runs of ``RUN``, so texts with very many of them stay in proportion.

Edge cases: null and empty texts have no words and no detections; repeated rows give one row each; null ids are passed
on; texts are scanned whole; columns besides the named ones are not read.
"""

from __future__ import annotations
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import let

#: The plain phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
RUN = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched between blanks; ``keyword`` and ``hint`` stand in every match."""

    label: str
    form: str
    pattern: str
    keyword: str
    hint: str


#: Forms in order, with the confidence a detection has.
FORMS = {"tag": 1.0, "notice": 0.95, "address": 0.95, "text": 0.9, "version": 0.85, "name": 0.7, "mention": 0.4}

#: Families that come in versions: label, keyword, name pattern, versions.
VERSIONED = (
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "1.0 2.0 3.0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "2.0 2.1 3.0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "1.0 3.0"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?", "1.0 1.1 2.0"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public", r"eclipse public licen[sc]e", "1.0 2.0"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "1.0 1.1"),
    ("eupl", "european union public", r"european union public licen[sc]e", "1.0 1.1 1.2"),
    ("eupl", "eupl", r"eupl", "1.0 1.1 1.2"),
    ("osl", "open software licen", r"open software licen[sc]e", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", r"artistic(?: licen[sc]e)?", "1.0 2.0"),
    ("lppl", "latex project", r"latex project public licen[sc]e", "1.0 1.1 1.2 1.3"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", "1.0 1.1"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]e", "1.0"),
    ("bsl", "boost", r"boost(?: software)?(?: licen[sc]e)?", "1.0"),
    ("php", "php", r"php licen[sc]e", "3.0 3.01"),
    ("sspl", "server side public", r"server side public licen[sc]e", "1.0"),
    ("busl", "business source", r"business source licen[sc]e", "1.1"),
    ("elastic", "elastic", r"elastic licen[sc]e", "1.0 2.0"),
    ("zpl", "zope", r"zope public licen[sc]e", "1.1 2.0 2.1"),
    ("cc-by", "cc by", r"cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by", r"cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by", r"cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc by", r"cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "creative commons", r"creative commons attribution", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:s|atives|ative works)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)",
     "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", "cc0", r"cc0", "1.0"),
)

#: Licenses without versions: label, keyword, name pattern, whether the name alone is a detection.
PLAIN = (
    ("mit", "mit", r"mit(?: x11| expat)?", False),
    ("mit-0", "mit", r"mit (?:0|no attribution)", False),
    ("x11", "x11", r"x11", False),
    ("isc", "isc", r"isc", False),
    ("0bsd", "bsd", r"(?:0bsd|0 clause bsd|bsd 0 clause|zero clause bsd)", True),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)", True),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)", True),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)", True),
    ("bsd", "bsd", r"bsd(?: style| type)?", False),
    ("apache", "apache", r"apache(?: software)?", False),
    ("gpl", "general public", r"(?:gnu )?general public", False),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public", False),
    ("agpl", "affero", r"(?:gnu )?affero general public", False),
    ("mpl", "mozilla", r"mozilla public", False),
    ("epl", "eclipse", r"eclipse public", False),
    ("zlib", "zlib", r"zlib(?: libpng)?", False),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", False),
    ("postgresql", "postgresql", r"postgresql", False),
    ("python", "python", r"python(?: software foundation)?", False),
    ("ruby", "ruby", r"ruby", False),
    ("openssl", "openssl", r"openssl", False),
    ("w3c", "w3c", r"w3c(?: software)?", False),
    ("vim", "vim", r"vim", False),
    ("ms-pl", "microsoft public", r"microsoft public", False),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", False),
    ("upl", "universal permissive", r"universal permissive", False),
    ("unlicense", "unlicense", r"unlicense", True),
    ("wtfpl", "wtfpl", r"wtfpl", True),
    ("beerware", "beerware", r"beerware", True),
    ("cc0", "creative commons", r"creative commons zero", True),
    ("creative-commons", "creative commons", r"creative commons", False),
    ("public-domain", "public domain", r"public domain", False),
)

#: Wording of license texts: label, pattern, keyword, hint.
WORDING = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?",
     "permission", "hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission", "notice shall"),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",
     "permission", "hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", "binary forms"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,20}?nor the names of its contributors may be used to endorse", "contributors", "endorse"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising", "must display"),
    ("gpl", r"this (?:program|library|file) is free software you can redistribute it and or modify it", "redistribute", "free software"),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", "general public", "received a copy"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "general public", "received a copy"),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e", "general public", "affero"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[sc]e", "compliance", "except in"),
    ("apache-2.0", r"distributed on an as is basis without warranties or conditions of any kind", "warranties", "as is basis"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0", "mozilla", "source code form"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mozilla", "contents of this file"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e",
     "eclipse", "accompanying materials"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",
     "provided as is", "held liable"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", "public domain"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", "public licen", "you want to"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "permission", "organization"),
    ("cc0", r"to the extent possible under law (?:\S+ ){1,20}?waived all copyright", "possible under law", "waived"),
    ("ofl", r"this font software is licensed under the sil open font licen[sc]e", "font software", "licensed"),
    ("proprietary", r"all rights reserved", "all rights", "reserved"),
    ("proprietary", r"proprietary and confidential", "proprietary", "confidential"),
    ("proprietary", r"unauthorized copying of this file", "unauthorized", "copying of"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", "the public"),
)

#: Addresses: label, pattern (punctuation is gone), keyword, hint.
ADDRESSES = (
    ("mit", r"(?:www )?opensource org licenses? mit", "opensource", "org licen"),
    ("apache-2.0", r"(?:www )?apache org licenses license 2 0", "apache", "org licen"),
    ("bsd-2-clause", r"(?:www )?opensource org licenses? bsd 2 clause", "opensource", "bsd"),
    ("bsd-3-clause", r"(?:www )?opensource org licenses? bsd 3 clause", "opensource", "bsd"),
    ("gpl-2.0", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0", "gnu org", "gpl"),
    ("gpl-3.0", r"(?:www )?gnu org licenses gpl 3 0", "gnu org", "gpl"),
    ("gpl", r"(?:www )?gnu org licenses gpl", "gnu org", "gpl"),
    ("lgpl", r"(?:www )?gnu org licenses lgpl", "gnu org", "lgpl"),
    ("agpl", r"(?:www )?gnu org licenses agpl", "gnu org", "agpl"),
    ("mpl-2.0", r"(?:www )?mozilla org mpl 2 0", "mozilla", "org mpl"),
    ("cc0", r"creativecommons org publicdomain zero 1 0", "creativecommons", "zero"),
    *((f"cc-{kind}-{v}", rf"creativecommons org licenses {kind.replace('-', ' ')} {v.replace('.', ' ')}", "creativecommons", f"licenses {kind[:2]}")
      for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("2.0", "2.5", "3.0", "4.0")),
)

UNDER = r"(?:licensed|released|distributed|available|published|provided|covered|free software) under(?: the)?(?: terms of(?: the)?)? "
SHORT = r"(?:version |v(?:er)? ?)?"


def _versioned(label: str, keyword: str, name: str, versions: str) -> Iterator[Rule]:
    for version in versions.split():
        major, minor = version.split(".")
        # "3", "3 0" and "version 3 or later" name the same version; "2 1" needs its minor.
        number = f"{SHORT}{major}(?: {minor})?" if minor == "0" else f"{SHORT}{major} {minor}"
        number += r"(?! \d)(?: or (?:any )?later(?: version)?| only)?"
        whole = f"{label}-{version}"
        yield Rule(whole, "notice", f"{UNDER}(?:an? )?{name}(?: licen[sc]e)? {number}", keyword, " under ")
        yield Rule(whole, "version", f"{name}(?: licen[sc]e)? {number}", keyword, major)
        yield Rule(whole, "tag", f"spdx licen[sc]e identifier {label.replace('-', ' ')} {major} {minor}(?: or later| only)?",
                   label.replace("-", " "), "spdx licen")
    yield Rule(label, "notice", f"{UNDER}(?:an? )?{name}(?: licen[sc]e)?(?! \\d)", keyword, " under ")


def _plain(label: str, keyword: str, name: str, alone: bool) -> Iterator[Rule]:
    yield Rule(label, "notice", f"{UNDER}(?:an? )?{name}(?: licen[sc]e)?", keyword, " under ")
    yield Rule(label, "tag", f"spdx licen[sc]e identifier {label.replace('-', ' ')}", label.replace("-", " "), "spdx licen")
    yield Rule(label, "name", f"{name} licen[sc]e", keyword, "licen")
    yield Rule(label, "mention", f"licen[sc]e(?: is| type| name)? {name}", keyword, "licen")
    if alone:
        yield Rule(label, "version", name, keyword, keyword)


def rules() -> list[Rule]:
    """All rules, the strongest forms first, in the order written inside a form."""
    out = [r for row in VERSIONED for r in _versioned(*row)] + [r for row in PLAIN for r in _plain(*row)]
    out += [Rule(label, "text", p, k, h) for label, p, k, h in WORDING]
    out += [Rule(label, "address", p, k, h) for label, p, k, h in ADDRESSES]
    forms = list(FORMS)
    return sorted(dict.fromkeys(out), key=lambda r: forms.index(r.form))


def line(text: Column) -> Column:
    """The words of a text, each between blanks; one blank where there is none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def places(words: Column, pattern: Column) -> Column:
    """Word intervals ``(start, end)`` of a pattern's matches, end exclusive."""
    # A control character cannot stand in the line: it marks the first and the last word of a match.
    marked = lambda: F.split(F.regexp_replace(words, pattern, F.lit("\u0001$0\u0002")), " ")

    def numbers(parts: Column, hit, shift: int) -> Column:
        return F.filter(F.transform(parts, lambda w, i: F.when(hit(w), i + shift)), lambda i: i.isNotNull())

    pairs = let(marked(), lambda parts: F.zip_with(
        numbers(parts, lambda w: F.startswith(w, F.lit("\u0001")), -1),
        numbers(parts, lambda w: F.endswith(w, F.lit("\u0002")), 0),
        lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    return F.when(F.regexp_like(words, pattern), pairs).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _literals(known: list[Rule]) -> Column:
    """The rules as one constant, grouped by keyword (written as SQL: a call for every value would take longer than a scan)."""
    forms = list(FORMS)
    by_keyword: dict[str, list[str]] = {}
    for no, r in enumerate(known):
        by_keyword.setdefault(r.keyword, []).append(
            rf"named_struct('pattern', r'(?<= ){r.pattern}(?= )', 'hint', '{r.hint}', 'form', {forms.index(r.form)}, "
            f"'no', {no}, 'label', '{r.label}', 'weight', {FORMS[r.form]}D)")
    groups = [f"named_struct('keyword', '{k}', 'rules', array({', '.join(own)}))" for k, own in by_keyword.items()]
    return F.expr(f"array({', '.join(groups)})")


def _detections(words: Column, known: list[Rule]) -> Column:
    """All matches of all rules, sorted by start, length (longest first) and order of the rules."""
    groups = F.filter(_literals(known), lambda g: F.contains(words, g["keyword"]))
    gated = F.flatten(F.transform(groups, lambda g: F.filter(
        g["rules"], lambda r: F.contains(words, r["hint"]))))
    found = F.flatten(F.transform(gated, lambda r: F.transform(places(words, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("minus_end"), r["form"].alias("form"), r["no"].alias("no"),
        r["label"].alias("label"), r["weight"].alias("weight")))))
    return F.array_sort(found)


def _uncontained(found: Column) -> Column:
    """Detections that lie in no earlier one, by the largest end so far; in runs, so that no long array is grown."""
    runs = F.when(F.size(found) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda c: F.slice(found, c * RUN + 1, F.lit(RUN))))

    def kept(runs: Column) -> Column:
        ends = F.transform(runs, lambda run: -F.array_min(F.transform(run, lambda d: d["minus_end"])))
        before = F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))
        nothing = F.slice(found, 1, 0)

        def inside(run: Column, at: Column) -> Column:
            start = F.struct(at.alias("reach"), nothing.alias("kept"))
            return F.aggregate(run, start, lambda acc, d: F.struct(
                F.greatest(acc["reach"], -d["minus_end"]).alias("reach"),
                F.when(-d["minus_end"] > acc["reach"], F.concat(acc["kept"], F.array(d))).otherwise(acc["kept"]).alias("kept")),
                lambda acc: acc["kept"])

        return let(before, lambda b: F.flatten(F.transform(runs, lambda run, i: inside(run, F.get(b, i)))))

    return F.coalesce(let(runs, kept), F.slice(found, 1, 0))


def _unbeaten(kept: Column) -> Column:
    """Without those that a direct neighbour of a stronger form overlaps in part."""
    def stays(d: Column, i: Column) -> Column:
        left, right = F.get(kept, i - 1), F.get(kept, i + 1)
        beaten = ((-left["minus_end"] > d["start"]) & (left["form"] < d["form"])) | (
            (right["start"] < -d["minus_end"]) & (right["form"] < d["form"]))
        return ~F.coalesce(beaten, F.lit(False))

    return F.filter(kept, stays)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, base, found`` for every row of ``docs``.

    ``base`` holds the places of the plain phrases and ``found`` what is left of the rules' detections, both by start:
    arrays of ``(start, end, label)`` in words, ``found`` with ``form`` and ``weight`` as well."""
    known = rules()
    names = F.array(*[F.lit(f) for f in FORMS])
    some = "array<struct<start:int,end:int,label:string>>"

    def phrase_places(words: Column, phrase: str, label: str) -> Column:
        named = F.transform(places(words, F.lit(f"(?<= ){phrase}(?= )")), lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label")))
        return F.when(F.contains(words, F.lit(f" {phrase} ")), named).otherwise(F.array().cast(some))

    def base(words: Column) -> Column:
        return F.array_sort(F.concat(*[phrase_places(words, phrase, label) for phrase, label in BASE]))

    def found(words: Column) -> Column:
        kept = let(_detections(words, known), lambda all_: let(_uncontained(all_), _unbeaten))
        return F.transform(kept, lambda d: F.struct(
            d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"),
            F.get(names, d["form"]).alias("form"), d["weight"].alias("weight")))

    whole = let(line(F.col(text_col)), lambda words: F.struct(
        (F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        base(words).alias("base"), found(words).alias("found")))
    return docs.select(F.col(id_col).alias("doc_id"), whole.alias("whole")).select("doc_id", "whole.*")
