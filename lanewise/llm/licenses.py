"""License scans: ordered signature rules over the words of a text.

A text is reduced to its lower-cased words with one space between them, so that line breaks,
comment marks and punctuation never hide a phrase. A rule is a regular expression behind a keyword
filter: it runs only if all its keywords occur among the text's words. Of overlapping detections
the one of higher priority stays, then the longer one; what lies inside a kept one is dropped.
"""

import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lanewise.llm.common import annotate, words

#: Phrases that are counted in any case, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label; how the license is named; its SPDX id; a part of its web address, in words.
FAMILIES = (
    ("apache-2.0", r"apache (?:software )?license(?: version)? (?:v )?2(?: 0)?", "apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", r"apache (?:software )?license(?: version)? (?:v )?1 1", "apache 1 1", r"apache org licenses license 1 1"),
    ("mit", r"mit(?: expat)? license", "mit", r"opensource org licenses? mit"),
    ("mit-0", r"mit no attribution license|mit no attribution", "mit 0", r"opensource org licenses? mit 0"),
    ("bsd-2-clause", r"(?:simplified|2 clause|two clause|freebsd) bsd license|bsd 2 clause(?: license)?", "bsd 2 clause", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd license|bsd 3 clause(?: license)?", "bsd 3 clause", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?", "bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("0bsd", r"(?:zero clause|0 clause) bsd license|bsd zero clause(?: license)?", "0bsd", r"opensource org licenses? 0bsd"),
    ("isc", r"isc license", "isc", r"opensource org licenses? isc"),
    ("gpl-1.0", r"gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", r"gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?|gpl ?v2", "gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", r"gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?|gpl ?v3", "gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("lgpl-2.0", r"gnu library general public license(?: version| v)? 2(?: 0)?", "lgpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", r"gnu lesser general public license(?: version| v)? 2 1|lgpl ?v2 1", "lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", r"gnu lesser general public license(?: version| v)? 3(?: 0)?|lgpl ?v3", "lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("agpl-3.0", r"gnu affero general public license(?: version| v)? 3(?: 0)?|agpl ?v3", "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("gfdl-1.3", r"gnu free documentation license(?: version| v)? 1 3", "gfdl 1 3(?: only| or later)?", r"gnu org licenses fdl 1 3"),
    ("gfdl-1.2", r"gnu free documentation license(?: version| v)? 1 2", "gfdl 1 2(?: only| or later)?", r"gnu org licenses (?:old licenses )?fdl 1 2"),
    ("mpl-1.1", r"mozilla public license(?: version| v)? 1 1", "mpl 1 1", r"mozilla org mpl(?: mpl)? 1 1"),
    ("mpl-2.0", r"mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-1.0", r"eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", r"eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0", r"eclipse org legal epl 2 0"),
    ("cddl-1.0", r"common development and distribution license(?: version| v)? 1(?: 0)?", "cddl 1 0", r"opensource org licenses? cddl 1"),
    ("cddl-1.1", r"common development and distribution license(?: version| v)? 1 1", "cddl 1 1", r"oracle com cddl 1 1"),
    ("cpl-1.0", r"common public license(?: version| v)? 1(?: 0)?", "cpl 1 0", r"opensource org licenses? cpl1 0"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version| v)? 1 2", "eupl 1 2", r"europa eu eupl 1 2"),
    ("osl-3.0", r"open software license(?: version| v)? 3(?: 0)?", "osl 3 0", r"opensource org licenses? osl 3 0"),
    ("afl-3.0", r"academic free license(?: version| v)? 3(?: 0)?", "afl 3 0", r"opensource org licenses? afl 3 0"),
    ("artistic-1.0", r"artistic license(?: version| v)? 1(?: 0)?", "artistic 1 0", r"opensource org licenses? artistic 1 0"),
    ("artistic-2.0", r"artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0", r"opensource org licenses? artistic 2 0"),
    ("bsl-1.0", r"boost software license(?: version| v)?(?: 1(?: 0)?)?", "bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", r"business source license(?: version| v)?(?: 1 1)?", "busl 1 1", r"mariadb com bsl11"),
    ("zlib", r"zlib(?: libpng)? license", "zlib", r"zlib net zlib license"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", r"do what the f\w* you want to public license|wtfpl", "wtfpl", r"wtfpl net"),
    ("psf-2.0", r"python software foundation license(?: version| v)? 2|psf license", "psf 2 0", r"docs python org license"),
    ("php-3.01", r"php license(?: version| v)? 3 01", "php 3 01", r"php net license 3 01"),
    ("ruby", r"ruby license", "ruby", r"ruby lang org en about license"),
    ("openssl", r"openssl license", "openssl", r"openssl org source license"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", r"postgresql org about licence"),
    ("ms-pl", r"microsoft public license", "ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "ms rl", r"opensource org licenses? ms rl"),
    ("upl-1.0", r"universal permissive license(?: version| v)?(?: 1(?: 0)?)?", "upl 1 0", r"opensource org licenses? upl"),
    ("ncsa", r"university of illinois (?:ncsa )?open source license", "ncsa", r"opensource org licenses? ncsa"),
    ("ofl-1.1", r"sil open font license(?: version| v)?(?: 1 1)?", "ofl 1 1", r"scripts sil org ofl"),
    ("ccdl", r"open data commons attribution license", "odc by 1 0", r"opendatacommons org licenses by"),
    ("odbl-1.0", r"open (?:data commons open )?database license", "odbl 1 0", r"opendatacommons org licenses odbl"),
    ("pddl-1.0", r"(?:open data commons )?public domain dedication and license", "pddl 1 0", r"opendatacommons org licenses pddl"),
    ("sspl-1.0", r"server side public license", "sspl 1 0", r"mongodb com licensing server side public license"),
    ("elastic-2.0", r"elastic license(?: version| v)?(?: 2(?: 0)?)?", "elastic 2 0", r"elastic co licensing elastic license"),
    ("ecl-2.0", r"educational community license(?: version| v)?(?: 2(?: 0)?)?", "ecl 2 0", r"opensource org licenses? ecl 2 0"),
    ("vim", r"vim license", "vim", r"vimhelp org uganda"),
    ("x11", r"x11 license|x consortium license", "x11", r"xfree86 org 3 3 6 copyright2"),
    ("bsl-fsl", r"functional source license", "fsl 1 1", r"fsl software"),
    ("cc0-1.0", r"(?:creative commons (?:zero|cc0)|cc0)(?: universal)?(?: 1 0)?(?: universal)?", "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"creative commons attribution(?! (?:non ?commercial|share ?alike|no ?deriv))(?: \d 0)?|cc by(?! (?:nc|nd|sa)\b)(?: \d 0)?", r"cc by \d 0", r"creativecommons org licenses by \d 0"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: \d 0)?|cc by sa(?: \d 0)?", r"cc by sa \d 0", r"creativecommons org licenses by sa \d 0"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?! (?:share ?alike|no ?deriv))(?: \d 0)?|cc by nc(?! (?:nd|sa)\b)(?: \d 0)?", r"cc by nc \d 0", r"creativecommons org licenses by nc \d 0"),
    ("cc-by-nd", r"creative commons attribution no ?deriv\w+(?: \d 0)?|cc by nd(?: \d 0)?", r"cc by nd \d 0", r"creativecommons org licenses by nd \d 0"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: \d 0)?|cc by nc sa(?: \d 0)?", r"cc by nc sa \d 0", r"creativecommons org licenses by nc sa \d 0"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv\w+(?: \d 0)?|cc by nc nd(?: \d 0)?", r"cc by nc nd \d 0", r"creativecommons org licenses by nc nd \d 0"),
)

#: Sentences of license texts and notices; label, sentence, priority.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 90),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used", 92),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", 92),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", 90),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 95),
    ("gpl", r"gnu general public license|gnu gpl", 40),
    ("lgpl", r"gnu (?:lesser|library) general public license|gnu lgpl", 45),
    ("agpl", r"gnu affero general public license", 45),
    ("gfdl", r"gnu free documentation license", 40),
    ("apache", r"apache license", 30),
    ("mpl", r"mozilla public license", 30),
    ("bsd", r"bsd (?:style )?licen[cs]e", 30),
    ("creative-commons", r"creative commons(?: licen[cs]e)?", 20),
    ("public-domain", r"(?:in|into|to) the public domain|public domain dedication", 50),
    ("proprietary", r"proprietary and confidential|confidential and proprietary|unauthori[sz]ed copying of this file", 60),
    ("commercial", r"commercial licen[cs]e|end user licen[cs]e agreement|eula", 50),
    ("reserved", r"all rights (?:are )?reserved|tous droits r\S{1,3}serv\S{1,3}s|alle rechte vorbehalten|todos los derechos reservados", 35),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", 10),
    ("license-file", r"see (?:the )?(?:file )?(?:license|copying|licence)(?: txt| md)?(?: file)? for (?:more )?(?:details|information|terms)", 15),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keywords: frozenset[bytes]
    regex: re.Pattern


def _rule(label: str, priority: int, score: float, pattern: str) -> Rule:
    keywords = frozenset(_required(pattern))
    return Rule(label, priority, score, keywords, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()))


def _required(pattern: str) -> list[bytes]:
    """Whole words that every match holds: those outside groups, options and alternatives."""
    if re.search(r"\|", re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", pattern)):
        return []
    plain = re.sub(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\??(?:\{[^}]*\}\??)?", "\0", pattern)
    return [w.encode() for w in re.findall(r"(?:(?<= )|^)[a-z0-9]+(?=(?: |$))", plain) if len(w) > 1]


GRANT = r"(?:licensed|released|distributed|available|provided|published|made available)(?: to you)? (?:under|by|with)(?: the)?(?: terms (?:and conditions )?of(?: the)?)?"


def build_rules() -> list[Rule]:
    """Four rules a family, as named: granted, named, by identifier, by address; then the notices."""
    rules = []
    for label, name, spdx, url in FAMILIES:
        rules += [
            _rule(label, 80, 1.0, rf"{GRANT} (?:{name})"),
            _rule(label, 60, 0.8, name),
            _rule(label, 90, 1.0, rf"spdx license identifier (?:{spdx})"),
            _rule(label, 70, 0.9, url),
        ]
    rules += [_rule(label, priority, min(1.0, 0.3 + priority / 140), p) for label, p, priority in NOTICES]
    return sorted(rules, key=lambda r: -r.priority)


RULES = build_rules()
#: A text without any of these words holds no detection. Each rule's every match has one of them.
GATE = frozenset(
    b"license licence licenses licensed licensing spdx copyright reserved cc cc0 gpl gplv2 gplv3 v2 v3 lgpl lgplv2 lgplv3"
    b" agpl agplv3 gnu unlicense wtfpl creative creativecommons domain permission redistribution advertising contributors"
    b" software proprietary eula oracle sil unauthorized unauthorised confidential apache mozilla bsd attribution psf vorbehalten"
    b" reservados droits copying zlib opendatacommons eclipse fsl vimhelp xfree86 mariadb europa clause".split()
)


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def detect(line: bytes, present: set[bytes]) -> list[Detection]:
    """What the rules find in the spaced words, overlaps resolved, in order of place."""
    found = [
        Detection(m.start(), m.end(), rule)
        for rule in RULES
        if rule.keywords <= present
        for m in rule.regex.finditer(line)
    ]
    found.sort(key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label))
    # Kept ones do not overlap, so that only the neighbours of a place can reach into it.
    kept: list[Detection] = []
    starts: list[int] = []
    for d in found:
        i = bisect_right(starts, d.start)
        # Inside a kept one, or across its border: what was kept first has the higher rank.
        if (i == 0 or kept[i - 1].end <= d.start) and (i == len(kept) or starts[i] >= d.end):
            kept.insert(i, d)
            starts.insert(i, d.start)
    return kept


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand in a row."""
    out, number, before = [], 0, 0
    at = line.find(b" " + phrase + b" ")
    while at >= 0:
        number, before = number + line.count(b" ", before, at), at
        out.append(number)
        at = line.find(b" " + phrase + b" ", at + 1)
    return out


def scan(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    w = words(text)
    if GATE.isdisjoint(w):
        return len(w), 0, None, None, "", "", 0.0
    line = b" " + b" ".join(w) + b" "
    base = [(p, label) for phrase, label in BASE for p in places(line, phrase.encode())]
    hits = detect(line, set(w))
    at = [p for p, _ in base]
    base_labels = {label for _, label in base}
    labels = base_labels | {d.rule.label for d in hits}
    score = max([0.5 * bool(base), *[d.rule.score for d in hits]])
    join = lambda x: ",".join(sorted(x))
    return len(w), len(base), min(at, default=None), max(at, default=None), join(base_labels), join(labels), score


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(docs: DataFrame, column: str = "text") -> DataFrame:
    """``row`` (the input) and what was found in its whole text, see ``FIELDS``.

    ``first_word`` and ``last_word`` are null without a base phrase, label lists are empty strings
    without a label, the score is the surest detection's. A null or empty text has no words.
    Repeated rows are scanned alike; no rows give no rows.
    """

    def make():
        return lambda texts: [list(c) for c in zip(*map(scan, texts), strict=True)] if texts else [[]] * len(FIELDS)

    return annotate(docs, column, make, FIELDS)
