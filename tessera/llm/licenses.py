"""License scans: ordered signature rules behind a keyword gate, overlaps settled by priority and containment."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import ascii_words, map_texts, prepare

#: Names of licenses as they are written, in normalised words, with their labels (fixed values). ``V`` is a version.
NAMES = {
    "mit": ["mit license", "mit licence", "expat license", "x11 license"],
    "apache": ["apache license", "apache licence", "apache software license"],
    "gpl": ["general public license", "general public licence", "gnu gpl"],
    "lgpl": ["lesser general public license", "library general public license", "gnu lgpl"],
    "agpl": ["affero general public license", "gnu agpl"],
    "bsd": ["bsd license", "bsd licence", "berkeley software distribution"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "bsd-4-clause": ["bsd 4 clause", "4 clause bsd", "original bsd"],
    "0bsd": ["zero clause bsd", "0bsd"],
    "isc": ["isc license", "isc licence"],
    "mpl": ["mozilla public license", "mozilla public licence"],
    "epl": ["eclipse public license", "eclipse public licence"],
    "edl": ["eclipse distribution license"],
    "cddl": ["common development and distribution license"],
    "cpl": ["common public license"],
    "cpal": ["common public attribution license"],
    "artistic": ["artistic license", "artistic licence"],
    "zlib": ["zlib license", "zlib libpng license"],
    "libpng": ["libpng license"],
    "bsl": ["boost software license"],
    "busl": ["business source license"],
    "unlicense": ["the unlicense"],
    "wtfpl": ["do what the fuck you want to public license"],
    "cc0": ["cc0 1 0", "creative commons zero", "cc zero"],
    "cc-by": ["cc by V", "creative commons attribution V", "creative commons attribution license"],
    "cc-by-sa": ["cc by sa V", "creative commons attribution share ?alike V"],
    "cc-by-nd": ["cc by nd V", "creative commons attribution no ?derivatives V"],
    "cc-by-nc": ["cc by nc V", "creative commons attribution non ?commercial V"],
    "cc-by-nc-sa": ["cc by nc sa V", "creative commons attribution non ?commercial share ?alike V"],
    "cc-by-nc-nd": ["cc by nc nd V", "creative commons attribution non ?commercial no ?derivatives V"],
    "odbl": ["open database license", "odc odbl"],
    "odc-by": ["open data commons attribution license", "odc by"],
    "pddl": ["public domain dedication and license"],
    "ofl": ["open font license", "sil ofl"],
    "eupl": ["european union public licence", "european union public license"],
    "osl": ["open software license"],
    "afl": ["academic free license"],
    "ecl": ["educational community license"],
    "upl": ["universal permissive license"],
    "ms-pl": ["microsoft public license"],
    "ms-rl": ["microsoft reciprocal license"],
    "postgresql": ["postgresql license", "postgresql licence"],
    "python": ["python software foundation license", "psf license"],
    "php": ["php license"],
    "ruby": ["ruby license"],
    "vim": ["vim license"],
    "curl": ["curl license"],
    "openssl": ["openssl license"],
    "ncsa": ["university of illinois ncsa open source license", "ncsa open source license"],
    "fdl": ["free documentation license"],
    "lppl": ["latex project public license"],
    "qpl": ["q public license"],
    "rpl": ["reciprocal public license"],
    "sspl": ["server side public license"],
    "elastic": ["elastic license"],
    "polyform": ["polyform noncommercial license", "polyform small business license"],
    "mulan": ["mulan permissive software license", "mulan psl"],
    "cecill": ["cecill free software license", "cecill license"],
    "etalab": ["etalab open license", "licence ouverte"],
    "ogl": ["open government licence", "open government license"],
    "openrail": ["open rail m license", "openrail m", "responsible ai license"],
    "llama": ["llama community license"],
    "gemma": ["gemma terms of use"],
    "public-domain": ["public domain"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
}

#: Tags of the short identifier form, in normalised words, with their labels (fixed values).
TAGS = {
    "mit": "mit( 0)?", "apache": "apache( 1 1| 2 0)?", "gpl": "gpl [123] 0( only| or later)?", "lgpl": "lgpl (2 0|2 1|3 0)( only| or later)?",
    "agpl": "agpl [13] 0( only| or later)?", "bsd-2-clause": "bsd 2 clause( patent)?", "bsd-3-clause": "bsd 3 clause( clear)?", "bsd-4-clause": "bsd 4 clause",
    "0bsd": "0bsd", "isc": "isc", "mpl": "mpl (1 0|1 1|2 0)", "epl": "epl [12] 0", "cddl": "cddl 1 [01]", "artistic": "artistic [12] 0", "zlib": "zlib",
    "bsl": "bsl 1 0", "unlicense": "unlicense", "cc0": "cc0 1 0", "cc-by": "cc by [1234] [05]", "cc-by-sa": "cc by sa [1234] [05]",
    "cc-by-nd": "cc by nd [1234] [05]", "cc-by-nc": "cc by nc [1234] [05]", "cc-by-nc-sa": "cc by nc sa [1234] [05]", "cc-by-nc-nd": "cc by nc nd [1234] [05]",
    "odbl": "odbl 1 0", "ofl": "ofl 1 [01]", "eupl": "eupl 1 [012]", "osl": "osl 3 0", "afl": "afl 3 0", "ecl": "ecl 2 0", "upl": "upl 1 0",
    "ms-pl": "ms pl", "ms-rl": "ms rl", "postgresql": "postgresql", "python": "(python|psf) 2 0", "ncsa": "ncsa", "lppl": "lppl 1 3c?", "sspl": "sspl 1 0",
    "busl": "busl 1 1", "wtfpl": "wtfpl", "fdl": "gfdl 1 [123]( only| or later)?", "mulan": "mulanpsl [12] 0", "cecill": "cecill( b| c)?( [12] [01])?",
}

#: Sentences of license texts and addresses, in normalised words: label, regex, keywords that must all occur (fixed values).
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ["permission", "granted"]),
    ("mit", r"opensource org licenses mit", ["opensource"]),
    ("apache", r"(www )?apache org licenses license 2 0", ["apache"]),
    ("apache", r"unless required by applicable law or agreed to in writing software", ["unless", "applicable"]),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", ["redistribute", "gnu"]),
    ("gpl", r"(www )?gnu org licenses (old licenses )?gpl", ["gnu"]),
    ("lgpl", r"(www )?gnu org licenses (old licenses )?lgpl", ["gnu"]),
    ("agpl", r"(www )?gnu org licenses agpl", ["gnu"]),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ["redistribution"]),
    ("bsd-3-clause", r"neither the name of( \S+){1,12} nor the names of its contributors may be used", ["neither", "contributors"]),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", ["advertising"]),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission", "granted"]),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", ["mozilla"]),
    ("mpl", r"(www )?mozilla org mpl", ["mozilla"]),
    ("epl", r"(www )?eclipse org legal epl", ["eclipse"]),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["warranty"]),
    ("bsl", r"(www )?boost org license 1 0", ["boost"]),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ["unencumbered"]),
    ("cc0", r"creativecommons org publicdomain zero", ["creativecommons"]),
    *[(f"cc-{k}", rf"creativecommons org licenses {k.replace('-', ' ')} \d", ["creativecommons"]) for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")],
    ("ofl", r"scripts sil org ofl", ["ofl"]),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["permission", "gnu"]),
    ("warranty-disclaimer", r"without warranty of any kind express or implied", ["warranty"]),
    ("warranty-disclaimer", r"provided on an as is basis without warranties or conditions of any kind", ["warranties"]),
    ("copyright", r"copyright (c )?(19|20)\d\d( (19|20)\d\d)*( by)?( \S+){0,3}", ["copyright"]),
    ("copyright", r"c copyright (19|20)\d\d", ["copyright"]),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized"]),
]

#: Short forms that developers write, in normalised words: label, regex, keyword (fixed values).
SHORT = [
    ("gpl", r"gpl ?v ?[123](?: 0)?(?: or later| only| plus)?", "gpl"),
    ("gpl", r"gpl [123] 0(?: or later| only| plus)?", "gpl"),
    ("gpl", r"gpl [123] (?:or later|only)", "gpl"),
    ("gpl", r"(?:under|under the|gnu) gpl", "gpl"),
    ("lgpl", r"lgpl ?v ?[23](?: [01])?(?: or later| only| plus)?", "lgpl"),
    ("lgpl", r"lgpl (?:2 0|2 1|3 0)(?: or later| only| plus)?", "lgpl"),
    ("lgpl", r"lgpl [23] (?:or later|only)", "lgpl"),
    ("lgpl", r"(?:under|under the|gnu) lgpl", "lgpl"),
    ("agpl", r"agpl ?v ?[13](?: 0)?(?: or later| only| plus)?", "agpl"),
    ("agpl", r"agpl [13] 0(?: or later| only| plus)?", "agpl"),
    ("agpl", r"(?:under|under the|gnu) agpl", "agpl"),
    ("apache", r"apache v?2 0", "apache"),
    ("apache", r"apache ?v2", "apache"),
    ("apache", r"under (?:the )?apache(?: 2)?", "apache"),
    ("apache", r"asl 2 0", "asl"),
    ("mit", r"under (?:the )?mit", "under"),
    ("mit", r"mit x11", "x11"),
    ("mit", r"mit licen[cs]ed", "licen"),
    ("isc", r"under (?:the )?isc", "under"),
    ("isc", r"isc licen[cs]ed", "licen"),
    ("zlib", r"under (?:the )?zlib", "zlib"),
    ("bsd", r"under (?:the |a )?bsd", "bsd"),
    ("bsd", r"bsd style(?: licen[cs]e)?", "bsd"),
    ("bsd-2-clause", r"bsd 2 licen[cs]e", "bsd"),
    ("bsd-3-clause", r"bsd 3 licen[cs]e", "bsd"),
    ("mpl", r"mpl ?v? ?[12] [01]", "mpl"),
    ("epl", r"epl ?v? ?[12] 0", "epl"),
    ("cddl", r"cddl ?v? ?1 [01]", "cddl"),
    ("artistic", r"artistic [12] 0", "artistic"),
    ("bsl", r"bsl 1 0", "bsl"),
    ("busl", r"busl 1 1", "busl"),
    ("eupl", r"eupl ?v? ?1 [012]", "eupl"),
    ("ofl", r"ofl 1 [01]", "ofl"),
    ("sspl", r"sspl(?: v?1(?: 0)?)?", "sspl"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("unlicense", r"under (?:the )?unlicense", "unlicense"),
    ("cc0", r"under (?:the )?cc0", "cc0"),
    ("public-domain", r"dedicated to the public domain", "public"),
]

#: The base phrases (fixed values) are the first name of their licenses.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_VERSION = r"(?: (?:version|v) ?\d+(?: \d+)?| v?\d+(?: \d+)?)"
_INTRO = r"(?:licensed|released|distributed|available|published|provided|made available) (?:under|with) (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?(?:gnu )?"


class Rule(NamedTuple):
    """A signature: the regex runs over words joined by spaces, only where every keyword occurs."""

    name: str
    label: str
    priority: int
    weight: float
    keywords: tuple[bytes, ...]
    regex: re.Pattern


def _keyword(pattern: str) -> str:
    """The longest literal word of a pattern, which any match holds."""
    return max(re.findall(r"(?<![\w?(|])[a-z0-9]{3,}(?![\w?|)])", pattern) or [""], key=len)


def build_rules() -> list[Rule]:
    """All signatures, the strongest first: tags, sentences, then names after an introduction, with a version, short forms, and names alone."""
    out: list[Rule] = []

    def add(name, label, priority, weight, pattern, keywords):
        out.append(Rule(name, label, priority, weight, tuple(k.encode() for k in keywords if k), re.compile(rf"(?<!\S)(?:{pattern})(?!\S)".encode())))

    for label, tag in TAGS.items():
        add(f"tag:{label}", label, 90, 1.0, f"spdx license identifier {tag}", ["spdx"])
        add(f"field:{label}", label, 70, 0.9, f"licen[cs]e {tag}", ["licen"])
    for i, (label, text, keywords) in enumerate(TEXTS):
        add(f"text:{label}:{i}", label, 80, 0.95, text, keywords)
    for i, (label, short, keyword) in enumerate(SHORT):
        add(f"short:{label}:{i}", label, 45, 0.7, short, [keyword])
    for label, names in NAMES.items():
        for i, written in enumerate(names):
            name, keyword = written.replace(" V", r" \d(?: \d)?"), _keyword(written.replace(" V", ""))
            add(f"intro:{label}:{i}", label, 60, 0.9, f"{_INTRO}{name}(?:{_VERSION})?", [keyword, "under" if label != "proprietary" else ""])
            if " V" not in written:
                add(f"version:{label}:{i}", label, 50, 0.8, f"{name}{_VERSION}", [keyword])
            add(f"name:{label}:{i}", label, 40, 0.6 if label not in ("public-domain", "proprietary") else 0.4, name, [keyword])
    # the same order in every run: priority, then the longer pattern, then the name
    return sorted(out, key=lambda r: (-r.priority, -len(r.regex.pattern), r.name))


#: What any signature holds, in normalised words (fixed values): a text without any of them is not matched further.
GATE = [
    b"license", b"licence", b"spdx", b"copyright", b"public domain", b"warrant", b"redistribut", b"permission", b"creative", b"unencumbered",
    b"unauthorized", b"advertising", b"unless", b"bsd", b"cc by", b"cc zero", b"cc0", b"gnu", b"openrail", b" psl", b"ofl", b"ouverte", b"gemma terms",
    b"odc ", b"apache", b"mozilla", b"eclipse", b"boost", b"rights reserved", b"proprietary", b"opensource", b"berkeley", b"neither the name",
    b"gpl", b"asl 2", b"under mit", b"under the mit", b"mit x11", b"under isc", b"under the isc", b"zlib", b"mpl", b"epl", b"cddl", b"artistic", b"bsl", b"busl", b"eupl", b"sspl", b"wtfpl",
]


class _Reach:
    """Of spans put in, the furthest end among those that begin at or before a place; in logarithmic time."""

    def __init__(self, starts: list[int]):
        self.rank = {x: i + 1 for i, x in enumerate(sorted(set(starts)))}
        self.best = [-1] * (len(self.rank) + 1)

    def put(self, start: int, end: int) -> None:
        i = self.rank[start]
        while i < len(self.best):
            self.best[i] = max(self.best[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        i, found = self.rank[start], -1
        while i:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def detect(words: list[bytes], rules: list[Rule], gate: bool = True) -> list[tuple[int, int, Rule, bool]]:
    """(first word, last word, rule, kept) of every match, by place.

    A match is suppressed if a match of higher priority, or of the same priority and longer, contains it; of equal
    spans at one priority the earlier rule's stays. A copyright notice takes words after the year as its holder, so it
    suppresses notices only, no license. Places are met in an array of the words' starts, and containment by the furthest
    end before a place, so the time grows with the text and its matches.
    """
    text = b" ".join(words)
    if gate and not any(k in text for k in GATE):
        return []
    found: list[tuple[int, int, Rule]] = []
    present: dict[bytes, bool] = {}
    spaces = None
    for rule in rules:
        ok = True
        for k in rule.keywords:
            if k not in present:
                present[k] = k in text
            ok = ok and present[k]
        if ok and (spans := [m.span() for m in rule.regex.finditer(text)]):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            found += [(int(a), int(b), rule) for a, b in np.searchsorted(spaces, spans)]
    order = sorted(range(len(found)), key=lambda i: (-found[i][2].priority, found[i][0] - found[i][1], found[i][0], i))
    starts = [a for a, _, _ in found]
    licenses, notices = _Reach(starts), _Reach(starts)
    out = []
    for i in order:
        a, b, rule = found[i]
        notice = rule.label == "copyright"
        stays = licenses.upto(a) < b and not (notice and notices.upto(a) >= b)
        if stays:
            (notices if notice else licenses).put(a, b)
        out.append((a, b, rule, stays))
    return sorted(out, key=lambda x: (x[0], x[1], x[2].name))


DETECTION = "struct<first:long,last:long,rule:string,label:string,base:boolean,kept:boolean,weight:double>"


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, detections) for every row of docs.

    detections: each signature's matches as word spans (words from 0), with ``kept`` false where suppressed and
    ``base`` true for a base phrase. Null and empty texts have no words and no detections; repeated rows get equal
    results; very long texts are scanned whole, in time that grows with their length; further columns are not read.
    """
    names = {f"name:{label}:{NAMES[label].index(phrase)}" for phrase, label in BASE.items()}

    def make():
        rules = build_rules()

        def fn(ids, texts):
            n, out = [], []
            for text in texts:
                words = ascii_words(text)
                n.append(len(words))
                out.append([{"first": a, "last": b, "rule": r.name, "label": r.label, "base": r.name in names, "kept": k, "weight": r.weight} for a, b, r, k in detect(words, rules)] if words else [])
            return ids, n, out

        return fn

    prepare(docs.sparkSession)
    return map_texts(docs, f"doc_id long, n_words long, detections array<{DETECTION}>", make, ["doc_id", "text"])
