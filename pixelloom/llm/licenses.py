"""License scans: ordered signature rules over the word sequence of a text.

A rule is a regular expression over the lower-cased words joined by single spaces, with an id, a label, a priority, a confidence and
keywords, one of which is a word of every text that the rule can match. A rule runs only where a keyword is among the words. The rules
are, in order: the base phrases, sentences of license texts, and every name of a license in every context that makes it a statement. Of overlapping
detections, one that lies within a detection of higher priority, or within a longer one of the same priority, is suppressed.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Rule(NamedTuple):
    id: str
    pattern: re.Pattern
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    base: bool


#: Phrases whose every place counts, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, a word of the sentence, sentence of the license's own text as it stands in word sequences (regular expressions).
SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby", "permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "endorse", "may be used to endorse or promote products derived from this software"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache", "unless", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "granted", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "subject", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("boost", "organization", "granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "waives", "waives all of his or her rights to the work worldwide under copyright law"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("psf", "psf", "psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("php", "php", "this product includes php software freely available from"),
    ("postgresql", "agreement", "to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("artistic", "artistic", "you may distribute under the terms of either the gnu general public license or the artistic license"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|program|document)"),
    ("proprietary", "disclosed", "may not be (?:reproduced|copied) or disclosed"),
    ("proprietary", "trade", "contains trade secrets"),
)

#: Label, keywords (every name holds one of them as a whole word), names as they stand in word sequences (regular expressions).
NAMES = (
    ("mit", "mit expat", "mit", "mit x11", "expat"),
    ("apache", "apache asl", "apache", "apache (?:software )?license version \\d(?: \\d)?", "apache 2 0", "asl 2 0"),
    ("gpl", "gpl gpl2 gpl3 gplv2 gplv3", "gpl", "gnu gpl", "gpl ?v?[23](?: 0)?(?: or later| only)?"),
    ("gpl", "gnu", "gnu general public license(?: version [23])?", "gnu public license"),
    ("lgpl", "lgpl lgpl2 lgpl3 lgplv2 lgplv3", "lgpl", "gnu lgpl", "lgpl ?v?[23](?: [01])?(?: or later| only)?"),
    ("lgpl", "lesser", "lesser general public license", "gnu lesser general public license"),
    ("lgpl", "library", "library general public license"),
    ("agpl", "agpl agpl3 agplv3", "agpl", "gnu agpl", "agpl ?v?3(?: 0)?"),
    ("agpl", "affero", "affero general public license", "gnu affero general public license"),
    ("gfdl", "documentation", "gnu free documentation license", "free documentation license"),
    ("bsd", "bsd 0bsd", "bsd", "bsd [234] clause", "(?:simplified|modified|new|revised) bsd", "[234] clause bsd", "0bsd"),
    ("isc", "isc", "isc", "isc style"),
    ("mpl", "mozilla", "mozilla public license(?: version)?(?: \\d \\d)?"),
    ("mpl", "mpl", "mpl", "mpl [12] [01]"),
    ("epl", "eclipse", "eclipse public license(?: v)?(?: \\d \\d)?"),
    ("epl", "epl", "epl", "epl [12] 0"),
    ("cddl", "cddl", "cddl", "cddl 1 [01]"),
    ("cddl", "distribution", "common development and distribution license"),
    ("cpl", "common", "common public license"),
    ("artistic", "artistic", "artistic license(?: 2 0)?", "perl artistic"),
    ("zlib", "zlib", "zlib", "zlib libpng"),
    ("boost", "boost", "boost software license", "boost"),
    ("bsl", "business", "business source license(?: 1 1)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("psf", "python", "python software foundation license", "python license"),
    ("openssl", "openssl", "openssl", "openssl ssleay"),
    ("ofl", "font", "sil open font license", "open font license(?: 1 1)?"),
    ("ofl", "ofl", "ofl", "ofl 1 1"),
    ("eupl", "eupl eupl1 euplv1", "eupl", "eupl ?v?1 [12]"),
    ("eupl", "union", "european union public license"),
    ("cecill", "cecill", "cecill", "cecill [bc2]"),
    ("mspl", "microsoft", "microsoft public license", "microsoft reciprocal license"),
    ("postgresql", "postgresql", "postgresql"),
    ("php", "php", "php license(?: 3 01)?"),
    ("vim", "vim", "vim license"),
    ("cc0", "cc0", "cc0", "cc0 1 0"),
    ("cc0", "zero", "creative commons zero", "creative commons cc zero"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: \\d \\d)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: \\d \\d)?"),
    ("cc-by-nc", "cc", "cc by nc(?: \\d \\d)?"),
    ("cc-by-nd", "cc", "cc by nd(?: \\d \\d)?"),
    ("cc-by-sa", "cc", "cc by sa(?: \\d \\d)?"),
    ("cc-by", "cc", "cc by(?: \\d \\d)?"),
    ("cc-by-nc-nd", "attribution", "creative commons attribution non ?commercial no ?deriv[a-z]+(?: \\d \\d)?"),
    ("cc-by-nc-sa", "attribution", "creative commons attribution non ?commercial share ?alike(?: \\d \\d)?"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial(?: \\d \\d)?"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike(?: \\d \\d)?"),
    ("cc-by", "attribution", "creative commons attribution(?: \\d \\d)?"),
    ("odbl", "database", "open database license"),
    ("pddl", "domain", "public domain dedication and license"),
    ("public-domain", "domain", "public domain"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary"),
    ("proprietary", "confidential", "proprietary and confidential"),
)

#: Contexts that make a name a license statement: text before, text after, priority, confidence.
CONTEXTS = (
    ("spdx license identifier ", "", 5, 1.0),
    ("(?:licensed|released|distributed|published|available|provided|shared|offered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", "(?: (?:public |software )?licen[cs]e)?", 4, 0.95),
    ("(?:subject|according|pursuant) to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", "(?: licen[cs]e)?", 4, 0.9),
    ("licen[cs]e (?:is )?(?:the )?", "", 3, 0.7),
    ("", " licen[cs]e[ds]?", 3, 0.8),
    ("", "", 1, 0.4),
)

#: Names that are words of ordinary prose and count only in a context.
_NEEDS_CONTEXT = {"boost", "proprietary", "expat", "mit", "apache", "isc", "postgresql", "zlib", "openssl", "bsd"}


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """The rules in order: base phrases, sentences, then every name in every context. An id is a license, a kind and a number."""
    make = lambda p: re.compile(b"(?<= )" + p.encode() + b"(?= )")
    out = [Rule(f"{label}:base", make(p), label, 3, 0.8, (p.split()[0].encode(),), True) for p, label in BASE]
    out += [Rule(f"{label}:sentence:{i}", make(p), label, 5, 0.95, (word.encode(),), False) for i, (label, word, p) in enumerate(SENTENCES)]
    for i, (label, keywords, *names) in enumerate(NAMES):
        for j, (before, after, priority, confidence) in enumerate(CONTEXTS):
            used = [n for n in names if before or after or n not in _NEEDS_CONTEXT]
            out += [Rule(f"{label}:name:{i}.{k}.{j}", make(before + n + after), label, priority, confidence, tuple(keywords.encode().split()), False) for k, n in enumerate(used)]
    return tuple(out)


@lru_cache(maxsize=1)
def _gates() -> dict[bytes, list[int]]:
    """The numbers of the rules that a word lets run."""
    gates = defaultdict(list)
    for i, r in enumerate(rules()):
        for k in r.keywords:
            gates[k].append(i)
    return dict(gates)


def _survivors(hits: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """hits: (priority, start, end, rule). Those that lie within no hit of higher priority nor a longer one of the same."""
    out, starts, ends = [], [], []
    by = defaultdict(list)
    for h in hits:
        by[h[0]].append(h)
    for p in sorted(by, reverse=True):
        level, reach = [], -1
        for h in sorted(by[p], key=lambda h: (h[1], -h[2])):
            k = bisect_right(starts, h[1]) - 1
            if h[2] > reach and not (k >= 0 and ends[k] >= h[2]):
                level.append(h)
            reach = max(reach, h[2])
        out += level
        both = sorted([*zip(starts, ends), *((h[1], h[2]) for h in level)])
        starts, ends, top = [], [], -1
        for s, e in both:
            top = max(top, e)
            starts.append(s)
            ends.append(top)
    return out


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of one text."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    gates = _gates()
    present = gates.keys() & set(words)
    if not present:
        return len(words), 0, None, None, "", "", 0.0, []
    line = b" " + b" ".join(words) + b" "
    hits, base = [], []
    for i in sorted({i for k in present for i in gates[k]}):
        r = rules()[i]
        for m in r.pattern.finditer(line):
            (base if r.base else hits).append((r.priority, m.start(), m.end(), r))
    kept = _survivors(hits + base)
    at = lambda pos: line.count(b" ", 0, pos) - 1
    first = at(min(h[1] for h in base)) if base else None
    last = at(max(h[1] for h in base)) if base else None
    base_labels = {h[3].label for h in base}
    labels = base_labels | {h[3].label for h in kept}
    found = [{"rule": h[3].id, "label": h[3].label, "start": h[1] - 1, "end": h[2] - 1, "score": h[3].confidence} for h in sorted(kept, key=lambda h: h[1:3])]
    score = max((h[3].confidence for h in kept), default=0.8 if base else 0.0)
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found


_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<rule:string,label:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("detections", pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: counts, places, labels and the surviving detections (byte ranges in the joined words).
    Null and empty texts have no words, no labels and score 0; repeated rows are scanned alike; other columns are ignored; texts of any length
    are scanned whole; an empty table gives an empty result."""

    def run(batches):
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, list(_ARROW)[1:]))], schema=_ARROW)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCHEMA)
