"""Every licence rule runs on the texts that its own pattern describes."""
import random
import re
from itertools import islice, product

import pytest

from pixelloom.llm import licenses


def strings(tree):
    """Texts that a parsed pattern matches: every branch and option, the ends of every class."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append(["5"] if str(arg[0][0]) == "CATEGORY" else [chr(v) for o, a in arg for v in (a if str(o) == "RANGE" else (a,))])
        elif name == "MAX_REPEAT":
            parts.append([s * n for n in {arg[0], min(arg[1], arg[0] + 1)} for s in strings(arg[2])])
        elif name == "SUBPATTERN":
            parts.append(list(strings(arg[3])))
        elif name == "BRANCH":
            parts.append([s for b in arg[1] for s in strings(b)])
        else:
            raise NotImplementedError(name)
    return ("".join(p) for p in product(*parts))


def test_every_name_reaches_its_rules():
    for label, keywords, *names in licenses.NAMES:
        for name in names:
            for text in strings(re._parser.parse(name)):
                assert set(keywords.split()) & set(text.split()), (name, text)
                assert any(d["label"] == label for d in licenses.scan(f"spdx license identifier {text}")[7]), (name, text)


def test_every_rule_runs():
    for r in licenses.rules():
        for text in islice(strings(re._parser.parse(r.pattern.pattern.decode()[6:-5])), 200):
            assert set(r.keywords) & set(text.encode().split()), (r.pattern, text)


@pytest.mark.parametrize("text, label", [
    ("Licensed under GPLv3", "gpl"), ("Licensed under LGPLv2", "lgpl"), ("Licensed under AGPLv3", "agpl"), ("Released under the EUPLv1.2", "eupl"),
    ("SPDX-License-Identifier: 0BSD", "bsd"), ("Licensed under ASL 2.0", "apache"), ("Licensed under the Expat license", "mit"),
    ("Creative Commons Attribution Non-Commercial 4.0", "cc-by-nc"), ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa"),
])
def test_names_within_words(text, label):
    out = licenses.scan(text)
    assert out[5] == label and out[6] > 0


def test_a_rule_with_two_keywords_in_a_text_counts_once():
    assert len(licenses.scan("Licensed under GPLv3 and licensed under LGPLv3 or GPL")[7]) == 3


def test_sentences_without_a_name():
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    assert licenses.scan(body)[4:6] == ("", "mit") and licenses.scan(body)[7][0]["rule"] == "mit:sentence:0"
    assert licenses.scan("Redistribution and use in source and binary forms, with or without\n modification, are permitted")[5] == "bsd"
    assert licenses.scan("you can redistribute it and permission was granted")[5] == ""
    assert len({r.id for r in licenses.rules()}) == len(licenses.rules())


def test_suppression_against_all_pairs():
    rng = random.Random(3)
    rules = {p: licenses.Rule(f"r{p}", None, "x", p, 0.5, (), False) for p in range(4)}
    for _ in range(300):
        hits = []
        for _ in range(rng.randrange(1, 25)):
            p, a = rng.randrange(4), rng.randrange(30)
            hits.append((p, a, a + rng.randrange(1, 12), rules[p]))
        within = lambda h, o: o[1] <= h[1] and h[2] <= o[2]
        want = {h[:3] for h in hits if not any(within(h, o) and (o[0] > h[0] or (o[0] == h[0] and o[2] - o[1] > h[2] - h[1])) for o in hits)}
        assert {h[:3] for h in licenses._survivors(hits)} == want
