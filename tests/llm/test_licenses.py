"""The license scan against Python's regular expressions."""

import re
import sys

import pytest

from seawake.llm.licenses import BASE, GATES, rules, scan_licenses

LINES = [
    (1, "Licensed under CC BY-NC 4.0."),
    (2, "cc by. CC-BY! cc by nd and c c by"),
    (3, "This work is licensed under the GNU General Public License, version 3. All rights reserved."),
    (4, "SPDX-License-Identifier: Apache-2.0\nlicensed under the Apache License, Version 2.0"),
    (5, "Released under the MIT License. licence. " * 30),
    (6, "the mit is a school, apache a helicopter"),
    (7, None),
    (8, ""),
    (9, "İK all rightſ reserved, Kelvin K cc by"),
    (10, "No license at all"),
    (11, "dedicated to the public domain"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def base(text):
    w, found = words(text), []
    for phrase, label in BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def labels(text):
    """Every rule at every place, then containment and priority, one interval against all others."""
    norm, hits, named = " " + " ".join(words(text)) + " ", [], {x for x in base(text)[4].split(",") if x}
    if not any(g in norm for g in GATES):
        return ",".join(sorted(named))
    for r in rules():
        if not r["base"] and r["keyword"] in norm:
            for m in re.finditer(r["pattern"], norm):
                s = norm[: m.start()].count(" ") - 1
                hits.append((s, s + m[0].count(" "), r["priority"], r["label"]))
    order = sorted(hits, key=lambda h: (h[0], -h[1], h[2], h[3]))
    alive, end = [], -1
    for h in order:
        if h[1] > end:
            alive.append(h)
        end = max(end, h[1])
    for i, h in enumerate(alive):
        before = i > 0 and alive[i - 1][1] >= h[0] and alive[i - 1][2] < h[2]
        after = i + 1 < len(alive) and alive[i + 1][0] <= h[1] and alive[i + 1][2] < h[2]
        if not before and not after:
            named.add(h[3])
    return ",".join(sorted(named))


def check(df):
    got = scan_licenses(df).collect()
    assert len(got) == df.count()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert r.labels == labels(texts[r.doc_id])
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    return {r.doc_id: r for r in got}


def test_lines(spark):
    got = check(spark.createDataFrame(LINES, "doc_id long, text string"))
    assert got[1].labels == "cc-by,cc-by-nc-4.0"
    assert got[3].labels == "gpl,gpl-3,reserved"
    assert got[4].labels == "apache-2.0"
    assert got[5].labels == "mit" and got[6].labels == ""


def test_tables(given, docs, none, repeated):
    check(given("documents"))
    check(docs)
    assert scan_licenses(none).count() == 0
    assert scan_licenses(repeated).count() == repeated.count()


def test_rules_are_many_and_distinct():
    r = rules()
    assert len(r) > 300 and len({(x["pattern"], x["base"]) for x in r}) == len(r)
    assert all(re.search(x["pattern"], " ") is None for x in r)


def expand(parsed):
    """Every text a rule's pattern matches; of a free word one."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name == "IN":
            ways = [chr(v) for o, v in arg if str(o) == "LITERAL"] or ["q"]
        elif name == "BRANCH":
            ways = [x for branch in arg[1] for x in expand(branch)]
        elif name == "SUBPATTERN":
            ways = expand(arg[3])
        elif name == "MAX_REPEAT":
            ways = [""] * (arg[0] == 0) + expand(arg[2])
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            ways = [""]
        out = [a + b for a in out for b in ways]
    return out


@pytest.fixture
def no_gate(monkeypatch):
    """The brute force tries every rule on every text."""
    monkeypatch.setattr(sys.modules[__name__], "GATES", ("",))


def test_every_match_holds_keyword_and_gate():
    for r in rules():
        for text in expand(re._parser.parse(r["pattern"])):
            assert re.search(r["pattern"], f" {text} ")
            assert r["keyword"] in f" {text} " and any(g in f" {text} " for g in GATES), (text, r)


def test_every_rule_fires_alone(spark, no_gate):
    """Texts that hold the shortest and the longest match of one rule and nothing else."""
    texts = {f(expand(re._parser.parse(r["pattern"])), key=len) for r in rules() for f in (min, max)}
    got = check(spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string"))
    assert len(got) == len(texts) and all(r.labels and r.score > 0 for r in got.values())


def test_statements_without_the_word_license(spark, no_gate):
    lines = {
        "Distributed under the GNU GPL version 3": "gpl-3",
        "available under the Apache 2.0": "apache-2.0",
        "published under MIT": "mit",
        "CC0 1.0 Universal": "cc0",
        "Proprietary and confidential": "proprietary",
        "not without the express written permission": "proprietary",
    }
    got = check(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert [got[i].labels for i in range(len(lines))] == list(lines.values())


def test_tables_without_gate(given, docs, no_gate):
    check(given("documents"))
    check(docs)
