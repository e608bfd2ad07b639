"""License scan with ordered signature rules, in DataFrame functions only.

A text becomes its words: A-Z lower-cased, runs of ASCII that is neither digit nor letter replaced by
one space.  Gate phrases, taken from the rules, decide which texts can hold a license statement at all;
only those go on.  Each rule has a keyword that must occur before its regular expression is tried.

Every match is an interval of words.  An interval inside another one is suppressed; of equal ones
the rule of the better priority stays.  Of two survivors that overlap in part, the one with the
worse priority goes.  Both are running windows over the intervals of a text, so a text full of
license lines costs no more than sorting them.  Base phrases are found by rules of their own and
never suppressed.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.llm.common import stored

# Phrases and labels of the base
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Hand-written signatures: label, keyword, how the name is written (as words), versions
FAMILIES = (
    ("apache", "apache", "apache(?: software)?", "1.0 1.1 2.0"),
    ("gpl", "general public", "(?:gnu )?general public", "1 2 3 2.0 3.0"),
    ("gpl", " gpl", "(?:gnu )?gpl", "1 2 3 2.0 3.0"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public", "2 2.0 2.1 3 3.0"),
    ("lgpl", " lgpl", "(?:gnu )?lgpl", "2 2.0 2.1 3 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public", "1 3 3.0"),
    ("agpl", " agpl", "(?:gnu )?agpl", "1 3 3.0"),
    ("gfdl", "free documentation", "gnu free documentation", "1.1 1.2 1.3"),
    ("mpl", "mozilla", "mozilla public", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public", "1.0 2.0"),
    ("edl", "eclipse", "eclipse distribution", "1.0"),
    ("cddl", "common development", "common development and distribution", "1.0 1.1"),
    ("cpl", "common public", "common public", "1.0"),
    ("ipl", "ibm public", "ibm public", "1.0"),
    ("apsl", "apple public", "apple public source", "1.0 1.2 2.0"),
    ("artistic", "artistic", "artistic", "1.0 2.0"),
    ("afl", "academic free", "academic free", "1.1 2.0 2.1 3.0"),
    ("osl", "open software", "open software", "1.0 2.0 2.1 3.0"),
    ("eupl", "european union public", "european union public", "1.0 1.1 1.2"),
    ("cecill", "cecill", "cecill", "1.0 2.0 2.1"),
    ("ecl", "educational community", "educational community", "1.0 2.0"),
    ("lppl", "latex project", "latex project public", "1.0 1.2 1.3"),
    ("ms-pl", "microsoft public", "microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", ""),
    ("mit", " mit ", "mit", ""),
    ("mit", " expat ", "expat", ""),
    ("x11", "x11", "x11", ""),
    ("isc", " isc ", "isc", ""),
    ("zlib", "zlib", "zlib(?: libpng)?", ""),
    ("bsl", "boost", "boost software", "1.0"),
    ("busl", "business source", "business source", "1.0 1.1"),
    ("psf", "python", "python(?: software foundation)?", "2 2.0"),
    ("php", " php", "php", "3.0 3.01"),
    ("ruby", " ruby ", "ruby", ""),
    ("openssl", "openssl", "openssl", ""),
    ("ofl", "open font", "(?:sil )?open font", "1.0 1.1"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "what", "do what the fuck you want to public", "1 2"),
    ("0bsd", "bsd", "(?:0|zero) clause bsd", ""),
    ("bsd-2", "bsd", "(?:(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2 clause)", ""),
    ("bsd-3", "bsd", "(?:(?:3|three) clause bsd|new bsd|modified bsd|bsd 3 clause)", ""),
    ("bsd-4", "bsd", "(?:(?:4|four) clause bsd|original bsd|bsd 4 clause)", ""),
    ("bsd", "bsd", "bsd", ""),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("vim", " vim ", "vim", ""),
    ("zpl", "zope", "zope public", "1.1 2.0 2.1"),
    ("upl", "universal permissive", "universal permissive", "1.0"),
    ("odbl", "open database", "(?:odc )?open database", "1.0"),
    ("odc-by", "attribution", "(?:odc|open data commons) attribution", "1.0"),
    ("pddl", "dedication", "public domain dedication and", "1.0"),
    ("sspl", "server side", "server side public", "1 1.0"),
    ("elastic", "elastic", "elastic", "1 2 2.0"),
    ("mulan", "mulan", "mulan(?: permissive software| psl)", "1 2"),
    ("w3c", "w3c", "w3c(?: software(?: notice and)?)?", ""),
    ("json", " json ", "json", ""),
)
CC_PARTS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
OTHERS = (
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 2),
    ("cc0", "cc zero", "cc zero", 2),
    ("cc-unspecified", "creative commons", "creative commons licen[cs]e", 6),
    ("public-domain", "public domain", "(?:in|to|into) the public domain", 4),
    ("public-domain", "public domain", "dedicated to the public domain", 3),
    ("proprietary", "proprietary", "proprietary (?:licen[cs]e|and confidential)", 4),
    ("proprietary", "express written", "without (?:the )?express written (?:permission|consent)", 4),
    ("reserved", "rights reserved", "(?:all|some) rights reserved", 7),
    ("unspecified", "licen", "(?:licen[cs]ed|released|distributed) under (?:the terms of )?(?:the|an|a) [a-z0-9]+ licen[cs]e", 9),
)

_VERBS = ("licen[cs]ed", "released", "distributed", "available", "published", "provided")
_GRANT = f"(?:{'|'.join(_VERBS)}) under (?:the )?(?:terms of )?(?:the )?"
#: every match of a rule that begins with ``_GRANT`` holds one of these
_GRANTED = ("licen", *(f" {v} under " for v in _VERBS[1:]))
_LICENSE = "(?: public)?(?: licen[cs]e)?"


def _words(version: str) -> str:
    return version.replace(".", " ")


def rules() -> list[dict]:
    """All signatures: label, priority (0 is best), keyword, pattern, confidence, and whether it is a base phrase.

    Every match holds the keyword and one of ``gates``.
    """
    out, seen = [], set()

    def add(label, priority, keyword, pattern, base=False, gates=None):
        if (pattern, base) in seen:
            return
        seen.add((pattern, base))
        confidence = 0.5 if base else round(1 - priority / 20, 2)
        rule = dict(label=label, priority=priority, keyword=keyword, base=base, confidence=confidence, pattern=f"(?<= ){pattern}(?= )")
        out.append(rule | {"gates": gates or (keyword,)})

    for phrase, label in BASE:
        add(label, 10, phrase, phrase, base=True)
    for label, keyword, name, versions in FAMILIES:
        add(label, 3, keyword, f"{_GRANT}{name}{_LICENSE}", gates=_GRANTED)
        add(label, 5, keyword, f"{name}(?: public)? licen[cs]e", gates=("licen",))
        add(label, 2, "spdx", f"spdx licen[cs]e identifier {_words(label.replace('-', ' '))}")
        for v in versions.split():
            numbered = f"(?: version| v)? ?{_words(v)}"
            add(f"{label}-{v}", 1, keyword, f"{_GRANT}{name}{_LICENSE}{numbered}", gates=_GRANTED)
            add(f"{label}-{v}", 4, keyword, f"{name}(?: public)? licen[cs]e{numbered}", gates=("licen",))
            add(f"{label}-{v}", 0, "spdx", f"spdx licen[cs]e identifier {_words(label.replace('-', ' '))} {_words(v)}(?: only| or later)?")
    for parts, v in product(CC_PARTS, ("", *CC_VERSIONS)):
        label, tail = f"cc-{parts}" + (f"-{v}" if v else ""), f" {_words(v)}" if v else ""
        short = f"cc {parts.replace('-', ' ')}{tail}"
        full = " ".join(CC_WORDS[p] for p in parts.split("-"))
        add(label, 2 - bool(v), "cc by", f"{_GRANT}{short}")
        add(label, 4 - bool(v), "cc by", short)
        add(label, 3 - bool(v), "creative commons", f"creative commons {full}{tail}(?: international| unported| generic)?")
    for label, keyword, pattern, priority in OTHERS:
        add(label, priority, keyword, pattern)
    return out


#: a text with none of these holds no statement that any rule finds
GATES = tuple(sorted({g for r in rules() for g in r["gates"]}))

_RULE = "array<struct<label string, priority int, keyword string, pattern string, confidence double, base boolean>>"


def _normal(text: str) -> Column:
    """The words of a text between single spaces, with one at both ends; two spaces for none.

    ``lower`` also lowers letters outside ASCII, which stay words as before; the Kelvin sign alone
    would become an ASCII letter and is kept out.
    """
    body = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("É")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(body, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(c: str) -> str:
    return f"(octet_length({c}) - octet_length(replace({c}, ' ', '')))"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the least and
    greatest word they start at (NULL without any).  Labels are distinct, sorted and comma-joined, empty
    without any.  ``score`` is the confidence of the surest rule that counts, 0 without one.  NULL and empty
    texts have no words.  Every input row, repeated or without id, gives one row.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal("text").alias("norm")).withColumn(
        "n_words", F.expr(f"if(norm = '  ', 0L, cast({_spaces('norm')} - 1 as long))")
    )
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("norm", F.lit(g))
    table = F.from_json(F.lit(json.dumps([{k: v for k, v in r.items() if k != "gates"} for r in rules()])), _RULE)

    # one pass over the texts; what goes on are the few that hold a gate phrase
    words = stored(words.select("doc_id", "n_words", F.when(gate, F.col("norm")).alias("norm")), "licenses")
    plain = words.where("norm is null").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"),
        F.lit("").alias("labels"),
        F.lit(0.0).alias("score"),
    )

    # one row per candidate rule, then per match; pieces between and inside matches give its place in words
    tried = words.where("norm is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("rules", table)
    tried = tried.withColumn("r", F.explode_outer(F.expr("filter(rules, r -> contains(norm, r.keyword))"))).drop("rules")
    tried = tried.withColumn("hits", F.regexp_extract_all("norm", F.col("r.pattern"), F.lit(0)))
    pieces = F.when(F.size("hits") > 0, F.arrays_zip(F.expr("split(norm, r.pattern, -1)").alias("gap"), F.col("hits").alias("hit")))
    matched = tried.select("row", "doc_id", "n_words", "r", F.posexplode_outer(pieces).alias("i", "piece"))
    matched = matched.where("i is null or piece.hit is not null").select(
        "row", "doc_id", "n_words", "r.label", "r.priority", "r.pattern", "r.confidence", "r.base", "i",
        F.expr(_spaces("piece.gap")).cast("long").alias("gap"), F.expr(_spaces("piece.hit")).cast("long").alias("inner"),
    )
    along = W.partitionBy("row", "pattern", "base").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = matched.withColumn("s", F.sum("gap").over(along) + F.sum("inner").over(along) - F.col("inner") - 1)
    placed = placed.withColumn("e", F.col("s") + F.col("inner"))

    order = W.partitionBy("row", "base").orderBy("s", F.desc("e"), "priority", "label")
    outer = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("alive", F.coalesce(F.col("base"), F.lit(False)) | F.coalesce(outer < F.col("e"), F.lit(True)))
    near = W.partitionBy("row", "base", "alive").orderBy("s", F.desc("e"), "priority", "label")
    worse = (F.lag("e").over(near) >= F.col("s")) & (F.lag("priority").over(near) < F.col("priority"))
    worse = F.coalesce(worse, F.lit(False)) | F.coalesce(
        (F.lead("s").over(near) <= F.col("e")) & (F.lead("priority").over(near) < F.col("priority")), F.lit(False)
    )
    counted = placed.withColumn("worse", worse).withColumn(
        "counts", F.col("label").isNotNull() & F.col("i").isNotNull() & (F.col("base") | (F.col("alive") & ~F.col("worse")))
    )
    is_base = F.col("base") & F.col("counts")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    found = counted.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("s"))).alias("first_word"),
        F.max(F.when(is_base, F.col("s"))).alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(F.col("counts")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("counts"), F.col("confidence"))), F.lit(0.0)).alias("score"),
    )
    return plain.unionByName(found.drop("row"))
