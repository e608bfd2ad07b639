"""Collocations and the trie they are counted in against plain counting."""

import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from checks.compare import compare, connect
from seawake.llm import collocations as co
from seawake.llm.queries import ORACLE, QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    frequent = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    dropped = {(lang, w[i : i + m], n) for (lang, w), n in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)}
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        if (lang, w, a) not in dropped:
            n = total[lang]
            score, _, l, r = min((1000 * a * n // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r, n))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, x in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(x)[:top])
    }


def found(df, **k):
    rows = [tuple(r) for r in co.collocations(df, **k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "ﬁ", "new", "york", "york's", "x\x00", "\x1c", "a b", "日本"] + [f"w{i}" for i in range(300)]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "\xa0"]
    fixed = ["new york times", "in the end of the day", "of the the the the the", "state  of\tthe ART"]
    for i in range(n):
        text = "".join((r.choice(fixed) if r.random() < 0.2 else r.choice(words[:13] if r.random() < 0.5 else words)) + r.choice(gaps) for _ in range(r.randint(0, 120)))
        yield i, text, r.choice(["en", "en", "en", "de", "", None])


@pytest.mark.parametrize("small", [False, True])
def test_against_counting(spark, small):
    """With small limits containers burst, tasks spill and forget all the time, and fields hold many false bits."""
    limits = co.Limits(burst=5, held=40, words=60, rows=7, text=500, bits=10) if small else co.LIMITS
    rows = list(texts(3, 400))
    rows += [(500, None, "en"), (501, "", None), (502, "fr mot " * 30, "fr"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 15, 40)
    assert len({x[0] for x in want}) == 5 and found(df, least=15, top=40, limits=limits) == want


def test_awkward_documents(docs, repeated, none):
    rows = [(r.doc_id, r.text, r.lang) for r in repeated.collect()]
    assert found(repeated, least=8) == brute(rows, 8, 2000)
    clash = docs.withColumnsRenamed({"doc_id": "phrase", "source": "n", "n_chars": "body"})
    assert found(clash, least=4) == brute([(0, r.text, r.lang) for r in docs.collect()], 4, 2000)
    assert not found(none)


def test_products_pass_64_bits(spark):
    """Scores are whole quotients also where the products have over 18 digits."""
    big = [(3_000_000_007, 9_000_000_000_001, 40_000_000_003, 70_000_000_001), (999_999_999_999, 10**14 - 1, 10**12 - 1, 10**12 - 3)]
    df = spark.createDataFrame([tuple(map(Decimal, row)) for row in big], "a1 decimal(38,0), total1 decimal(38,0), l1 decimal(38,0), r1 decimal(38,0)")
    got = [r[0] for r in df.select(F.expr("(a1 * total1 * 1000) div (l1 * r1)")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in big]


def test_trie_spills_sorted_subtrees():
    r = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(12)]
    trie, want, got = co.PhraseTrie(burst=8), Counter(), Counter()
    for _ in range(30):
        for k in (2, 3, 5):
            rows = r.integers(0, 12, (20, k))
            trie.add(rows)
            want.update(b" ".join(words[i] for i in row) for row in rows.tolist())
        assert trie.held == sum(trie.sizes.values())
        if trie.held > 100:
            before = trie.held
            for run, n in trie.spill(words, False):
                assert run == sorted(run) and len({p.split()[0] for p in run}) == 1
                got.update(dict(zip(run, n)))
            assert trie.held <= before // 2
    for run, n in trie.spill(words, True):
        got.update(dict(zip(run, n)))
    assert got == want and trie.held == 0


def test_query(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = QUERIES["op13_collocations"](spark, sf).toPandas()
    assert len(got) > 50 and compare(got, connect(sf).execute(ORACLE["op13_collocations"]).df()) == "ok"


def test_sums_of_pairs_find_the_frequent_ones():
    """Summed over tasks, by range; every pair that is frequent in all of them together is found."""
    r = np.random.default_rng(4)
    pairs = r.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    parts = [r.choice(pairs, 4000, p=np.arange(1, 3001) / np.arange(1, 3001).sum()) for _ in range(3)]
    rows = [row for part in parts for row in co.pair_sums(part, 5)]
    got = set()
    for key in {k for k, _ in rows}:
        table = pa.table({"data": pa.array([d for k, d in rows if k == key], pa.binary())})
        got |= set(co._frequent_keys(5, 40)([pa.scalar(key)], table).column("i").to_pylist())
    times = Counter(np.concatenate(parts).tolist())
    assert got == {h >> 24 for h, n in times.items() if n >= 5} and list(co.pair_sums(parts[0][:0], 5)) == []


def test_rare_pairs_leave_no_task(spark, monkeypatch):
    """Frequent words whose pairs are rare: the tries are given the frequent pairs alone."""
    r = random.Random(2)
    text = " ".join(r.choices([f"w{i}" for i in range(40)], k=2000)) + " left right" * 60
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    made, runs = [], co._runs
    monkeypatch.setattr(co, "_runs", lambda *a, **k: made.append(runs(*a, **k)) or made[-1])
    counts = co.phrase_counts(df, least=30)[0].collect()
    held = {x.phrase for out in made for x in out.collect() if " " in x.phrase}
    assert {"left right", "right left", "left right left right left"} <= {x.phrase for x in counts}
    assert not any("w" in p for p in held)
