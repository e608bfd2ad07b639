"""Repeated passages against comparing every window."""

import hashlib
import random

import numpy as np
import pytest

from seawake.llm import repeated_passages as rp

ALPHABET = [b"a", b"b", b"ab", b"the ", b"\n", "é".encode()]


def brute(rows, length):
    seen, out = set(), {}
    for key, t in sorted(rows):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(t[i : i + length])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(df, **k):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rp.remove_repeats(df, **k).collect()}


def test_deep_shallow_order_sorts():
    r = random.Random(2)
    for shallow in (0, 8, 16, 48):
        for _ in range(20):
            strings = [b"".join(r.choice(ALPHABET) for _ in range(40))[:32] for _ in range(r.randint(0, 60))]
            strings += strings[: len(strings) // 3]
            order = rp.deep_shallow_order(strings, shallow)
            assert sorted(order.tolist()) == list(range(len(strings)))
            assert [strings[i] for i in order] == sorted(strings)


def test_prefix_ranks():
    strings = [b"abcd", b"abce", b"abcd", b"b\0\0\0"]
    ranks = rp._prefix_ranks(strings)
    same = lambda n: [[int(x == y) for y in ranks(n)] for x in ranks(n)]
    for n in range(5):
        assert same(n) == [[int(a[:n] == b[:n]) for b in strings] for a in strings]


def test_equal_windows_share_an_anchor(monkeypatch):
    monkeypatch.setattr(rp, "SEGMENT", 64)
    r = random.Random(4)
    for text in (bytes(r.randrange(256) for _ in range(900)), b"ab" * 300, b"x" * 500, b"".join(r.choice(ALPHABET) for _ in range(300))):
        chosen = {}
        at, _ = rp.anchors(text, 100)
        for i in range(len(text) - 99):
            inside = at[(at >= i) & (at <= i + 100 - rp.GRAM)]
            assert len(inside)
            chosen.setdefault(text[i : i + 100], []).append(set((inside - i).tolist()))
        assert all(set.intersection(*v) for v in chosen.values())


def test_joined_marks():
    rows = [(1, 5, 9), (1, 0, 3), (1, 4, 4), (1, 20, 21), (2, 0, 1), (2, 0, 30), (2, 10, 12)]
    got = rp.joined_marks(np.array(rows, rp.MARK)).tolist()
    assert got == [(1, 0, 9), (1, 20, 21), (2, 0, 30)]


@pytest.mark.parametrize("hot", [rp.HOT, 1])
def test_given_documents(given, hot):
    docs = given("documents")
    assert found(docs, hot=hot) == brute([(r.doc_id, r.text.encode()) for r in docs.collect()], 100)


@pytest.mark.parametrize("hot", [rp.HOT, 1])
def test_random_texts(spark, hot, monkeypatch):
    """Few letters, so that repeats start and end anywhere, overlap, and lie within one text."""
    monkeypatch.setattr(rp, "FLUSH", 200)
    r = random.Random(6)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.choice([0, 30, 39, 40, 41, 200, 600])))) for i in range(40)]
    rows += [(50 + i, "prefix %d " % i + rows[5][1] * 2 + "y" * 90 + " suffix %d" % i) for i in range(8)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, length=40, hot=hot) == brute([(d, t.encode()) for d, t in rows], 40)


def test_awkward(docs, repeated, none):
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 100)
    assert found(docs) == want
    got = rp.remove_repeats(repeated, with_text=True).collect()
    assert len(got) == repeated.count()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    # rows alike in id and text are one document; a text without id comes first and keeps its bytes
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]
    assert {r.n_removed for r in got if r.doc_id == 1} == {want[3][1] and r.n_removed for r in got if r.doc_id == 1}
    assert rp.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        rp.remove_repeats(docs, length=20)
