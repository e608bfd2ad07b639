"""Cross-tokenizer alignment against whole texts, plain library calls and byte ranges."""

import collections
import hashlib
import random
from bisect import bisect_right

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seawake.llm import alignment as al

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    back = {}
    from tokenizers.pre_tokenizers import ByteLevel

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
    assert set(back) == set(ByteLevel.alphabet())
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def piece(p):
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        """(id, bytes) lists of A and B over a whole text, or None."""
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in ids]
        y = [(i, piece(b.id_to_piece(i))) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else None

    return tokens


def ranges(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(rows, tokens):
    """The report from the tokens that every byte belongs to."""
    docs = []
    for key, text in rows:
        got = tokens(text)
        x, y = (ranges(t) for t in got) if got else ([], [])
        owner = [[k for k, (_, t) in enumerate(side) for _ in t] for side in got or ((), ())]  # of every byte
        links = [(x[i][0], y[j][0]) for i, j in sorted(set(zip(*owner)))]
        ends = sorted({b for _, _, b in x} & {d for _, _, d in y})
        starts = [0, *ends[:-1]] if ends else []
        tail = [[e for _, _, e in side] for side in (x, y)]
        inside = lambda s, a, b: ",".join(str(i) for i, _, _ in (x, y)[s][bisect_right(tail[s], a) : bisect_right(tail[s], b)])
        groups = ";".join(f"{inside(0, a, b)}|{inside(1, a, b)}" for a, b in zip(starts, ends))
        docs.append((key, len(x), len(y), len(ends), links, groups))
    held = collections.Counter(p for d in docs for p in set(d[4]))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return collections.Counter(
        (key, na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for key, na, nb, ng, links, groups in docs
    )


def report(df):
    return collections.Counter(tuple(r) for r in al.alignment_report(df, *PATHS).collect())


ODD = [
    " ", "  ", "\n", "\n\n", " \n ", "a", " a", "a ", "a  b", "a\tb", "a\t b", "a\t\n b \t ", "don't  stop\r\nnow", "<|endoftext|> x", "<s> </s><unk>",
    "▁", "a▁b", "a  b", "a b", "x　 y", "\x1c a\x1f b\x1c\x1d c", "!\x1c ?\x1c", "a᠎ b", "a  b \nc", "\x85 a\x85 b", "﻿a ﻿",
    "\0", "a\0 b", "ﬁ ①", "日本語 テキスト", "🙂 🙂🙂", "é é", "<0x41> <0xFF>", "1234567 89.5", "    indented\n        more", "\U0010ffff ͸",
]


def test_whole_texts(spark, libraries):
    r = random.Random(5)
    parts = [*ODD, "the", " the", "Straße", " words", ".", ",", "\n", " ", "  ", "\t", "\r", "\x0b"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert report(df) == brute(rows, libraries)


def test_awkward_documents(docs, repeated, none, libraries, monkeypatch):
    monkeypatch.setattr(al, "HOT_PAIRS", 5)
    rows = [(r.doc_id, r.text) for r in repeated.collect()]
    assert report(repeated) == brute(rows, libraries)
    clash = docs.withColumnsRenamed({"lang": "pairs", "source": "row", "n_chars": "best"})
    assert report(clash) == brute([(r.doc_id, r.text) for r in docs.collect()], libraries)
    assert not report(none)


def test_whole_groups(docs, libraries):
    got = {r.doc_id: r for r in al.align_documents(docs, *PATHS, keep_groups=True).collect()}
    assert got[4].groups == got[5].groups == "" and got[4].pairs == []
    assert got[7].groups.count("|") == got[7].n_groups
    assert sum(got[9]["times"]) == got[9].n_links


def test_small_memory(docs, monkeypatch, libraries):
    """Forgetting units after every slice changes nothing."""
    monkeypatch.setattr(al, "MEMO_BYTES", 0)
    texts = [(r.text or "").encode() for r in docs.collect()]
    one = al.Aligner(*PATHS)
    small = [al._align_slice(one, [t], True) for t in texts]
    whole = al._align_slice(al.Aligner(*PATHS), texts, True)
    for k in range(len(whole)):
        assert [c[k][0].as_py() for c in small] == whole[k].to_pylist()


def test_gallop_and_align():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 60)
        a, b = (sorted({n, *(r.randint(1, n) for _ in range(r.randint(0, 40)))}) for _ in "ab")
        ranks, common = al.gallop(a, b)
        assert ranks == [sum(y < x for y in b) for x in a] and common == [x in b for x in a]
        groups, overlaps = al.align(a, b)
        assert [a[p - 1] for p, _ in groups] == [b[q - 1] for _, q in groups] == sorted(set(a) & set(b))
        short, long = (b, a) if len(b) < len(a) else (a, b)
        got = {(i, k) for i, first, last in overlaps for k in range(first, last + 1)}
        lo = lambda ends, i: ends[i - 1] if i else 0
        assert got == {(i, k) for i in range(len(short)) for k in range(len(long)) if lo(short, i) < long[k] and lo(long, k) < short[i]}


def test_many_lists_at_once():
    import numpy as np

    r = random.Random(2)
    pairs = []
    for _ in range(200):
        n = r.randint(1, 300)
        pairs.append([sorted({n, *(r.randint(1, n) for _ in range(r.randint(0, m)))}) for m in (8, 250)])
    pairs.append([[], [1, 2]])
    flat = [np.array([x for p in pairs for x in p[s]], np.int64) for s in (0, 1)]
    counts = [np.array([len(p[s]) for p in pairs], np.int64) for s in (0, 1)]
    starts = [np.cumsum(c) - c for c in counts]
    place, common = al.gallop_many(flat[0], starts[0], counts[0], flat[1], starts[1], counts[1])
    for u, (a, b) in enumerate(pairs):
        own = slice(starts[0][u], starts[0][u] + len(a))
        assert ((place[own] - starts[1][u]).tolist(), common[own].tolist()) == al.gallop(a, b)


def test_long_units(libraries):
    """Unbroken texts go the way of single lists; both ways agree with every byte."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefé日.") for _ in range(n)) for n in (10, 3000, 20_000)]
    got = al._align_slice(al.Aligner(*PATHS), [t.encode() for t in texts], False)
    want = sorted(brute(list(enumerate(texts)), libraries))
    assert [[c[k].as_py() for c in got[:5]] for k in range(3)] == [[*w[1:5], w[7]] for w in want]
