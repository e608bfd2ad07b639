"""Toxicity and line quality: held-out accuracy, exact base counts, and the parts of both models."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from seawake.llm import quality_lines as ql
from seawake.llm import toxicity as tx


@pytest.fixture(scope="module")
def toxic_docs(spark):
    """Ordinary prose, and the same with a few marked words in every fifth document."""
    r = np.random.default_rng(1)
    syllables = ["an", "er", "tion", "the", "ou", "st", "ha", "re", "ly", "en", "nd", "ing", "ti", "or", "es"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.integers(1, 4)))
    rows, labels = [], []
    for i in range(600):
        words, toxic = [word() for _ in range(int(r.integers(30, 150)))], int(i % 5 == 3)
        if toxic:
            for k in r.integers(0, len(words), 6):
                words[k] = str(r.choice(["worthless", "pathetic", "disgusting", "scumbag"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(toxic_docs):
    return tx.train(*toxic_docs)


def test_held_out_accuracy(toxic_docs, model):
    docs, labels = toxic_docs
    got = {r.doc_id: r for r in tx.toxicity(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93


def test_windows_cover_the_text():
    text = b"One two-three " * 40 + b"x" * 500
    joined = b"".join(tx.windows(text)).split()
    assert set(joined) >= {b"one", b"two", b"three"} and sum(w == b"three" for w in joined) >= 40
    assert sum(map(len, tx.windows(b"x" * 500))) >= 500
    assert tx.windows(b"") == tx.windows(b" 123 !") == [b""]


def test_toxicity_awkward(spark, docs, repeated, none, model):
    for df in (docs, repeated):
        assert tx.toxicity(df, model).count() == df.count()
    assert [r.held_out for r in tx.toxicity(repeated.where("doc_id is null"), model).collect()] == [False, False]
    assert tx.toxicity(none, model).count() == 0
    empty = tx.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in tx.toxicity(docs, empty).collect()} == {0.0}
    one_class = tx.train(docs, docs.selectExpr("doc_id", "1 quality", "0 toxic"))
    assert {r.score for r in tx.toxicity(docs, one_class).collect()} == {0.0}
    clash = tx.score_documents(docs.withColumnRenamed("lang", "score"), model)
    assert dict(clash.dtypes)["score"] == "double"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts(given, docs):
    texts = [r.text for r in given("documents").collect()] + [r.text for r in docs.collect()]
    texts += ["a b " * n for n in range(14)] + ["x y z\n\nx y z\n \nx y z", "a b c d e f g h " * 2, "# é|ü <b>"]
    for t in texts:
        assert ql.base_counts((t or "").encode()) == brute_counts(t)


def test_viterbi_and_expectations_against_all_sequences():
    r = np.random.default_rng(3)
    for n in range(1, 7):
        f = ql.Field(r.normal(size=(2, 4)), r.normal(size=(2, 2)))
        x = r.normal(size=(n, 4))
        score = lambda s: sum(f.emit[k] @ x[t] for t, k in enumerate(s)) + sum(f.move[a, b] for a, b in zip(s, s[1:]))  # noqa: B023,E731
        every = list(itertools.product((0, 1), repeat=n))
        values = np.array([score(s) for s in every])
        assert tuple(f.viterbi(x)) == every[values.argmax()]
        total, emit, move = f.expected(x)
        assert total == pytest.approx(np.logaddexp.reduce(values))
        p = np.exp(values - total)
        want = np.zeros((2, 4))
        moves = np.zeros((2, 2))
        for s, w in zip(every, p):
            for t, k in enumerate(s):
                want[k] += w * x[t]
            for a, b in zip(s, s[1:]):
                moves[a, b] += w
        assert emit == pytest.approx(want) and move == pytest.approx(moves)


def test_quality_follows_the_labels(given):
    docs, labels = given("documents"), given("labels")
    field = ql.train(docs, labels, rows=60)
    kept = {r.doc_id: r.kept for r in ql.line_quality(docs, field).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 20}
    good = [kept[i] for i, q in truth.items() if q == 1 and i in long]
    assert np.mean(good) > 0.95
    assert np.mean([kept[i] for i, q in truth.items() if q == 0]) < 0.3


def test_quality_awkward(spark, docs, repeated, none):
    blank = ql.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for df in (docs, repeated):
        got = ql.line_quality(df, blank).collect()
        assert len(got) == df.count()
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    assert ql.line_quality(none, blank).count() == 0


def test_a_wide_toxic_vocabulary_is_kept():
    """600 marked words, each in ten toxic texts: all of them come into the dictionary, in as many bytes as are given."""
    r = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda n, end="": "".join(r.choice(syllables) for _ in range(n)) + end
    plain, marked = [word(r.randint(1, 3)) for _ in range(3000)], [word(3, "xq") for _ in range(600)]
    text = lambda extra: " ".join(r.sample([*extra, *(r.choice(plain) for _ in range(80))], 80 + len(extra))).encode()
    dealt = marked * 10
    r.shuffle(dealt)
    toxic = [text(dealt[i : i + 6]) for i in range(0, len(dealt), 6)]
    ordinary = [text(()) for _ in range(2000)]
    whole = tx.toxic_dictionary(toxic, ordinary)
    found = {w.decode() for w in whole.split()}
    assert len(set(marked) & found) > 0.95 * len(set(marked))
    assert len(found - set(marked)) < 0.05 * len(found)
    assert tx.toxic_dictionary(toxic, ordinary, size=1000) == whole[-1000:]


def test_surroundings_are_counted_in_little_memory():
    """What the driver holds grows with the words by few bytes, not by an entry of a set for each beginning."""
    import tracemalloc

    r = random.Random(3)
    vocabulary = [bytes(r.choices(range(97, 123), k=r.randint(3, 12))) for _ in range(3000)]
    texts = [b" ".join(r.choices(vocabulary, k=1000)) for _ in range(150)]
    tracemalloc.start()
    got = tx._surroundings(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * 150_000
    want = collections.defaultdict(set)
    for text in texts[:20]:
        words = [b"", *text.split(), b""]
        for before, word, after in zip(words, words[1:], words[2:]):
            for b in tx._beginnings(word) if len(word) >= 4 else ():
                want[b].add((before, after))
    some = tx._surroundings(texts[:20])
    assert some == {b: len(pairs) for b, pairs in want.items()}
    only = dict.fromkeys(list(some)[::3])
    assert tx._surroundings(texts[:20], only) == {b: some[b] for b in only}
    assert set(some) <= set(got) and tx._surroundings([]) == {}
