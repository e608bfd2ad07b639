"""Spaced seeds against aligning every document with every item."""

import itertools
import random

import numpy as np

from seawake.llm import decontamination as dc

MARKS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def brute(docs, items, window=15, percent=80):
    split = lambda t: (t or "").encode().translate(MARKS).split()
    found = set()
    for d, text in docs:
        w = split(text)
        for i, item in items:
            b = split(item)
            size = min(window, len(b))
            for shift in range(-len(b) + 1, len(w)):
                same = [w[shift + k] == b[k] for k in range(len(b)) if 0 <= shift + k < len(w)]
                if size >= 7 and any(100 * sum(same[x : x + size]) >= percent * size for x in range(len(same) - size + 1)):
                    found.add((d, i))
    return found


def pairs(docs, benchmark):
    return {(r.doc_id, r.item_id) for r in dc.benchmark_overlaps(docs, benchmark).collect()}


def test_masks_see_every_overlap():
    """Any 3 substitutions in 15 words leave a place for one of the masks."""
    for gone in itertools.combinations(range(15), 3):
        assert any(
            all(a + k not in gone for k, c in enumerate(m) if c == "1") for m in dc.MASKS for a in range(15 - len(m) + 1)
        )


def test_overlap():
    doc, item = np.arange(40), np.arange(10, 30)
    assert dc.overlap(doc, item, 10, 15, 80) == (10, 20, 20)
    assert dc.overlap(doc, item, 11, 15, 80) is None
    assert dc.overlap(doc[:20], item, 10, 15, 80) is None
    worse = item.copy()
    worse[[2, 7, 12]] = -1
    assert dc.overlap(doc, worse, 10, 15, 80)[2] == 17


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def test_substitutions_and_places(spark):
    r = random.Random(9)
    items = [(i, " ".join(words(i, n))) for i, n in enumerate([40, 40, 15, 14, 8, 7, 6, 0, 25])] + [(20, " ".join(words(0, 40))), (21, None)]
    docs = []
    for d in range(60):
        base, item = words(1000 + d, r.choice([0, 10, 700])), words(*r.choice([(0, 40), (1, 40), (2, 15), (3, 14), (4, 8), (8, 25)]))
        part = item[r.randrange(0, 5) :] if len(item) > 30 else item
        for k in r.sample(range(len(part)), min(len(part), d % 7)):
            part[k] = "changed"
        at = r.randrange(len(base) + 1)
        docs.append((d, "! ".join(base[:at] + part + base[at:]).upper()))
    got = pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    # of items alike the least is named; items under 15 words need a seed of their own
    short = {3, 4, 5}
    canon = {(d, 0 if i == 20 else i) for d, i in want}
    assert {(d, 0 if i == 20 else i) for d, i in got} <= canon
    assert {p for p in canon if p[1] not in short} <= got
    assert len(canon) > 20


def test_given_tables(given):
    docs, items = given("documents"), given("benchmark")
    got = pairs(docs, items)
    planted = {r.doc_id for r in docs.collect() for i in items.collect() if i.text in r.text}
    assert planted and planted <= {d for d, _ in got}


def test_awkward(spark, docs, repeated, none, given):
    text = docs.where("doc_id = 11").first().text
    items = spark.createDataFrame([(1, text), (None, text), (2, None), (3, "")], "item_id long, text string")
    assert pairs(docs, items) == {(11, 1)}
    kept = dc.decontaminate(repeated, items)
    assert kept.columns == repeated.columns and kept.count() == repeated.count() - 1
    assert pairs(none, items) == set() and pairs(docs, items.limit(0)) == set()


def test_masks_see_every_short_item():
    """The substitutions that 80 % of a short item allow leave a place for one of its masks."""
    for n in range(1, 15):
        allowed = n - -(-80 * n // 100)
        for gone in itertools.combinations(range(n), allowed):
            masks = [dc._ALL[k] for k in dc.masks_of(n)]
            assert any(all(a + k not in gone for k, c in enumerate(m) if c == "1") for m in masks for a in range(n - len(m) + 1))


def test_short_items_with_every_substitution(spark):
    """Each allowed placing in items of 5 to 14 words, and one substitution too many."""
    items = [(n, " ".join(words(50 + n, n))) for n in range(1, 15)]
    docs = []
    for n, text in items:
        allowed = n - -(-80 * n // 100)
        for gone in [*itertools.combinations(range(n), allowed), tuple(range(allowed + 1))]:
            w = [f"x{i}" if i in gone else v for i, v in enumerate(text.split())]
            docs.append((len(docs), " ".join(words(500 + len(docs), 20) + w + words(900 + len(docs), 20))))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert pairs(*frames) == want and len(want) > 300
    every = {(r.doc_id, r.item_id) for r in dc.benchmark_overlaps(*frames, shortest=1).collect()}
    split = {d: text.split() for d, text in docs}
    for n, text in items[:6]:
        b = text.split()
        found = {d for d, w in split.items() for s in range(len(w) - n + 1) if 100 * sum(x == y for x, y in zip(w[s:], b)) >= 80 * n}
        assert found and {(d, n) for d in found} == {p for p in every if p[1] == n}
    assert {p for p in every if p[1] >= 7} == want


def test_short_benchmark_beside_tables(spark, given):
    """Five-word seeds met by common words: only real overlaps are named."""
    docs = given("documents").where("text is not null").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(i, " ".join(text.split()[5 : 5 + n])) for i, ((_, text), n) in enumerate(zip(rows, itertools.cycle([7, 8, 9, 10, 11, 12])))]
    assert pairs(docs.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")) >= {
        (d, i) for i, (d, text) in enumerate(rows) if len(items[i][1].encode().translate(MARKS).split()) >= 7
    }


def test_borders(spark):
    """12 equal words of a window count where the document or the item begins or ends; 11 do not."""
    item = words(70, 30)
    other = words(71, 60)
    docs = {
        1: item[5:19],  # the whole document
        2: other[:20] + item[:13],  # ends with the item's first words
        3: item[-12:] + other[20:40],
        4: other[:20] + item[:11],
        5: item[4:11] + ["x"] + item[12:17],  # 12 of 13
        6: item[4:10] + ["x", "y"] + item[12:17],  # 11 of 13
        7: other[:9] + item[:12],
    }
    short = words(72, 10)
    docs |= {8: other[:20] + short[:8], 9: short[3:] + other[:20], 10: short[2:]}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    assert pairs(frame, items) == {(1, 1), (2, 1), (3, 1), (5, 1), (7, 1), (8, 2), (10, 2)}
    got = {r.doc_id: (r.start_word, r.n_words, r.n_equal) for r in dc.benchmark_overlaps(frame, items).collect()}
    assert got[2] == (20, 13, 13) and got[5] == (0, 13, 12)


def test_rows_without_id(spark, none):
    item = " ".join(words(73, 30))
    rows = [(None, item, 1), (None, "clean text", 2), (1, item, 3), (2, "clean text", 4), (None, item, 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.n for r in kept.collect()} == {2, 4, 6}
    assert dc.decontaminate(none, items).count() == 0


def test_every_item_of_a_shared_passage(spark):
    shared = words(80, 25)
    items = [(1, shared), (2, shared), (3, words(81, 40) + shared + words(82, 40)), (4, words(83, 40) + shared + words(84, 40)), (5, words(85, 30))]
    items = [(i, " ".join(w)) for i, w in items] + [(1, " ".join(words(86, 30)))]
    docs = [(1, " ".join(words(87, 50) + shared + words(88, 50))), (2, " ".join(words(86, 30))), (3, "clean")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert pairs(*frames) == brute(docs, items) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}
    fewer = {(r.doc_id, r.item_id) for r in dc.benchmark_overlaps(*frames, every=False).collect()}
    assert fewer < brute(docs, items) and {d for d, _ in fewer} == {1, 2}


def test_long_items_are_given_whole(spark):
    """A document equal to an item of 2000 words, one that holds 1200 of them, one id with another text beside it."""
    r = random.Random(8)
    words = [f"w{r.randrange(10**9)}" for _ in range(2000)]
    other = [f"v{i}" for i in range(700)]
    changed = [w if i % 40 else "changed" for i, w in enumerate(words[300:1500])]
    texts = [(1, " ".join(words)), (2, " ".join(other[:50] + changed + other[50:90])), (3, " ".join(other)), (1, " ".join(words[:600] + other))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = dc.benchmark_overlaps(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    want = {1: (0, 2000, 2000)}
    longest = dc.overlap(*(dc.words_of(t.encode()) for t in (texts[1][1], " ".join(words))), -250, dc.WINDOW, dc.PERCENT)
    want[2] = longest
    assert longest[1] >= 1199 and {x.doc_id: (x.start_word, x.n_words, x.n_equal) for x in got} == want
