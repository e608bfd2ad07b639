"""Phrase collocations, counted in hash tries that burst.

*Words.*  A-Z is lower-cased; texts are cut at ``. , ; : ! ?`` and line ends into pieces, those at spaces and tabs into
words.  Counts are per language and never reach from one piece to the next.

*Trie.*  A task keeps phrases of ``k`` words in a trie that is one word deep: below the id of the first word lies a
container, a hash table of the ids that follow.  A container with more than ``Limits.burst`` entries bursts into one
container per second word.  When a task holds ``Limits.held`` phrases it spills: whole subtrees, largest first, leave
as sorted runs of ``(lang, phrase, n)``.  Word ids are the task's own; runs hold the words.

*Merge.*  The runs of all tasks are dealt by prefix, the first ``PREFIX`` words, so that a partition holds whole subtrees,
and summed there.  No sample of the runs is needed for that, so they are shuffled as they leave the tries, written
nowhere else.  Only phrases with ``least`` occurrences go on.

*Levels.*  A phrase is no more frequent than its parts.  So words are counted first, then which pairs of frequent words
are frequent, then phrases all of whose pairs are.  Most pairs are rare, so they are not counted in the tries: tasks
sort hashes of pairs, and what is shuffled and summed are their upper ``KEY`` bits, some bytes each.  Tasks know the frequent
words and pairs from two bit fields of fixed size; where those err by a shared bit, or two pairs share a hash, a phrase
more is counted, and the merge drops it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.llm.common import byte_slices, shuffle_width, stored, utf8
from seawake.llm.ids import folded_bits


@dataclass(frozen=True)
class Limits:
    """What a task holds, and how large the bit fields are.  None of it changes a result."""

    burst: int = 20_000  # entries from which a container bursts
    held: int = 500_000  # phrases a task holds before it spills
    words: int = 250_000  # distinct words a task gives ids before it spills and starts afresh
    rows: int = 50_000  # rows of a run that leave a task at once
    text: int = 1 << 20  # bytes of text counted at once
    bits: int = 25  # of the fields of frequent words and pairs, as a power of two
    hashes: int = 4_000_000  # pairs a task holds before their hashes leave it


LIMITS = Limits()


# A-Z to a-z, tab to space, and what ends a piece to the line feed
_fold = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256)
)
#: words of the prefix that phrases are dealt by; below one lie two levels of the trie at most
PREFIX = 3
#: bits of a pair's hash that are summed, and how many of them, the first, tell the range it is summed in
KEY, RANGE = 42, 10
#: stands between pieces; no UTF-8 text holds this byte
_END = b"\xff"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``_END`` between its pieces."""
    return text.translate(_fold).replace(b"\n", b" " + _END + b" ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first ^ (first >> np.uint64(31))) * _M1 + second * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _on(field: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = _places(h, bits)
    return (field[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def frequent_field(words: DataFrame, bits: int) -> np.ndarray:
    """The bits of words ``lang, phrase``, put together by Spark."""

    def run(batches):
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in range(2))
            h = np.array([word_hash(g, w.encode()) for g, w in zip(langs, texts)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_places(h, bits))], names=["i"])

    return folded_bits(words.select("lang", "phrase").mapInArrow(run, "i long"), 1 << bits)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 32 bits, the bytes of one significance together."""
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(c.T).view("<u4").ravel() for c in flat]


def pair_sums(hashes: np.ndarray, most: int):
    """``(range, data)`` of the pairs hashed: the rest of each key, in order, as differences, and its times, ``most`` at most."""
    keys, times = np.unique(hashes >> np.uint64(64 - KEY), return_counts=True)
    where = (keys >> np.uint64(KEY - RANGE)).astype(np.int64)
    rest = (keys & np.uint64((1 << (KEY - RANGE)) - 1)).astype(np.uint32)
    for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(where)) + 1) if len(keys) else ():
        yield int(where[at[0]]), _packed([np.diff(rest[at], prepend=np.uint32(0)), np.minimum(times[at], most)])


def _frequent_keys(least: int, bits: int):
    """The places in a field of ``bits`` of the keys of a range that occur ``least`` times in all."""

    def run(key, table):
        parts = [_unpacked(d, 2) for d in table.column("data").to_pylist()]
        rest = np.concatenate([np.cumsum(r, dtype=np.uint32) for r, _ in parts])
        times = np.concatenate([t for _, t in parts]).astype(np.int64)
        order = np.argsort(rest, kind="stable")
        rest = rest[order]
        starts = np.flatnonzero(np.r_[True, np.diff(rest) != 0])
        found = rest[starts[np.add.reduceat(times[order], starts) >= least]].astype(np.int64)
        places = (found + (key[0].as_py() << (KEY - RANGE))) >> (KEY - bits)
        return pa.table({"i": pa.array(np.unique(places))})

    return run


def frequent_pairs(docs: DataFrame, least: int, limits: Limits, words: np.ndarray) -> np.ndarray:
    """The bits of the pairs of frequent words that occur ``least`` times."""
    field = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        ids: dict[str, _Ids] = {}
        known: dict[str, np.ndarray] = {}
        held, n = [], 0

        def batch_of():
            rows = list(pair_sums(np.concatenate(held), least))
            arrays = [pa.array([r for r, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["range", "data"])

        for batch in batches:
            for part in byte_slices(batch, 1, limits.text):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    if sum(map(len, ids.values())) > limits.words:
                        ids.clear()
                    if lang not in ids:
                        ids[lang], known[lang] = _Ids(lang, field.value, limits.bits), np.zeros(0, np.uint64)
                    own, split = ids[lang], words_of(b"\n".join(texts))
                    at = np.fromiter(map(own.__getitem__, split), np.int64, len(split))
                    known[lang] = np.r_[known[lang], np.array(own.hashes[len(known[lang]) :], np.uint64)]
                    i = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
                    held.append(pair_hashes(known[lang][at[i]], known[lang][at[i + 1]]))
                    n += len(i)
                if n > limits.hashes:
                    yield batch_of()
                    held, n = [], 0
        if n:
            yield batch_of()

    sums = docs.mapInArrow(run, "range int, data binary")
    return folded_bits(sums.groupBy("range").applyInArrow(_frequent_keys(least, limits.bits), "i long"), 1 << limits.bits)


class PhraseTrie:
    """Counts of phrases of word ids: first word to a container, which bursts to one per second word."""

    def __init__(self, burst: int = LIMITS.burst):
        self.burst = burst
        self.root: dict[int, Counter | dict[bytes, Counter]] = {}
        self.sizes: Counter = Counter()
        self.held = 0

    def add(self, rows: np.ndarray) -> None:
        """One more occurrence of each row of ids; all rows have the same number of words, two at least."""
        order = np.argsort(rows[:, 0], kind="stable")
        first = rows[order, 0]
        rest = np.ascontiguousarray(rows[order, 1:].astype(">u4"))
        keys = rest.view(f"V{rest.shape[1] * 4}").ravel().tolist()
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        for word, a, b in zip(first[cuts[:-1]].tolist(), cuts, cuts[1:]):
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = Counter()
            if isinstance(node, Counter):
                node.update(keys[a:b])
                size = len(node)
                if size > self.burst:
                    self.root[word] = self._burst(node)
            else:
                size = self.sizes[word]
                for key in keys[a:b]:
                    child = node.get(key[:4])
                    if child is None:
                        child = node[key[:4]] = Counter()
                    child[key[4:]] += 1
                    size += child[key[4:]] == 1
            self.held += size - self.sizes[word]
            self.sizes[word] = size

    @staticmethod
    def _burst(container: Counter) -> dict[bytes, Counter]:
        out: dict[bytes, Counter] = {}
        for key, n in container.items():
            out.setdefault(key[:4], Counter())[key[4:]] = n
        return out

    def spill(self, words: list[bytes], all_of_it: bool):
        """Sorted runs (phrases and their counts), a subtree each: all, or the largest until half of what is held has left."""
        keep = 0 if all_of_it else self.held // 2
        for word, size in self.sizes.most_common():
            if self.held <= keep:
                break
            node = self.root.pop(word)
            del self.sizes[word]
            self.held -= size
            if not isinstance(node, Counter):
                node = {second + rest: n for second, child in node.items() for rest, n in child.items()}
            found: dict[bytes, int] = {}
            for length in set(map(len, node)):
                keys = [k for k in node if len(k) == length]
                ids = np.frombuffer(b"".join(keys), ">u4").reshape(len(keys), -1).T.tolist()
                columns = [map(words.__getitem__, c) for c in ids]
                found.update(zip(map(b" ".join, zip([words[word]] * len(keys), *columns)), map(node.__getitem__, keys)))
            run = sorted(found)
            yield run, list(map(found.__getitem__, run))


class _Ids(dict):
    """Ids of words in the order they are met; -1 for those the field does not name."""

    def __init__(self, lang: str, field: np.ndarray | None, bits: int):
        super().__init__({_END: -1})
        self.lang, self.field, self.shift = lang, field, 64 - bits
        self.words: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        i = len(self.words)
        if self.field is not None:
            h = word_hash(self.lang, word)
            at = h >> self.shift
            if not int(self.field[at >> 5]) >> (at & 31) & 1:
                self[word] = -1
                return -1
            self.hashes.append(h)
        self.words.append(word)
        self[word] = i
        return i


class _Counts:
    """What a task counts of one language."""

    def __init__(self, lang: str, longest: int, limits: Limits, words: np.ndarray | None, pairs: np.ndarray | None):
        self.lang, self.longest, self.limits, self.fields = lang, longest, limits, (words, pairs)
        self.reset()

    def reset(self) -> None:
        self.ids = _Ids(self.lang, self.fields[0], self.limits.bits)
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.trie = PhraseTrie(self.limits.burst)

    def add(self, text: bytes) -> None:
        """Count a text; without the fields its words, with them its phrases of two words and more."""
        words = words_of(text)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.fields[0] is None:
            n = np.bincount(at[at >= 0], minlength=len(self.ids.words))
            n[: len(self.counts)] += self.counts
            self.counts = n
            return
        good = (at[:-1] >= 0) & (at[1:] >= 0)
        self.hashes = np.r_[self.hashes, np.array(self.ids.hashes[len(self.hashes) :], np.uint64)]
        i = np.flatnonzero(good)
        good[i] = _on(self.fields[1], pair_hashes(self.hashes[at[i]], self.hashes[at[i + 1]]), self.limits.bits)
        run = good  # run[i]: all pairs of the words from i on are frequent
        for k in range(2, self.longest + 1):
            run = run[: len(at) - k + 1] & good[k - 2 :]
            i = np.flatnonzero(run)
            if not len(i):
                break
            self.trie.add(at[i[:, None] + np.arange(k)])

    def full(self) -> bool:
        return len(self.ids) > self.limits.words

    def runs(self, all_of_it: bool):
        if self.fields[0] is None:
            if all_of_it:
                found = dict(zip(self.ids.words, self.counts.tolist()))
                run = sorted(found)
                yield run, list(map(found.__getitem__, run))
        else:
            yield from self.trie.spill(self.ids.words, all_of_it)


_RUN = "lang string, phrase string, n long"


def _runs(docs: DataFrame, longest: int, limits: Limits, words: np.ndarray | None = None, pairs: np.ndarray | None = None) -> DataFrame:
    """Sorted runs of what every task counted, not yet merged."""
    sc = docs.sparkSession.sparkContext
    fields = [None if f is None else sc.broadcast(f) for f in (words, pairs)]

    def run(batches):
        tries: dict[str, _Counts] = {}
        langs: list[str] = []
        phrases: list[bytes] = []
        counts: list[int] = []

        def batch_of(n):
            arrays = [pa.array(langs[:n], pa.string()), pa.array(phrases[:n], pa.binary()).cast(pa.string()), pa.array(counts[:n], pa.int64())]
            for column in (langs, phrases, counts):
                del column[:n]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n"])

        def spilled(own: _Counts, all_of_it: bool):
            for run, n in own.runs(all_of_it):
                langs.extend([own.lang] * len(run))
                phrases.extend(run)
                counts.extend(n)
                while len(phrases) >= limits.rows:
                    yield batch_of(limits.rows)

        for batch in batches:
            for part in byte_slices(batch, 1, limits.text):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    if lang not in tries:
                        tries[lang] = _Counts(lang, longest, limits, *(f and f.value for f in fields))
                    tries[lang].add(b"\n".join(texts))
                    if tries[lang].full():
                        yield from spilled(tries[lang], True)
                        tries[lang].reset()
                while sum(t.trie.held for t in tries.values()) > limits.held:
                    yield from spilled(max(tries.values(), key=lambda t: t.trie.held), False)
                if sum(len(t.ids) for t in tries.values()) > 2 * limits.words:
                    for t in tries.values():
                        yield from spilled(t, True)
                    tries.clear()
        for t in tries.values():
            yield from spilled(t, True)
        if phrases:
            yield batch_of(len(phrases))

    return docs.mapInArrow(run, _RUN)


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Phrases with ``least`` occurrences in all runs, summed in partitions of whole prefixes."""
    prefix = F.substring_index("phrase", " ", PREFIX)
    dealt = runs.repartition(shuffle_width(runs.sparkSession), "lang", prefix)
    # the prefix is a key too, so the sums need no second shuffle
    sums = dealt.groupBy("lang", prefix.alias("__prefix"), "phrase").agg(F.sum("n").alias("n")).drop("__prefix")
    return stored(sums.where(F.col("n") >= least), "phrase-counts")


def phrase_counts(
    docs: DataFrame, least: int = 100, longest: int = 5, limits: Limits = LIMITS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``lang, total`` words."""
    body = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8().alias("body"))
    runs = stored(_runs(body, longest, limits), "word-runs")  # read twice, and small
    totals = stored(runs.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    counts = words = _merged(runs, least)
    field = frequent_field(words, limits.bits)
    if longest > 1:
        counts = counts.unionByName(_merged(_runs(body, longest, limits, field, frequent_pairs(body, least, limits, field)), least))
    return counts, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, limits: Limits = LIMITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score, count and name.

    A phrase of two to ``longest`` words with ``a >= least`` occurrences is cut behind each of its words; with ``l`` and ``r``
    the counts of the parts and ``n`` the words of the language the cut scores ``floor(1000 a n / (l r))``.  The cut of
    the least score counts, of equal ones the first.  A phrase that lies in a longer one of the same count is dropped.
    NULL texts have no words, a NULL language is ``und``; repeated rows count each time, other columns are
    not read, and an empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, least, longest, limits)
    words = F.split("phrase", " ")
    known = stored(counts.withColumn("k", F.size(words)), "phrase-known")
    phrases = known.where("k > 1")

    # a phrase inside a longer one of its count lies in one that is a single word longer and has this count too
    longer = phrases.where("k > 2").withColumn("w", words)
    inner = [F.array_join(F.slice("w", at, F.col("k") - 1), " ") for at in (1, 2)]
    inner = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), "n").distinct()
    kept = phrases.join(inner, ["lang", "phrase", "n"], "left_anti")

    cuts = kept.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select(
        "lang", "phrase", F.col("n").alias("a"), "cut",
        F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("right"),
    )
    parts = [known.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])) for side in ("left", "right")]
    cuts = cuts.join(parts[0], ["lang", "left"]).join(parts[1], ["lang", "right"]).join(F.broadcast(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of counts pass 64 bits
    score = F.expr("(a1 * total1 * 1000) div (l1 * r1)")
    cuts = cuts.withColumns({"a1": wide("a"), "total1": wide("total"), "l1": wide("l"), "r1": wide("r")}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "total")).alias("x"))
    scored = best.select("lang", "phrase", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")
    return first_of_each(scored, top)


def first_of_each(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank; a language is cut to that in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(scored.sparkSession)))
    part = scored.withColumn("__part", salt)
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.drop("__part").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
