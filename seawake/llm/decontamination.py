"""Benchmark decontamination by spaced-seed hashing.

Texts are words: A-Z lower-cased, ASCII letters, digits and everything outside ASCII, split at the rest.
A seed is a fixed mask laid over a run of words; it hashes the words under its ones and ignores the
others.  The masks are chosen so that any 15 words of which at most 3 were substituted
still have a place where one of the masks sees none of the substitutions, and likewise the whole of a
shorter item with the substitutions its length allows (``SHORT``): with the limits below no such
overlap is missed.  Documents are hashed with the masks that the benchmark's items need.

1. Benchmark seeds are hashed; a bit field of fixed length is made of them and sent to all tasks.
2. Tasks hash all seeds of all documents and keep the places whose bits are set, grouped into regions
   of words.  What has nothing in common with the benchmark ends here.
3. The kept hashes are joined with the benchmark's; a match gives a document, an item and a shift.
4. Each shift is verified on the words around: an overlap counts if ``window`` aligned words (or the whole
   item, if shorter) agree in at least ``percent`` of their places.  Places beyond the end of a text count
   as different, so twelve equal words are enough at a border too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import slices, small_batches, stored, utf8
from seawake.llm.ids import drop_ids, folded_bits
from seawake.llm.near_duplicates import _mix, forget_words, hash_words

MASKS = ("1111011", "11001000111", "11010110001")
#: masks of shorter items: from, to how many words, and the masks; 13 and 14 words have those above
SHORT = (
    (1, 1, ("1",)),
    (2, 2, ("11",)),
    (3, 3, ("111",)),
    (4, 4, ("1111",)),
    (5, 6, ("1111", "10111", "11011", "11101")),
    (7, 9, ("11111", "110111", "111101")),
    (10, 12, ("111011", "1101011", "1110011")),
)
WINDOW, PERCENT = 15, 80
#: an item of fewer words is no evidence
SHORTEST = 7
#: words of a region at most; the parts of a longer one overlap and are put together again after the comparison
REGION = 512
#: the bit field holds 2 ** FIELD_BITS bits, two for each seed
FIELD_BITS = 24

_words = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_ALL = tuple(dict.fromkeys((*MASKS, *(m for _, _, masks in SHORT for m in masks))))
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in _ALL]
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x51ED270B) for i in range(16)]


def words_of(text: bytes) -> np.ndarray:
    return hash_words(text.translate(_words).split())


def masks_of(n: int) -> tuple[int, ...]:
    """The numbers of the masks for an item of ``n`` words."""
    return tuple(_ALL.index(m) for m in next((masks for a, b, masks in SHORT if a <= n <= b), MASKS))


def seeds(words: np.ndarray, masks: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per mask the hashes of its places and the word each starts at."""
    out = []
    for k in masks:
        offsets = _OFFSETS[k]
        n = max(0, len(words) - int(offsets[-1]))
        h = np.full(n, k + 1, np.uint64)
        for j, o in enumerate(offsets):
            h += words[o : o + n] * _ODD[j]
        out.append((_mix(h), np.arange(n)))
    return out


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << FIELD_BITS) - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)


def _item_seeds(window: int, shortest: int):
    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch, "item_id", "body"):
                rows = []
                for item, text in zip(ids, texts):
                    w = words_of(text)
                    masks = masks_of(len(w)) if len(w) >= shortest else ()
                    for k, (h, at) in zip(masks, seeds(w, masks)):
                        for x, i in zip(h.view(np.int64).tolist(), at.tolist()):
                            around = w[max(0, i - window) : i + 2 * window]
                            same = xxhash.xxh3_64_intdigest(around.tobytes()) >> 1
                            rows.append((x, item, i, k, same))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["h", "item_id", "i", "mask", "same"])

    return run


def bit_field(item_seeds: DataFrame) -> np.ndarray:
    """The bits of all benchmark seeds, put together by Spark; its size does not depend on theirs."""
    low = (1 << FIELD_BITS) - 1
    at = F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low)))
    return folded_bits(item_seeds.select(at.alias("b")), 1 << FIELD_BITS)


_REGION = "doc_id long, text long, start int, cut boolean, words binary, hits array<struct<h:long,at:int>>"


def _regions(field, masks: tuple[int, ...], window: int):
    hit_type = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), hit_type)

    def on(h):
        a, b = _bits(h)
        f = field.value
        one = np.uint32(1)
        return ((f[a >> 5] >> (a & 31).astype(np.uint32)) & (f[b >> 5] >> (b & 31).astype(np.uint32)) & one) == one

    def of(doc, w):
        found = [(h[k], at[k]) for h, at in seeds(w, masks) for k in [on(h)]]
        h, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        h, at = h[order].view(np.int64), at[order]
        text = xxhash.xxh3_64_intdigest(w.tobytes()) >> 1  # tells apart texts of one id
        first, goes_on = 0, False
        while first < len(at):
            last = first
            while last + 1 < len(at) and at[last + 1] - at[last] <= window and at[last + 1] - at[first] < REGION:
                last += 1
            before, goes_on = goes_on, bool(last + 1 < len(at) and at[last + 1] - at[last] <= window)
            start, end = max(0, at[first] - window), at[last] + 2 * window
            hits = [{"h": x, "at": i} for x, i in zip(h[first : last + 1].tolist(), at[first : last + 1].tolist())]
            yield doc, text, int(start), before or goes_on, w[start:end].astype("<u8").tobytes(), hits
            first = last + 1

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch, "doc_id", "body"):
                rows = [r for doc, text in zip(ids, texts) for r in of(doc, words_of(text))]
                if rows:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "start", "cut", "words", "hits"])
        forget_words()

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int, percent: int) -> tuple[int, int, int] | None:
    """(first word, words, equal words) of the aligned stretches that pass, or None.

    ``shift`` is where word 0 of the item would lie in ``doc``.
    """
    lo, same = aligned(doc, item, shift)
    got = passing(same, min(window, len(item)), percent)
    return got and (lo + got[0], *got[1:])


def aligned(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, np.ndarray]:
    """The first word of ``doc`` that lies beside one of ``item``, and from there which words are equal."""
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    return lo, doc[lo:hi] == item[lo - shift : max(lo, hi) - shift]


def passing(same: np.ndarray, size: int, percent: int) -> tuple[int, int, int] | None:
    """(first, words, equal words) of the passing stretches of aligned words, or None; ``size`` words are judged at once."""
    if not len(same):
        return None
    same = same.astype(np.int64)
    if len(same) < size:  # one window holds all, and places that differ
        equal = int(same.sum())
        return (0, len(same), equal) if 100 * equal >= percent * size else None
    sums = np.convolve(same, np.ones(size, np.int64), "valid")
    good = np.flatnonzero(100 * sums >= percent * size)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + size
    return first, last - first, int(same[first:last].sum())


_FOUND = "doc_id long, item_id long, start_word int, n_words int, n_equal int"
_PART = "text long, shift int, size int, at int, same binary"


def _verify(window: int, percent: int):
    """Judges whole regions; of parts of a cut one it gives on which words are equal, a byte for each."""
    names = [f.split()[0] for f in f"{_FOUND}, {_PART}".split(", ")]
    types = (pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 3, pa.binary())

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, start, cut, words, item, body, shift in zip(*(batch.column(i).to_pylist() for i in range(8))):
                beside = words_of(body)
                size = min(window, len(beside))
                lo, same = aligned(np.frombuffer(words, "<u8"), beside, shift - start)
                if cut:
                    if same.any():
                        rows.append((doc, item, None, None, None, text, shift, size, start + lo, same.tobytes()))
                elif got := passing(same, size, percent):
                    rows.append((doc, item, start + lo + got[0], got[1], got[2], None, None, None, None, None))
            columns = list(zip(*rows)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _joined(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parts of one text, item and shift, put together where they touch; at most the item's words in all."""
        pdf = pdf.sort_values("at", kind="stable")
        size, rows, runs = int(pdf["size"].iloc[0]), [], []
        for at, part in zip(pdf["at"], pdf["same"]):
            part = np.frombuffer(part, np.bool_)
            if runs and at <= runs[-1][0] + len(runs[-1][1]):
                begin, have = runs[-1]
                runs[-1] = (begin, np.concatenate([have, part[max(0, begin + len(have) - at) :]]))
            else:
                runs.append((at, part))
        for at, same in runs:
            if got := passing(same, size, percent):
                rows.append((pdf["doc_id"].iloc[0], pdf["item_id"].iloc[0], at + got[0], got[1], got[2]))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    percent: int = PERCENT,
    shortest: int = SHORTEST,
    every: bool = True,
) -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id, item_id, start_word, n_words, n_equal``.

    The words are counted in the document; the longest passing stretch of a pair is given, the first
    of equals.  With ``every=False`` only the least item is used of benchmark places with the same
    surroundings, so a passage many items share does not multiply; the documents named are the same.
    Items under ``shortest`` words are too short to be evidence and
    match nothing; items under ``window`` words must match over their whole length.  Texts that are
    NULL or empty overlap nothing; rows without id have no name to be given and are left to ``decontaminate``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("body"))
    own = items.mapInArrow(_item_seeds(window, shortest), "h long, item_id long, i int, mask int, same long")
    if not every:
        own = own.groupBy("h", "same").agg(F.min(F.struct("item_id", "i", "mask")).alias("p")).select("h", "p.*")
    own = stored(own.select("h", "item_id", "i", "mask").distinct(), "benchmark-seeds")
    masks = tuple(sorted(r["mask"] for r in own.select("mask").distinct().collect())) or masks_of(window)
    own = own.drop("mask")
    field = spark.sparkContext.broadcast(bit_field(own))

    body = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    regions = stored(body.mapInArrow(_regions(field, masks, window), _REGION), "benchmark-regions")
    hits = regions.select("doc_id", "start", F.xxhash64("words").alias("w"), F.explode("hits").alias("x"))
    hits = hits.select("doc_id", "start", "w", "x.h", "x.at").join(own, "h")
    shifts = hits.select("doc_id", "start", "w", "item_id", (F.col("at") - F.col("i")).alias("shift")).distinct()
    around = regions.select("doc_id", "text", "start", F.xxhash64("words").alias("w"), "cut", "words").distinct()
    full = shifts.join(around, ["doc_id", "start", "w"]).join(items, "item_id")
    checked = full.select("doc_id", "text", "start", "cut", "words", "item_id", "body", "shift").mapInArrow(
        _verify(window, percent), f"{_FOUND}, {_PART}"
    )
    checked = stored(checked, "benchmark-overlaps")
    parts = checked.where("same is not null").select("doc_id", "item_id", "text", "shift", "size", "at", "same")
    parts = parts.groupBy("doc_id", "item_id", "text", "shift").applyInPandas(_joined(percent), _FOUND)
    checked = checked.where("same is null").select("doc_id", "item_id", "start_word", "n_words", "n_equal").unionByName(parts)
    best = F.max(F.struct("n_equal", "n_words", (-F.col("start_word")).alias("s"))).alias("b")
    found = checked.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.n_words", "b.n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns; rows without id are judged one by one."""
    kept = drop_ids(docs, stored(benchmark_overlaps(docs, benchmark, every=False).select("doc_id").distinct(), "benchmark-ids"))
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    numbered = stored(nameless.withColumn("__row", F.monotonically_increasing_id()), "benchmark-nameless")
    found = benchmark_overlaps(numbered.select(F.col("__row").alias("doc_id"), "text"), benchmark, every=False)
    found = stored(found.select(F.col("doc_id").alias("__row")).distinct(), "benchmark-rows")
    rest = numbered.join(found, "__row", "left_anti").select(docs.columns)
    return kept.where("doc_id is not null").unionByName(rest)
