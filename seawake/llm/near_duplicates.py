"""N-gram Jaccard join with token-combination prefixes.

The set of a document is its distinct word shingles, as 64-bit hashes.  Equal sets collapse to one
representative first, so copies cost nothing later.

*Prefixes.*  Shingles have one global order, rare ones first.  Two sets of similarity ``t`` can miss
at most ``|x| - ceil(t |x|)`` shingles of each other, so they share one among the first few of that
order.  A rare shingle is indexed alone.  Frequent shingles fall into groups, and only pairs of
the same group are indexed; the prefix is extended until

    rare shingles + sum over groups of (shingles of the group - 1)  >=  missing shingles allowed + 1.

If two similar sets shared no rare shingle and no pair, they could share at most one shingle per
group within the shorter prefix, and so would miss more than is allowed.  So no link is lost,
whatever shingles are called frequent: frequencies steer the cost alone, never the result.  They
come from a sketch of fixed size that counts every shingle of every document.

*Verification.*  Documents that share a key are candidates.  Emitting their pairs would be quadratic, and
similar documents share many keys.  So each key names its least document as leader, and all documents under
the keys of one leader form a group: a pair that shares a key is in a group together, and in few.  A
group is compared whole, by the products of its shingle-by-document matrix, in one task or, if larger than
``BLOCK``, in blocks; what comes out is a forest of links.  Large groups are first checked against their
leader alone, and documents that are in one component after that are not compared again.

*Sifting.*  Most documents that share a key by chance are not similar, and with the corpus there are more of
them.  So groups are first compared by signatures: a set's is the parity of its shingles in about as many bits
as it has shingles, and two signatures never differ in more bits than their sets differ in shingles.  Sets are
made, and travel, only for documents some signature of their group is near enough to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.llm.common import shuffle_width, slices, small_batches, stored, utf8
from seawake.llm.components import connected
from seawake.llm.ids import drop_ids, has_bit, id_bits, with_bit

_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: words a Python worker remembers the hash of before it starts afresh
MEMO_WORDS = 250_000
_memo: dict[bytes, int] = {}

#: counters of the frequency sketch (2 ** SKETCH_BITS) and how many travel in one row
SKETCH_BITS, SKETCH_ROW = 22, 1 << 13
#: a shingle is frequent from this many times the mean count of a counter, and this many at least
FREQUENT_TIMES, FREQUENT_LEAST = 6, 64
#: (from set size, to set size, groups of frequent shingles); neighbouring ranges overlap by more than
#: the sizes of two similar sets can differ, so every similar pair has a range in common
TIERS = ((0, 40, 1), (28, 1_000, 4), (700, 16_000, 64), (11_000, 1 << 40, 1024))
#: documents of a group that one task compares with each other or with as many others
BLOCK = 256
#: columns of the incidence matrix multiplied at once
COLUMNS = 8_192
#: bits of the shortest signature
LEAST_BITS = 256

_M1, _M2, _M3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (between ASCII white space) of a text, A-Z lower-cased."""
    return hash_words(text.translate(_lower).split())


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of words, each distinct one computed once per Python worker."""
    fresh = set(words).difference(_memo)
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
        fresh = set(words)
    for w in fresh:
        _memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """At the end of a task: the worker lives on, beside those of later stages."""
    _memo.clear()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words is one shingle, without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.full(n, len(w) if len(w) < width else width, np.uint64)
    for i in range(min(width, len(w))):
        h = h * _M3 + _mix(w[i : i + n] + np.uint64(i))
    return np.unique(_mix(h))


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signature(shingles: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit; a power of two of bits, as many as shingles at least."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_be_similar(sizes: np.ndarray, signatures: list[bytes], percent: int) -> np.ndarray:
    """For all pairs of sets whether their signatures leave it open that they are similar.

    Sets are similar if the shingles in one of them alone are at most (100 - percent) / (100 + percent) of their sizes'
    sum.  A longer signature is folded to half its length; if it is longer still, the sizes are too far apart.
    """
    lengths = np.array(list(map(len, signatures)))
    out = np.zeros((len(sizes), len(sizes)), bool)
    for length in np.unique(lengths):
        at = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        words = np.zeros((len(at), length // 8), np.uint64)
        for k, i in enumerate(at):
            w = np.frombuffer(signatures[i], np.uint64)
            words[k] = w if lengths[i] == length else w[: length // 8] ^ w[length // 8 :]
        for k, i in enumerate(at):
            if lengths[i] == length:
                apart = np.bitwise_count(words ^ words[k]).sum(1, dtype=np.int64)
                out[i, at] |= apart * (100 + percent) <= (sizes[i] + sizes[at]) * (100 - percent)
    return out | out.T


def _describe(width: int):
    """Per document its set's size, fingerprint and signature; at the end of the task its share of the sketch."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("f1", pa.int64()),
            ("f2", pa.int64()),
            ("signature", pa.binary()),
            ("row", pa.int32()),
            ("counts", pa.binary()),
        ]
    )

    def run(batches):
        sketch, held, n = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def count():
            flat = np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)
            places, times = np.unique(flat.astype(np.int64), return_counts=True)
            sketch[places] += times.astype(np.uint32)
            held.clear()

        for batch in batches:
            for ids, texts in slices(batch, "doc_id", "body"):
                sets = [shingle_set(t, width) for t in texts]
                held += sets
                n += sum(map(len, sets))
                if n > 500_000:
                    count()
                    n = 0
                prints = [_fingerprint(s) for s in sets]
                marks = [signature(s) if len(s) > 1 else None for s in sets]
                columns = [ids, list(map(len, sets)), *zip(*prints), marks, [None] * len(ids), [None] * len(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if held:
            count()
        forget_words()  # the sketch is packed next
        packer = zstandard.ZstdCompressor(level=1)
        rows = [
            (i, packer.compress(sketch[at : at + SKETCH_ROW].tobytes()))
            for i, at in enumerate(range(0, len(sketch), SKETCH_ROW))
            if sketch[at : at + SKETCH_ROW].any()
        ]
        if rows:
            columns = [[None] * len(rows)] * 5 + [list(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _add_up(key, table):
    total = np.zeros(SKETCH_ROW, np.uint64)
    unpack = zstandard.ZstdDecompressor().decompress
    for c in table.column("counts").to_pylist():
        total += np.frombuffer(unpack(c), np.uint32)
    data = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([data], pa.binary())})


class Frequencies:
    """The summed sketch: an upper bound of how many documents hold a shingle.  Its size is fixed."""

    def __init__(self, rows):
        self.counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for r in rows:
            at = r["row"] * SKETCH_ROW
            self.counts[at : at + SKETCH_ROW] = np.frombuffer(r["counts"], "<u4")
        self.frequent = max(FREQUENT_LEAST, FREQUENT_TIMES * float(self.counts.mean()))

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return self.counts[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def least_overlap(n: int, percent: int) -> int:
    """The least number of common shingles of a set of size n and any set similar to it."""
    return -(-n * percent // 100)


def index_keys(shingles: np.ndarray, freq: Frequencies, percent: int) -> np.ndarray:
    """Keys of which two different similar sets share at least one."""
    n = len(shingles)
    need = n - least_overlap(n, percent) + 1
    if n < 2:  # only an equal set is similar to a set of one
        return np.zeros(0, np.uint64)
    counts = freq.of(shingles)
    order = np.argsort(counts, kind="stable")  # equal counts stay in the order of the hash
    ordered = shingles[order]
    if counts[order[need - 1]] < freq.frequent:  # the plain prefix is all rare, in every tier
        return ordered[:need]
    common = counts[order] >= freq.frequent
    keys = []
    for tier, (least, most, groups) in enumerate(TIERS):
        if not least <= n <= most:
            continue
        group = np.where(common, (ordered >> np.uint64(8)) % np.uint64(groups), 0).astype(np.int64)
        at = np.flatnonzero(common)
        _, firsts = np.unique(group[at], return_index=True)
        worth = np.ones(n, np.int64)
        worth[at[firsts]] = 0
        end = min(n, int(np.searchsorted(np.cumsum(worth), need)) + 1)
        keys.append(ordered[:end][~common[:end]])
        at = at[at < end]
        by = at[np.argsort(group[at], kind="stable")]
        borders = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1], True]) if len(by) else np.zeros(1, int)
        for a, b in zip(borders, borders[1:]):
            members = np.sort(ordered[by[a:b]])
            i, j = np.triu_indices(len(members), 1)
            keys.append(_mix(members[i] * _M1 + _mix(members[j] + np.uint64(tier + 1))))
    return np.unique(np.concatenate(keys))


def _index(width: int, percent: int, freq, skip=None):
    """Keys of each document and its set's size; documents whose bit is set in ``skip`` are left out."""

    def run(batches):
        for batch in batches:
            if skip is not None:
                batch = batch.filter(pa.array(~has_bit(skip.value, batch.column(0).to_numpy())))
            for ids, texts in slices(batch, "doc_id", "body"):
                sets = [shingle_set(t, width) for t in texts]
                keys = [index_keys(s, freq.value, percent) for s in sets]
                sizes = list(map(len, keys))
                flat = np.concatenate(keys).view(np.int64)
                docs = np.repeat(np.array(ids, np.int64), sizes)
                n = np.repeat(np.array(list(map(len, sets)), np.int64), sizes)
                for at in range(0, len(flat), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in (flat, docs, n)], names=["key", "doc", "n"])
        forget_words()

    return run


def _sets(width: int, bits):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(bits.value, batch.column(0).to_numpy())))
            for ids, texts in slices(batch, "doc_id", "body"):
                sets = [shingle_set(t, width).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc", "shingles"])
        forget_words()

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i, (s, t) in enumerate(zip(x, y)):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"]
            )

    return run


def _near(percent: int):
    """The pairs whose signatures leave it open that they are similar."""

    def run(batches):
        for batch in batches:
            m, n = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            keep = [may_be_similar(np.array(z[:2]), list(z[2:]), percent)[0, 1] for z in zip(m, n, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar; only the second set of a pair travels with it."""
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return full.mapInArrow(_verify(percent), "a long, b long")


def _near_pairs(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    right = marks.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    left = marks.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "sa", "sb")
    return full.mapInArrow(_near(percent), "a long, b long").distinct()


def similar_forest(docs, comps, blocks, sets, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of these documents as far as similar pairs do.

    With two different ``blocks`` only pairs across them count.  Overlaps come from products of the incidence
    matrix of the shingles that occur more than once.
    """
    sizes = np.array([len(s) for s in sets])
    shingles, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    rank = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    similar = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    similar &= comps[:, None] != comps[None, :]
    if blocks.min() != blocks.max():
        similar &= blocks[:, None] != blocks[None, :]
    top: dict[int, int] = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for i, j in np.argwhere(similar).tolist():
        x, y = find(int(comps[i])), find(int(comps[j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((int(docs[i]), int(docs[j])))
    return out


def _comparisons(table):
    """The rows of each comparison ``lead, i, j`` of a part that has two at least."""
    lead, i, j, docs = (table.column(n).to_numpy() for n in ("lead", "i", "j", "doc"))
    order = np.lexsort((docs, j, i, lead))
    cut = np.flatnonzero((np.diff(lead[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    return [at for at in np.split(order, cut) if len(at) > 1]


def _sift(percent: int):
    """The rows of a part that some other row of their comparison may be similar to."""

    def run(table):
        docs, comps, own, n = (table.column(c).to_numpy() for c in ("doc", "comp", "own", "n"))
        marks = table.column("signature").to_pylist()
        keep = []
        for at in _comparisons(table):
            near = may_be_similar(n[at], [marks[k] for k in at], percent) & (comps[at][:, None] != comps[at][None, :])
            if own[at].min() != own[at].max():
                near &= own[at][:, None] != own[at][None, :]
            at = at[near.any(1)]  # in the order of the documents, of which each stays once
            keep += at[np.r_[True, np.diff(docs[at]) != 0]].tolist() if len(at) else []
        return table.select(["lead", "i", "j", "doc", "comp", "own"]).take(pa.array(keep, pa.int64()))

    return run


def _compare(percent: int):
    """All groups of a part: rows of one ``lead, i, j`` are compared with each other."""

    def run(table):
        docs, comps, own = (table.column(n).to_numpy() for n in ("doc", "comp", "own"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        links = []
        for at in _comparisons(table):
            links += similar_forest(docs[at], comps[at], own[at], [sets[k] for k in at], percent)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_comp(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    side = labels.select(F.col("node").alias(column), F.col("comp").alias("_c"))
    return df.join(side, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def _dealt(rows: DataFrame, side: DataFrame, parts: int):
    """The rows with what ``side`` has of their documents, the comparisons dealt to parts."""
    return rows.join(side, "doc").withColumn("part", F.pmod(F.xxhash64("lead", "i", "j"), F.lit(parts))).groupBy("part")


def _near_groups(groups: DataFrame, labels: DataFrame, marks: DataFrame, percent: int, parts: int) -> DataFrame:
    """What is to be compared, ``lead, i, j, doc, comp, own``, of the groups ``lead, doc``: rows of different
    components that signatures do not tell apart.

    A small group is one comparison.  In a large one the documents of the leader's component and the others
    form blocks; a block of others meets every block, two of the leader's component never meet.
    """
    g = _with_comp(_with_comp(groups, labels, "doc", "comp"), labels, "lead", "main")
    other = F.count_if(F.col("comp") != F.col("main"))
    size = g.groupBy("lead").agg(F.count(F.lit(1)).alias("m"), other.alias("o")).where("o > 0")
    g = g.join(size, "lead").withColumn("small", F.col("m") <= BLOCK)
    first, rest = F.ceil((F.col("m") - F.col("o")) / BLOCK), F.ceil(F.col("o") / BLOCK)
    pick = F.xxhash64("doc")
    own = F.when(F.col("comp") == F.col("main"), F.pmod(pick, first)).otherwise(first + F.pmod(pick, rest))
    g = g.withColumn("own", F.when(F.col("small"), F.lit(0)).otherwise(own).cast("int"))
    meets = F.when(F.col("small"), F.array(F.lit(0).cast("long"))).when(
        F.col("comp") == F.col("main"), F.sequence(first.cast("long"), (first + rest - 1).cast("long"))
    ).otherwise(F.sequence(F.lit(0).cast("long"), (first + rest - 1).cast("long")))
    g = g.withColumn("k", F.explode(meets)).withColumn("k", F.col("k").cast("int"))
    g = g.select("lead", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "doc", "comp", "own")
    return _dealt(g, marks, parts).applyInArrow(_sift(percent), g.schema)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable over links, itself included.

    Two documents link when their shingle sets (``width`` words, A-Z lower-cased, words between
    ASCII white space) have ``100 * intersection >= percent * union``.  Documents without words,
    or without text, link with nothing.  A NULL ``doc_id`` is a document of its own that links
    with nothing; repeated rows of an id are one document for linking (their texts' sets all count)
    and give one row each.
    """
    if percent < 70:
        raise ValueError("the size ranges of TIERS hold for similarities from 70 %")
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    seen = stored(
        body.mapInArrow(_describe(width), "doc_id long, n long, f1 long, f2 long, signature binary, row int, counts binary"),
        "jaccard-docs",
    )
    about = seen.where("row is null").select("doc_id", "n", "f1", "f2")
    parts = seen.where("row is not null").select("row", "counts")
    sketch = parts.groupBy("row").applyInArrow(_add_up, "row int, counts binary")
    freq = spark.sparkContext.broadcast(Frequencies(sketch.collect()))

    # one representative per set; an id with several texts ties their sets together
    solid = about.where("doc_id is not null and n > 0")
    reps = stored(solid.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jaccard-sets")
    several = solid.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    ties = solid.join(several, "doc_id").join(reps, ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(ties.where("a <> b"), "jaccard-links")

    # keys of the representatives; copies cannot add to them and are left out, by a bit field and exactly
    named = body.where("doc_id is not null")
    copies = solid.select("doc_id").distinct().join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    skip = spark.sparkContext.broadcast(id_bits(copies))
    columns = "key long, doc long, n long"
    keys = named.mapInArrow(_index(width, percent, freq, skip), columns)
    alike = stored(with_bit(reps.select(F.col("rep").alias("doc_id")), "doc_id", skip.value), "jaccard-alike")
    if not alike.isEmpty():
        rest = with_bit(named, "doc_id", id_bits(alike)).join(alike, "doc_id", "left_semi")
        keys = keys.unionByName(rest.mapInArrow(_index(width, percent, freq), columns))

    # documents that share a key with another one of a size that allows a link: sizes that do lie in
    # one class or in neighbouring ones, so each document is put under its class and the next.  All of it
    # happens where the one shuffle puts a key
    ends = lambda w: {"d0": F.min("doc").over(w), "d1": F.max("doc").over(w)}
    step = math.log(100 / percent) * 1.0001
    size = F.floor(F.log("n") / step)
    found = keys.repartition(shuffle_width(spark), "key").withColumns(ends(W.partitionBy("key"))).where("d0 <> d1")
    found = found.select("key", F.explode(F.array(size, size + 1)).alias("size"), "doc")
    found = found.withColumns(ends(W.partitionBy("key", "size"))).where("d0 <> d1")
    groups = stored(found.select(F.col("d0").alias("lead"), "doc").distinct(), "jaccard-groups")
    freq.unpersist()
    skip.unpersist()
    bits = id_bits(groups.select("doc"))
    marks = seen.where("row is null and doc_id is not null and n > 1").select(F.col("doc_id").alias("doc"), "n", "signature")
    marks = stored(with_bit(marks, "doc", bits), "jaccard-signatures")

    def sets_of(rows: DataFrame) -> DataFrame:
        bits = spark.sparkContext.broadcast(id_bits(rows))
        return stored(named.mapInArrow(_sets(width, bits), "doc long, shingles binary"), "jaccard-shingles")

    large = groups.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("lead")
    star = groups.join(large, "lead").where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
    star = stored(_near_pairs(star, marks, percent), "jaccard-star")
    if not star.isEmpty():
        sets = sets_of(star.select(F.explode(F.array("a", "b")).alias("doc")))
        links = links.unionByName(stored(_links(star, sets, percent), "jaccard-links"))
    labels = stored(connected(links), "jaccard-labels")
    parts = 4 * shuffle_width(spark)
    near = stored(_near_groups(groups, labels, marks, percent, parts), "jaccard-near")
    alike = _dealt(near, sets_of(near.select("doc")), parts).applyInArrow(_compare(percent), "a long, b long")
    links = links.unionByName(stored(alike, "jaccard-links"))
    labels = stored(connected(links), "jaccard-labels")

    tops = reps.join(labels, reps.rep == labels.node, "left").select("f1", "f2", F.coalesce("comp", "rep").alias("top"))
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("f1"))
    out = about.withColumn("g1", own).join(tops.withColumnRenamed("f1", "g1").withColumnRenamed("f2", "g2"), ["g1"], "left")
    out = out.where("g2 is null or g2 = f2")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of the smallest id, with all its columns.

    Documents without words stay, as do those without id; of rows that share an id one stays.
    """
    found = stored(jaccard_components(docs, width, percent).select("doc_id", "component_id"), "jaccard-components")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = drop_ids(docs, gone)
    again = again.select("doc_id").join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return out
    field = id_bits(again)
    order = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = with_bit(out, "doc_id", field).withColumn("_n", F.row_number().over(order)).where("_n = 1 or doc_id is null")
    return with_bit(out, "doc_id", field, False).unionByName(first.drop("_n"))
