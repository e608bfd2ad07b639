"""Cross-tokenizer alignment: which tokens of one tokenizer lie over which of another.

Tokenizer A is a byte-level BPE file of the ``tokenizers`` library and is given a space and the text; B is a
``sentencepiece`` model, which adds that space itself.  Both token lists cover the same bytes, so each is a list of
ends.

*Galloping intersection.*  The shorter list of ends is walked; each of its ends is searched in the longer one from where
the last search ended, with steps that double and then halve (``gallop``; ``gallop_many`` for many lists at once).  The common ends cut both lists
into groups.  The ranks found on the way say more: the tokens of the longer list from one end's rank to the next one's are
exactly those that overlap a token of the shorter list (``align``).

*Units.*  No token of either tokenizer reaches from a character that is not white space into a space or line break behind it:
A's pre-tokenizer cuts there, and no entry of B's vocabulary holds such a pair (checked when it is loaded).  So
both lists end there, and a text may be aligned unit by unit.  Words repeat, so each distinct unit is encoded and
aligned once per worker and remembered up to ``MEMO_BYTES``; a text is put together from its units.

*Counts.*  How many documents hold an id pair is counted by Spark.  To look the counts up again, the
``HOT_PAIRS`` pairs held most often, which are most of what a text holds, go to all tasks; the others are joined.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import byte_slices, load_tokenizer, stored, utf8

#: bytes of remembered units per Python worker, by an estimate of what each takes
MEMO_BYTES = 64 << 20
#: lists of more ends are searched by themselves, shorter ones many at a time
LANE = 256
#: id pairs whose counts are sent to all tasks
HOT_PAIRS = 1 << 16
#: an id pair is kept in one number, A's id above this many bits of B's
ID_BITS = 24

# White space opens a unit where another character ends the one before; a unit that ends in other white space goes on.
_unit = re.compile(r"[ \n]*[^ \n]+(?:(?<=\s)[ \n]*[^ \n]+)*(?:(?<=\s)[ \n]+)?|[ \n]+")


def gallop(ends: list[int], longer: list[int]) -> tuple[list[int], list[bool]]:
    """For each end its rank in ``longer`` (how many there are smaller) and whether it is there; both ascend."""
    ranks, common, at, n = [], [], 0, len(longer)
    for end in ends:
        step, low = 1, at
        while low + step <= n and longer[low + step - 1] < end:
            low, step = low + step, 2 * step
        high = min(low + step - 1, n)
        while low < high:
            mid = (low + high) // 2
            if longer[mid] < end:
                low = mid + 1
            else:
                high = mid
        at = low
        ranks.append(at)
        common.append(at < n and longer[at] == end)
    return ranks, common


def align(a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Of two lists of ends over the same bytes the groups and the overlaps.

    A group is (tokens of A, tokens of B) up to a common end, as counts from the start.  An overlap is (place in the
    shorter list, first and last place in the longer one); A counts as the shorter of equal lists.
    """
    swap = len(b) < len(a)
    ranks, common = gallop(b, a) if swap else gallop(a, b)
    groups, overlaps, first = [], [], 0
    for i, (rank, both) in enumerate(zip(ranks, common)):
        overlaps.append((i, first, rank))
        first = rank + both
        if both:
            groups.append((rank + 1, i + 1) if swap else (i + 1, rank + 1))
    return groups, overlaps


def gallop_many(ends, starts, counts, longer, longer_starts, longer_counts):
    """``gallop`` for many short lists at once, a lane each: list ``u`` of ``ends`` is searched in list ``u`` of ``longer``.

    Both are given as one array with starts and counts.  Returns places in ``longer`` and whether the end is there.
    """
    place, common = np.zeros(len(ends), np.int64), np.zeros(len(ends), bool)
    at, stop = longer_starts.copy(), longer_starts + longer_counts
    live, i = np.flatnonzero(counts > 0), 0
    while len(live):
        k = starts[live] + i
        end, low, limit, step = ends[k], at[live], stop[live], np.ones(len(live), np.int64)
        while True:
            probe = low + step - 1
            less = (probe < limit) & (longer[np.minimum(probe, limit - 1)] < end)
            if not less.any():
                break
            low, step = np.where(less, low + step, low), np.where(less, 2 * step, step)
        high = np.minimum(low + step - 1, limit)
        while (wide := low < high).any():
            mid = (low + high) // 2
            less = longer[np.minimum(mid, limit - 1)] < end
            low, high = np.where(wide & less, mid + 1, low), np.where(wide & ~less, mid, high)
        at[live] = place[k] = low
        common[k] = (low < limit) & (longer[np.minimum(low, limit - 1)] == end)
        i += 1
        live = live[counts[live] > i]
    return place, common


def _byte_table(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable characters are themselves, the others shifted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in back for c in token):
            out[i] = bytes(back[c] for c in token)
    return out


class Aligner:
    """Two tokenizers and the units aligned so far.  ``exact`` texts are those both give back byte by byte."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        load_tokenizer(path_a)  # sets the library up for one thread
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.bytes_a = _byte_table(self.a.get_vocab(with_added_tokens=False))
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # a unit may begin where no piece of B reaches across
        self.cuts = not any(re.search(r"[^\s▁][▁ \n]", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.lead = len(self.b.encode("x"))
        # how an id is written in the middle of its side of a group, and at its end
        self.written = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"]
        self.written += [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;\n"]
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.tables = None

    def units(self, text: str) -> list[str]:
        return _unit.findall(text) if self.cuts else [text]

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit as it stands in a text: without the space that B would add."""
        own = [u[:1] == " " and len(u) > 1 for u in units]  # B adds its space to what is not empty
        got = self.b.encode([u[1:] if o else "x" + u for u, o in zip(units, own)], num_threads=1)
        return [ids if o else ids[self.lead :] for o, ids in zip(own, got)]

    def learn(self, units: list[str]) -> None:
        """Encode and align units not seen before; a few long ones at a time, so that little is held."""
        at = 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and end - at < 20_000 and (end == at or size + len(units[end]) < 1 << 20):
                size += len(units[end])
                end += 1
            self._learn(units[at:end])
            at = end

    def _exact(self, units: list[str], ids: list[list[int]], table: list[bytes]) -> np.ndarray:
        """Which units the bytes of their tokens give back."""
        if b"".join(map(table.__getitem__, chain.from_iterable(ids))) == "".join(units).encode():
            return np.ones(len(units), bool)
        return np.array([b"".join(map(table.__getitem__, x)) == u.encode() for u, x in zip(units, ids)], bool)

    def _learn(self, units: list[str]) -> None:
        for i, u in enumerate(units, len(self.groups)):
            self.place[u] = i
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.encode_b(units)
        exact = self._exact(units, a, self.bytes_a) & self._exact(units, b, self.bytes_b)
        if not exact.all():
            a, b = ([x if e else [] for x, e in zip(side, exact.tolist())] for side in (a, b))
        na, nb = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])  # both count the bytes of all units
        starts = np.cumsum(na) - na, np.cumsum(nb) - nb
        cut = np.zeros(len(a), bool), np.zeros(len(b), bool)
        pairs, links = [], np.zeros(len(units), np.int64)
        for s, ids, other, n, m in ((0, a, b, na, nb), (1, b, a, nb, na)):  # the side that is the shorter one
            mine = np.flatnonzero((na <= nb) if s == 0 else (nb < na))
            huge = (n[mine] > LANE) & (n[mine] > 0)
            place, common = gallop_many(ends[s], starts[s][mine[~huge]], n[mine[~huge]], ends[1 - s], starts[1 - s][mine[~huge]], m[mine[~huge]])
            for u in mine[huge].tolist():
                own, far = slice(starts[s][u], starts[s][u] + n[u]), slice(starts[1 - s][u], starts[1 - s][u] + m[u])
                ranks, both = gallop(ends[s][own].tolist(), ends[1 - s][far].tolist())
                place[own], common[own] = np.array(ranks) + far.start, both
            k = np.flatnonzero(np.repeat((na <= nb) if s == 0 else (nb < na), n))
            cut[s][k] = common[k]
            cut[1 - s][place[k[common[k]]]] = True
            # the tokens between the rank of the end before and that of this one lie over this token
            unit = np.repeat(np.arange(len(units)), n)
            opens = np.zeros(len(ids), bool)
            opens[starts[s][n > 0]] = True
            before = np.r_[0, place[:-1] + common[:-1]] if len(place) else place
            first = np.where(opens, starts[1 - s][unit], before)[k]
            many = place[k] - first + 1
            over = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            own = np.repeat(k, many)
            pairs.append((unit[own], (ids[own] << ID_BITS) | other[over] if s == 0 else (other[over] << ID_BITS) | ids[own]))
            links += np.bincount(unit[own], minlength=len(units))
        unit, flat = (np.concatenate(x) for x in zip(*pairs))
        flat = flat[np.argsort(unit, kind="stable")]
        groups = np.bincount(np.repeat(np.arange(len(units)), na), cut[0], minlength=len(units)).astype(np.int64)
        # tokens in the order they are written: group by group, A's before B's
        last = np.zeros(len(b), np.int64)
        last[(starts[1] + nb)[nb > 0] - 1] = 1
        codes = np.r_[2 * a + cut[0], 2 * len(self.bytes_a) + 3 * b + cut[1] + last]
        turn = np.r_[2 * (np.cumsum(cut[0]) - cut[0]), 2 * (np.cumsum(cut[1]) - cut[1]) + 1]
        shown = iter("".join(map(self.written.__getitem__, codes[np.argsort(turn, kind="stable")].tolist())).split("\n"))
        self.groups += [next(shown) if e else None for e in (exact & (na > 0)).tolist()]
        self.parts.append((na, nb, links, groups, exact, flat))
        self.size += 250 * len(units) + 2 * sum(map(len, units)) + 30 * len(a) + 8 * len(flat)
        self.tables = None

    def arrays(self):
        """Per unit: tokens of A and B, links, groups, whether exact, start and pairs in one list."""
        if self.tables is None:
            if self.parts:
                self.parts = [tuple(map(np.concatenate, zip(*self.parts)))]
                na, nb, links, groups, exact, flat = self.parts[0]
            else:
                na = nb = links = groups = flat = np.zeros(0, np.int64)
                exact = np.zeros(0, bool)
            self.tables = (na, nb, links, groups, exact, np.cumsum(links) - links, flat)
        return self.tables


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, made once per Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _align_slice(al: Aligner, texts: list[bytes], keep: bool):
    """Columns of one slice of texts, without ``doc_id``."""
    if al.size > MEMO_BYTES:
        al.reset()
    split = [al.units(" " + t.decode()) if t else [] for t in texts]
    fresh = set(chain.from_iterable(split)).difference(al.place)
    al.learn(list(fresh))
    counts = np.fromiter(map(len, split), np.int64, len(split))
    at = np.fromiter(map(al.place.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    na, nb, links, groups, exact, starts, flat = al.arrays()
    inexact = np.bincount(doc, ~exact[at], minlength=len(texts)) > 0
    add = lambda column: np.where(inexact, 0, np.bincount(doc, column[at], minlength=len(texts)).astype(np.int64))
    columns = [add(c) for c in (na, nb, groups, links)]
    shown, used = [], np.cumsum(counts) - counts
    for i, s in enumerate(split):
        whole = "" if inexact[i] or not s else ";".join([al.groups[k] for k in at[used[i] : used[i] + counts[i]].tolist()])
        shown.append(whole if keep else hashlib.sha256(whole.encode()).hexdigest() if whole else "")
    # distinct units of each document, then distinct pairs of each document
    good = ~inexact[doc]
    unit, unit_times = np.unique(doc[good] * len(na) + at[good], return_counts=True)
    doc, at = unit // max(1, len(na)), unit % max(1, len(na))
    n = links[at]
    take = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pair, pair_times, doc = flat[take], np.repeat(unit_times, n), np.repeat(doc, n)
    order = np.lexsort((pair, doc))
    pair, pair_times, doc = pair[order], pair_times[order], doc[order]
    new = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(doc) != 0)]) if len(pair) else np.zeros(0, np.int64)
    times = np.add.reduceat(pair_times, new) if len(pair) else pair_times
    pair, doc = pair[new], doc[new]
    borders = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(borders, pa.array(pair)), pa.ListArray.from_arrays(borders, pa.array(times.astype(np.int32)))]
    return [*map(pa.array, columns), pa.array(shown, pa.string()), *lists]


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times``, and extra columns not at all.

    ``pairs`` are the distinct linked id pairs (``a << 24 | b``) and ``times`` how often each is linked; links are all
    pairs of token occurrences whose byte ranges overlap.  Groups are written ``a1,a2|b1;a3|b2,b3``; with
    ``keep_groups`` the column ``groups`` has them whole in place of their hash.  Texts that are NULL, empty or not
    given back byte by byte by both tokenizers have no tokens: zeros, an empty string and empty lists.  Repeated
    rows give a row each; a NULL ``doc_id`` stays NULL.
    """

    def run(batches):
        al = aligner(path_a, path_b)
        for batch in batches:
            for part in byte_slices(batch, 1):
                arrays = [part.column(0), *_align_slice(al, part.column(1).to_pylist(), keep_groups)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = _ROW.replace("groups_sha256", "groups") if keep_groups else _ROW
    names = [c.split()[0] for c in schema.split(", ")]
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    return body.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best``: in how many rows a pair is linked, and whether no pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", ID_BITS)), "alignment-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its lists."""
    spark = aligned.sparkSession
    hot = counts.orderBy(F.desc("docs"), "pair").limit(HOT_PAIRS).collect()
    table = np.array(sorted((r["pair"], r["docs"], int(r["best"])) for r in hot) or [(-1, 0, 0)], np.int64)
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        known = np.ascontiguousarray(shared.value[:, 0])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                pairs, times = part.column(1), part.column(2)
                flat = pairs.flatten().to_numpy(zero_copy_only=False)
                n = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(pairs.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                have = known[at] == flat
                # integers stay exact: a sum of counts may pass what a double holds
                best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(total, row[have], (n * shared.value[at, 1])[have])
                np.add.at(best, row[have], (n * shared.value[at, 2])[have])
                borders = pa.array(np.searchsorted(row[~have], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(borders, pa.array(x[~have])) for x in (flat, n.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best), pa.array(total), *lists], names=names)

    names = ["row", "best", "total", "pairs", "times"]
    looked = aligned.select("row", "pairs", "times").mapInArrow(run, "row long, best long, total long, pairs array<long>, times array<int>")
    looked = stored(looked, "alignment-looked-up")
    rare = looked.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rare = rare.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("n")).join(counts, "pair")
    parts = rare.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("best"), (F.col("n") * F.col("docs")).alias("total"))
    sums = looked.select("row", "best", "total").unionByName(parts).groupBy("row")
    sums = sums.agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row").drop("row")


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``count_sum`` adds up, over a document's links, in how many documents of all the link's id pair is linked; ``n_best``
    counts the links whose pair is in as many documents as any pair of its A id.  Every row is a document, also if its
    id repeats or is NULL.
    """
    rows = align_documents(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id())
    aligned = stored(rows, "alignment-documents")
    counted = with_counts(aligned, stored(pair_counts(aligned), "alignment-pairs"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
