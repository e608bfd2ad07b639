"""Repeated passages by a sparse suffix array, sorted deep-shallow.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a smaller document,
or further ahead in the same one).  Sorting every suffix of the corpus is not needed for that:

1. *Anchors.*  Of the ``GRAM``-byte strings that start in a window of ``length`` bytes, the one least by hash is
   an anchor.  Equal windows choose the same anchor at the same place, so every repeated string shows at an
   anchor; there is one for about forty bytes.
2. *Contexts.*  All windows around an anchor lie within ``length - GRAM`` bytes before and ``length`` bytes from
   it.  An anchor whose whole context was seen before repeats in all its windows.  Tasks settle
   that among their own anchors first, so of a passage that many documents share only one
   context per task is shuffled.
3. *Suffixes.*  What is left are first contexts whose anchor occurs in several: the borders of repeated
   passages.  Their suffixes from the anchor on, and their reversed prefixes, are sorted: multikey
   quicksort to a shallow depth, then blind tries for the groups that agree so far.  Common prefix
   lengths of the sorted suffixes tell, for every offset of the window, which are equal.
4. Marked windows are gathered per document, and the texts cut.

An anchor with more than ``HOT`` different contexts would make one task large in step 3; its windows
are compared by an aggregate over their 128-bit hashes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import shuffle_width, slices, stored, utf8
from seawake.llm.ids import id_bits, with_bit

GRAM = 24
SEGMENT = 1 << 19
#: anchors a task holds before it settles and ships them
FLUSH = 400_000
SHALLOW = 48
HOT = 200_000

_M = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
ANCHOR = np.dtype([("key", "<u8"), ("context", "<u8"), ("rid", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1")])
MARK = np.dtype([("rid", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    n = len(data) - GRAM + 1
    h = words[:n] * _M[0]
    for k in (8, 16):
        h ^= h >> np.uint64(31)
        h = (h + words[k : k + n]) * _M[k // 8]
    return h ^ (h >> np.uint64(29))


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbouring values, in two running minima per block."""
    n = len(v) - width + 1
    pad = np.full(-len(v) % width, np.iinfo(v.dtype).max, v.dtype)
    blocks = np.concatenate([v, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, ascending, and the hashes of their strings."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    at, keys = [], []
    for start in range(0, n - length + 1, SEGMENT):
        part = data[start : min(n, start + SEGMENT + length - 1)]
        h = _grams(part)
        # the place in the low bits makes values differ and the leftmost of equal strings win
        v = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        least = _window_min(v, length - GRAM + 1)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        places = np.unique((least[new] & np.uint64((1 << 20) - 1)).astype(np.int64))
        at.append(places + start)
        keys.append(h[places])
    places, first = np.unique(np.concatenate(at), return_index=True)
    return places, np.concatenate(keys)[first]


def _records(rid: int, text: bytes, length: int) -> np.ndarray:
    at, keys = anchors(text, length)
    out = np.empty(len(at), ANCHOR)
    left, right = np.minimum(at, length - GRAM), np.minimum(len(text) - at, length)
    digest = xxhash.xxh3_64_intdigest
    spans = zip((at - left).tolist(), (at + right).tolist(), (left * 256 + right).tolist())
    out["key"], out["rid"], out["pos"], out["left"], out["right"] = keys, rid, at, left, right
    out["context"] = np.fromiter((digest(text[a:b], s) for a, b, s in spans), np.uint64, len(at))
    return out


def _settle(records: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks of all but the first of equal contexts, the firsts)."""
    records = records[np.lexsort((records["pos"], records["rid"], records["context"]))]
    again = np.r_[False, records["context"][1:] == records["context"][:-1]]
    gone = records[again]
    marks = np.empty(len(gone), MARK)
    marks["rid"], marks["lo"] = gone["rid"], gone["pos"] - gone["left"].astype(np.int32)
    marks["hi"] = gone["pos"] - (length - gone["right"].astype(np.int32))
    return marks, records[~again]


def joined_marks(marks: np.ndarray) -> np.ndarray:
    """Touching ranges of window starts of a document made one."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort((marks["lo"], marks["rid"]))]
    other = np.r_[True, marks["rid"][1:] != marks["rid"][:-1]]
    # running maximum of the ends within a document: documents are lifted apart before
    lift = np.cumsum(other).astype(np.int64) << 33
    end = np.maximum.accumulate(marks["hi"] + lift)
    new = other | np.r_[True, marks["lo"][1:] + lift[1:] > end[:-1] + 1]
    starts = np.flatnonzero(new)
    out = marks[starts].copy()
    out["hi"] = (end - lift)[np.r_[starts[1:], len(marks)] - 1]
    return out


def _collect_anchors(length: int, parts: int):
    """Blocks of first contexts, dealt by anchor (part 0 to parts-1), and of marks (parts and over)."""

    def ship(held):
        marks, firsts = _settle(np.concatenate(held), length)
        part = (firsts["key"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        firsts, part = firsts[order], part[order]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        rows = [(int(part[a]), firsts[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(part)])]
        marks = joined_marks(marks)
        rows += [(parts + k % parts, marks[a : a + 50_000].tobytes()) for k, a in enumerate(range(0, len(marks), 50_000))]
        for at in range(0, len(rows), 64):
            p, b = zip(*rows[at : at + 64])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(b, pa.binary())], names=["part", "block"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for rids, texts in slices(batch, "rid", "body"):
                for rid, text in zip(rids, texts):
                    held.append(_records(rid, text, length))
                    n += len(held[-1])
                if n >= FLUSH:
                    yield from ship(held)
                    held, n = [], 0
        if n:
            yield from ship(held)

    return run


_FOUND = "rid long, lo int, hi int, key long, hot boolean"


def _classes(length: int, parts: int, hot: int):
    """Per part: marks (key NULL), and the first contexts of anchors that have several (lo is their place)."""

    def run(key, table):
        blocks = table.column("block").to_pylist()
        if key[0].as_py() >= parts:
            marks, asked = np.concatenate([np.frombuffer(b, MARK) for b in blocks]), np.zeros(0, ANCHOR)
        else:
            marks, firsts = _settle(np.concatenate([np.frombuffer(b, ANCHOR) for b in blocks]), length)
            marks = joined_marks(marks)
            _, inverse, counts = np.unique(firsts["key"], return_inverse=True, return_counts=True)
            asked = firsts[counts[inverse] > 1]
            size = counts[inverse][counts[inverse] > 1]
        n, m = len(marks), len(asked)
        keys = pa.array(asked["key"].view(np.int64) if m else [], pa.int64())
        return pa.table(
            {
                "rid": pa.array(np.r_[marks["rid"], asked["rid"]], pa.int64()),
                "lo": pa.array(np.r_[marks["lo"], asked["pos"]], pa.int32()),
                "hi": pa.array(np.r_[marks["hi"], np.zeros(m, np.int32)], pa.int32()),
                "key": pa.concat_arrays([pa.nulls(n, pa.int64()), keys]),
                "hot": pa.array(np.r_[np.zeros(n, bool), size > hot] if m else np.zeros(n, bool), pa.bool_()),
            }
        )

    return run


# --- deep-shallow sorting ---------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their strings (of equal length), by a blind trie.

    A node is ``[depth, {byte: child}, a leaf below]``; a leaf is a list of equal members.  A string goes down by
    the branching bytes alone, is compared once with a leaf found there, and enters where they part.
    """
    root = None
    for m in members:
        s = strings[m]
        if root is None:
            root = ("leaf", [m])
            continue
        node = root
        while node[0] == "node":
            node = node[2].get(s[node[1]]) or next(iter(node[2].values()))
        other = strings[node[1][0]]
        depth = _common(s, other)
        if depth == len(s):
            node[1].append(m)
            continue
        parent, byte, node = None, None, root
        while node[0] == "node" and node[1] < depth:
            parent, byte, node = node, s[node[1]], node[2][s[node[1]]]
        if node[0] == "node" and node[1] == depth:
            node[2][s[depth]] = ("leaf", [m])
            continue
        fork = ("node", depth, {s[depth]: ("leaf", [m]), other[depth]: node})
        if parent is None:
            root = fork
        else:
            parent[2][byte] = fork
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            out.extend(node[1])
        else:
            stack.extend(node[2][b] for b in sorted(node[2], reverse=True))
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """Indexes of ``strings`` (of equal length) in sorted order.

    Multikey quicksort takes eight bytes for a character, splits in three around a pivot and goes on to the
    next character in the middle; at ``shallow`` bytes groups are handed to blind tries.
    """
    size = len(strings[0]) if strings else 0
    depth_words = min(shallow, size) // 8
    flat = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), size)
    words = np.ascontiguousarray(flat[:, : 8 * depth_words]).view(">u8").astype(np.uint64)
    out, stack = [], [(np.arange(len(strings)), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out.extend(group.tolist())
        elif depth >= depth_words:
            out.extend(blind_trie_order(strings, group.tolist()))
        else:
            c = words[group, depth]
            pivot = c[len(c) // 2] if len(c) < 8 else np.sort(c[:: max(1, len(c) // 7)])[3]
            low, same, high = group[c < pivot], group[c == pivot], group[c > pivot]
            stack += [(high, depth), (same, depth + 1), (low, depth)]
    return np.array(out, np.int64)


def _prefix_ranks(strings: list[bytes]):
    """A function from a length to group numbers: equal numbers for equal prefixes of that length."""
    order = deep_shallow_order(strings)
    m, size = len(strings), len(strings[0])
    flat = np.frombuffer(b"".join(strings), np.uint8).reshape(m, size)[order]
    common = np.full(m, -1, np.int64)
    for at in range(1, m, 65_536):
        a, b = flat[at - 1 : min(m, at + 65_536) - 1], flat[at : min(m, at + 65_536)]
        differ = a != b
        common[at : at + len(b)] = np.where(differ.any(1), differ.argmax(1), size)

    def ranks(length: int) -> np.ndarray:
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(common < length)
        return out

    return ranks


def repeated_windows(rid, pos, before: list[bytes], after: list[bytes], length: int) -> np.ndarray:
    """Marks of the windows around these anchors that an anchor of an earlier place has too.

    ``before`` are the bytes ahead of the anchor, reversed, ``after`` those from it on.
    """
    order = np.lexsort((pos, rid))
    rid, pos = np.asarray(rid, np.int64)[order], np.asarray(pos, np.int64)[order]
    before, after = [before[i] for i in order], [after[i] for i in order]
    left, right = np.array(list(map(len, before))), np.array(list(map(len, after)))
    forward = _prefix_ranks([s.ljust(length, b"\0") for s in after])
    backward = _prefix_ranks([s.ljust(length - GRAM, b"\0") for s in before])
    m, marks = len(rid), []
    for d in range(length - GRAM + 1):
        ok = np.flatnonzero((left >= d) & (right >= length - d))
        if len(ok) < 2:
            continue
        both = forward(length - d)[ok] * (m + 1) + backward(d)[ok]
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(ok), bool)
        again[first] = False
        hit = np.empty(int(again.sum()), MARK)
        hit["rid"], hit["lo"] = rid[ok][again], pos[ok][again] - d
        hit["hi"] = hit["lo"]
        marks.append(hit)
    return joined_marks(np.concatenate(marks)) if marks else np.zeros(0, MARK)


_CONTEXT = "part int, key long, rid long, pos int, before binary, after binary, h1 long, h2 long"


def _contexts(length: int, parts: int):
    """The contexts asked for; of hot anchors each window as a row of its own (``part`` NULL)."""
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _CONTEXT.split(", ")]

    def run(batches):
        for batch in batches:
            for rids, texts, asked in slices(batch, "rid", "body", "asked"):
                rows = []
                for rid, text, wanted in zip(rids, texts, asked):
                    for a in wanted:
                        p, key = a["lo"], a["key"]
                        if not a["hot"]:
                            before = text[max(0, p - length + GRAM) : p][::-1]
                            rows.append((key % parts, key, rid, p, before, text[p : p + length], None, None))
                            continue
                        for s in range(max(0, p - length + GRAM), min(p, len(text) - length) + 1):
                            d = xxhash.xxh3_128_digest(text[s : s + length])
                            h1, h2 = (int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:]))
                            rows.append((None, key, rid, s, None, None, h1, h2))
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _sorted_part(length: int):
    def run(table):
        marks = repeated_windows(
            table.column("rid").to_numpy(), table.column("pos").to_numpy(),
            table.column("before").to_pylist(), table.column("after").to_pylist(), length,
        )
        return pa.table({n: pa.array(marks[n].copy()) for n in ("rid", "lo", "hi")})

    return run


# --- cutting ----------------------------------------------------------------------


def cut(text: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[list[bytes], int, int]:
    """(kept pieces, bytes removed, removed runs) for ranges of first bytes of removed windows."""
    kept, at, removed, runs = [], 0, 0, 0
    for lo, hi in sorted(ranges):
        end = min(len(text), hi + length)
        if runs and lo <= at:  # goes on with the run before
            removed += max(0, end - at)
            at = max(at, end)
            continue
        kept.append(text[at:lo])
        removed += end - lo
        at, runs = end, runs + 1
    kept.append(text[at:])
    return kept, removed, runs


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_all(length: int, with_text: bool):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches):
        for batch in batches:
            for ids, texts, marks in slices(batch, "doc_id", "body", "marks"):
                rows = []
                for doc, text, ranges in zip(ids, texts, marks):
                    kept, removed, runs = cut(text, [(r["lo"], r["hi"]) for r in ranges or ()], length)
                    body = b"".join(kept)
                    rows.append((doc, len(text), removed, runs, hashlib.sha256(body).hexdigest(), body if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, body``; rids order the documents and tell them apart.

    The rid is the ``doc_id`` itself where ids are unique.  Otherwise documents are rows of different id or
    text, ordered by id (NULL first) and a hash of the text; rows alike in both are one document.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    ids = body.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null")
    if ids.isEmpty():
        return body.select(F.col("doc_id").alias("rid"), "doc_id", "body")
    body = body.withColumn("h", F.xxhash64("body"))
    order = [F.asc_nulls_first("doc_id"), "h"]
    ranged = body.select("doc_id", "h").distinct().repartitionByRange(shuffle_width(docs.sparkSession), *order)
    # after a range partition sorted inside, growing ids follow the order
    rids = stored(ranged.sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()), "passage-ids")
    other = rids.select("rid", F.col("doc_id").alias("d"), F.col("h").alias("g"))
    return body.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("rid", "doc_id", "body")


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left).

    Texts are UTF-8 bytes, NULL as empty.  A byte is removed if a string of ``length`` bytes that covers it
    also starts earlier; strings never cross documents and are judged on the input.  ``n_spans`` counts
    maximal removed runs.  Repeated ids: see ``numbered``; every row gives one row.
    """
    if length < GRAM + 8 or length > 255:
        raise ValueError(f"length must be between {GRAM + 8} and 255")
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    body = numbered(docs)
    blocks = body.mapInArrow(_collect_anchors(length, parts), "part int, block binary")
    found = stored(blocks.groupBy("part").applyInArrow(_classes(length, parts, hot), _FOUND), "passage-contexts")

    asked = found.where("key is not null")
    per_doc = asked.groupBy("rid").agg(F.collect_list(F.struct("lo", "key", "hot")).alias("asked"))
    texts = with_bit(body, "rid", id_bits(asked.select("rid")))
    contexts = stored(texts.select("rid", "body").join(per_doc, "rid").mapInArrow(_contexts(length, parts), _CONTEXT), "passage-suffixes")
    sorted_ = contexts.where("part is not null").groupBy("part").applyInArrow(_sorted_part(length), "rid long, lo int, hi int")
    windows = contexts.where("part is null").select("rid", "pos", "h1", "h2")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("rid", "pos")).alias("f"))
    later = windows.join(first, ["h1", "h2"]).where("f.rid <> rid or f.pos <> pos")
    later = later.select("rid", F.col("pos").alias("lo"), F.col("pos").alias("hi"))

    marks = stored(found.where("key is null").select("rid", "lo", "hi").unionByName(sorted_).unionByName(later), "passage-marks")
    per_doc = marks.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    bits = id_bits(marks.select("rid"))
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    plain = with_bit(body, "rid", bits, False).select("doc_id", "body", none.alias("marks"))
    hit = with_bit(body, "rid", bits).join(per_doc, "rid", "left").select("doc_id", "body", "marks")
    out = plain.unionByName(hit).mapInArrow(_cut_all(length, with_text), _OUT)
    return out if with_text else out.drop("kept")
