"""Token counts by overlap resynchronisation.

A document of up to ``huge_chars`` characters is counted whole.  A longer one is cut into
chunks that overlap.  Every chunk is encoded on its own, with offsets, on whichever executor
gets it; no task ever encodes more than one chunk of a document.  Neighbouring chunks are
spliced at a boundary that both can prove:

* it lies at an ASCII space or line break, which no token of the vocabulary crosses (the
  pre-tokenizer drops white space, so what is left of it cannot change what is right of it);
* both encodings have a token edge there;
* both give the same ids at the same offsets in the whole overlap, from its first to its last
  white space.

The two sides report a hash of that overlap, and one aggregate per document compares them, so
no neighbour has to see another's tokens.  Where a boundary fails - no white space in the
overlap, or differing hashes - the overlaps of the document are widened and it is encoded again,
in the end as one chunk.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import load_tokenizer, shuffle_width, slices, stored, utf8

#: distinct words a Python worker remembers before it starts afresh; bounds its memory
MEMO_WORDS = 600_000

_memos: dict[str, dict[bytes, int]] = {}


def word_counts(path: str, texts: list[bytes]) -> list[int]:
    """Tokens per text, for a tokenizer whose tokens never touch white space.

    Words between ASCII white space are encoded independently by such a tokenizer, so each
    distinct word is encoded once per worker and remembered.
    """
    tk = load_tokenizer(path)
    memo = _memos.setdefault(path, {})
    if len(memo) > MEMO_WORDS:
        memo.clear()
    split = [t.split() for t in texts]
    fresh = list(set().union(*split).difference(memo)) if split else []
    for at in range(0, len(fresh), 20_000):
        part = fresh[at : at + 20_000]
        encoded = tk.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
        memo.update(zip(part, map(len, encoded)))
    return [sum(map(memo.__getitem__, words)) for words in split]


def _count_short(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch, "doc_id", "body"):
                columns = [ids, [len(t) for t in texts], word_counts(path, texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


_PIECE = "doc_id long, h long, n_bytes long, chunk int, last boolean, start long, lo long, hi long, piece string"


def _cut(chunk_chars: int, overlap: int):
    """Rows of overlapping pieces; ``lo`` and ``hi`` are the nominal borders of the chunk."""

    def run(batches):
        for batch in batches:
            for ids, hashes, bodies in slices(batch, "doc_id", "h", "body"):
                rows = []
                for doc, h, body in zip(ids, hashes, bodies):
                    text = body.decode("utf-8", "replace")
                    n = max(1, -(-len(text) // chunk_chars))
                    for i in range(n):
                        lo, hi = i * chunk_chars, min(len(text), (i + 1) * chunk_chars)
                        start, last = max(0, lo - overlap), i == n - 1
                        end = len(text) if last else min(len(text), hi + overlap)
                        rows.append((doc, h, len(body), i, last, start, lo, hi, text[start:end]))
                        if len(rows) >= 64:
                            yield _pieces(rows)
                            rows = []
                if rows:
                    yield _pieces(rows)

    return run


def _pieces(rows):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in _PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_space = re.compile(r"[ \n]")


def splice_point(text: str, start: int, border: int, overlap: int) -> tuple[int, int, int] | None:
    """(first, chosen, last) white space of the overlap around ``border``; None if they do not differ enough.

    It depends only on the characters within ``overlap`` of the border, which both neighbours
    hold, so both choose the same.
    """
    zone = text[max(0, border - overlap - start) : border + overlap - start]
    at = max(start, border - overlap)
    spots = [m.start() + at for m in _space.finditer(zone)]
    if len(spots) < 3:
        return None
    inner = spots[1:-1]
    after = [s for s in inner if s >= border]
    return spots[0], (after[0] if after else inner[-1]), spots[-1]


def _encode_chunks(path: str, overlap: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("h", pa.int64()),
            ("n_bytes", pa.int64()),
            ("first", pa.int64()),
            ("n_tokens", pa.int64()),
            ("seal", pa.int64()),
            ("failed", pa.bool_()),
        ]
    )

    def seal(ids, starts, ends, spots, border) -> int | None:
        first, chosen, last = spots
        if np.any((starts < chosen) & (ends > chosen)):
            return None
        inside = (starts >= first) & (ends <= last)
        body = np.column_stack([ids[inside], starts[inside], ends[inside]]).astype("<i8").tobytes()
        return int.from_bytes(hashlib.blake2b(body + border.to_bytes(8, "little"), digest_size=7).digest(), "little")

    def one(tk, chunk, last, start, lo, hi, piece):
        e = tk.encode(piece, add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + start
        starts, ends = spans[:, 0], spans[:, 1]
        left, right, total = -1, 1 << 62, 0
        for border, is_left in ((lo, True), (hi, False)):
            if (is_left and chunk == 0) or (not is_left and last):
                continue
            spots = splice_point(piece, start, border, overlap)
            part = spots and seal(ids, starts, ends, spots, border)
            if part is None:
                return 0, 0, True
            total += part if is_left else -part  # the neighbour's has the other sign
            left, right = (spots[1], right) if is_left else (left, spots[1])
        return int(((starts >= left) & (starts < right)).sum()), total, False

    def run(batches):
        tk = load_tokenizer(path)
        names = [f.split()[0] for f in _PIECE.split(", ")]
        for batch in batches:
            for columns in slices(batch, *names):
                rows = []
                for doc, h, n_bytes, chunk, last, start, lo, hi, piece in zip(*columns):
                    rows.append((doc, h, n_bytes, int(chunk == 0), *one(tk, chunk, last, start, lo, hi, piece)))
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    huge_chars: int = 32_768,
    chunk_chars: int = 16_384,
    overlap: int = 512,
) -> DataFrame:
    """Tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit``).

    ``tokenizer`` is a file of the tokenizers library whose pre-tokenizer drops white space.
    NULL and empty texts have no tokens.  Every input row gives one row, repeated and NULL
    ``doc_id`` included; other columns are not looked at.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"), F.length("text").alias("_n"))
    huge = F.coalesce(F.col("_n") > huge_chars, F.lit(False))
    out = body.where(~huge).drop("_n").mapInArrow(_count_short(tokenizer), "doc_id long, n_bytes long, n_tokens long")

    rest = body.where(huge).select("doc_id", F.xxhash64("body").alias("h"), "body")
    key = ["doc_id", "h", "n_bytes"]
    width = overlap
    while True:
        whole = width >= chunk_chars
        cut = rest.mapInArrow(_cut(1 << 40 if whole else chunk_chars, width), _PIECE)
        encoded = cut.repartition(shuffle_width(spark), "doc_id", "h", "chunk").mapInArrow(
            _encode_chunks(tokenizer, width),
            "doc_id long, h long, n_bytes long, first long, n_tokens long, seal long, failed boolean",
        )
        # repeated rows meet in one group: the copies are counted and the sum shared out; seals that
        # differ add up to their difference times the copies, so no number of copies hides it
        tried = stored(
            encoded.groupBy(*key).agg(
                F.sum("first").alias("copies"),
                F.sum("n_tokens").alias("n_tokens"),
                F.sum(F.col("seal").cast("decimal(20,0)")).alias("seal"),
                F.max("failed").alias("failed"),
            ),
            "token-counts",
        )
        bad = F.col("failed") | (F.col("seal") != 0)
        done = tried.where(~bad).select(
            "doc_id", "n_bytes", F.expr("n_tokens div copies").alias("n_tokens"), F.col("copies").cast("int").alias("c")
        )
        out = out.unionByName(done.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("c")))).drop("c"))
        failed = tried.where(bad).select("doc_id", "h")
        if failed.isEmpty():
            break
        same = rest.doc_id.eqNullSafe(failed.doc_id) & (rest.h == failed.h)
        rest = rest.join(failed, same, "left_semi")
        width *= 16
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
