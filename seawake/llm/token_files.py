"""Token ids as Arrow files of equal-length sequences.

One file is an Arrow IPC file whose record batches hold three fixed-size-list columns:

* ``ids``: ``sequence_length`` token ids (unsigned, as narrow as the vocabulary allows);
* ``mask``: true for a real id, false for the padding behind the last one;
* ``ends``: true where a document ends.

All lists have the same length, so sequence *i* lies at a computable place: a memory map gives it
as a numpy view without a copy and without reading what is before it (``sequence_at``).
Beside each file a small one lists its documents in order (``doc_id``, ``n_tokens``).

Documents are range-partitioned by ``doc_id``; each task appends its documents to its own files,
rolling to a new one after ``file_tokens``.  Padding occurs only at the end of a file.  Files are
written under a temporary name and renamed, so a repeated task replaces its files by equal ones.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.llm.common import load_tokenizer, shuffle_width, slices, stored, utf8

#: distinct pieces a Python worker remembers before it forgets those it met once; bounds its memory
MEMO_PIECES = 500_000
#: new pieces that are encoded in one text
JOINED = 64

# A text with any of these is encoded whole: white space next to white space, at the ends or outside
# ASCII, the separator byte used below, and anything that looks like a special token.
_pairs = (b"  ", b" \n", b"\n ", b"\n\n", b"<|", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_control = b"\x00\x09\x0b\x0c\x0d\x1c\x1d\x1e\x1f"
_wide = re.compile(rb"\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]")

# a full stop or comma behind an ASCII letter, at the end of a piece
_stop = re.compile(rb"([A-Za-z])([.,])\0")
_kinds = bytes(
    97 if chr(c).isalpha() and c < 128 else 46 if c in b".," else 32 if c in b" \n" else 120 for c in range(256)
)


def odd(text: bytes) -> bool:
    if text[:1] in b" \n" or text[-1:] in b" \n" or len(text.translate(None, _control)) < len(text):
        return True
    return any(p in text for p in _pairs) or (b"\xe2" in text and _wide.search(text) is not None)


def pieces_of(text: bytes) -> list[bytes]:
    """The pieces of a text that is not ``odd``; joined they are the text."""
    marked = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")
    kinds = text.translate(_kinds)
    if b"x. " in kinds or b".. " in kinds or b" . " in kinds:  # some full stop may belong to a run of symbols: look at each
        return _stop.sub(rb"\1\0\2\0", marked).split(b"\0")
    return marked.replace(b".\0", b"\0.\0").replace(b",\0", b"\0,\0").split(b"\0")


class _Index(dict):
    """Numbers of pieces in the order they are met; those not yet encoded are in ``fresh``."""

    def __init__(self, pieces=()):
        super().__init__(zip(pieces, range(len(pieces))))
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.fresh.append(piece)
        i = self[piece] = len(self)
        return i


class PieceIds:
    """Ids of pieces a byte-level BPE tokenizer encodes independently, remembered per worker.

    Its pre-tokenizer cuts before a single space that has no white space beside it (the space
    opens the next piece) and on both sides of a single line break, and merges never cross a
    cut.  It also cuts between a letter and the full stop or comma that ends a piece.  So each
    distinct piece is encoded once and a text is put together from its pieces.  New pieces are encoded
    many at a time, with line breaks between, whose id occurs in no piece.
    """

    def __init__(self, path: str):
        self.tk = load_tokenizer(path)
        self.line = np.array(self.tk.encode("\n", add_special_tokens=False).ids, np.uint32)
        self._reset()

    def _reset(self):
        self.index = _Index([b"\n"])
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self._put(0, np.array([len(self.line)]), self.line)

    def _forget(self) -> None:
        """Keep the pieces met more than once since the last time, if they are half of what may be held at most."""
        known, keep = list(self.index), np.flatnonzero(self.uses[1 : len(self.index)] > 1) + 1
        starts, lengths, flat = self.starts, self.lengths, self.flat
        self._reset()
        if len(keep) <= MEMO_PIECES // 2:
            self.index = _Index([known[0], *(known[k] for k in keep)])
            self._put(1, lengths[keep], _gathered(flat, starts[keep], lengths[keep]))

    def _put(self, n: int, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the pieces from number ``n`` on."""
        end = n + len(lengths)
        self.starts, self.lengths, self.uses = (_grown(a, end) for a in (self.starts, self.lengths, self.uses))
        self.flat = _grown(self.flat, self.used + len(ids))
        self.starts[n:end] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:end] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        pieces, self.index.fresh = self.index.fresh, []
        n = len(self.index) - len(pieces)
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            self._put(n + at, *(self._together(part) or self._apart(part)))

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tk.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self._encoded(pieces)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return lengths, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Lengths and ids, or None if line breaks do not part the pieces."""
        got = self._encoded([b"\n".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])
        flat = np.concatenate([x for ids in got for x in (np.array(ids, np.uint32), self.line)])
        ends = np.flatnonzero(flat == self.line[0])
        if len(self.line) != 1 or len(ends) != len(pieces):
            return None
        return np.diff(ends, prepend=-1) - 1, flat[flat != self.line[0]]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > MEMO_PIECES:
            self._forget()
        split = [None if odd(t) else pieces_of(t) for t in texts]
        sizes = [0 if s is None else len(s) for s in split]
        pieces = chain.from_iterable(s for s in split if s is not None)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, sum(sizes))
        self._learn()
        uses = np.bincount(at)
        self.uses[: len(uses)] += uses
        lengths = self.lengths[at]
        flat = _gathered(self.flat, self.starts[at], lengths)
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(sizes)]].tolist()
        return [self._whole(t) if s is None else flat[a:b] for t, s, a, b in zip(texts, split, ends, ends[1:])]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tk.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` behind each other."""
    take = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[take + np.arange(len(take))]


def _grown(a: np.ndarray, need: int) -> np.ndarray:
    if need <= len(a):
        return a
    out = np.zeros(max(need, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


_pieces: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    if path not in _pieces:
        _pieces[path] = PieceIds(path)
    return _pieces[path]


def id_type(path: str) -> pa.DataType:
    """The narrowest unsigned type that holds every id of the tokenizer."""
    return pa.uint16() if load_tokenizer(path).get_vocab_size() <= 1 << 16 else pa.uint32()


class SequenceFile:
    """Writes one file of equal-length sequences and its list of documents."""

    BATCH = 512  # sequences per record batch

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.name, self.kind, self.length = name, kind, length
        self.temp = f"{self.base}/_{name}-{uuid.uuid4().hex}"
        wide = lambda t: pa.list_(t, length)
        self.schema = pa.schema([("ids", wide(kind)), ("mask", wide(pa.bool_())), ("ends", wide(pa.bool_()))])
        self.sink = self.fs.open_output_stream(f"{self.temp}.arrow")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.ends: list[int] = []
        self.held = self.total = 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= self.BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        ends = np.zeros(len(flat), bool)
        ends[self.ends] = True
        unit = self.BATCH * self.length  # every batch but the last has BATCH sequences
        full = len(flat) if last else len(flat) // unit * unit
        out, marks, real = flat[:full], ends[:full], np.ones(full, bool)
        if pad := -full % self.length:
            out, marks, real = (np.concatenate([a, np.zeros(pad, a.dtype)]) for a in (out, marks, real))
        dtype = self.kind.to_pandas_dtype()
        for at in range(0, len(out), unit):
            cut = slice(at, at + unit)
            columns = (pa.array(out[cut].astype(dtype)), pa.array(real[cut]), pa.array(marks[cut]))
            arrays = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.ids, self.held = [flat[full:]], len(flat) - full
        self.ends = [int(i) - full for i in np.flatnonzero(ends[full:]) + full]

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        table = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "n_tokens": pa.array(self.sizes, pa.int64())})
        with self.fs.open_output_stream(f"{self.temp}.docs") as sink, pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        for kind in ("docs", "arrow"):
            self.fs.move(f"{self.temp}.{kind}", f"{self.base}/{self.name}.{kind}")
        return self.name, len(self.docs), self.total


def _write(path: str, folder: str, end_id: int, length: int, file_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, no, out = TaskContext.get().partitionId(), 0, None
        coder, kind = piece_ids(path), id_type(path)
        end = np.array([end_id], np.uint32)
        closed = []
        for batch in batches:
            for docs, texts in slices(batch, "doc_id", "body"):
                for doc, ids in zip(docs, coder.encode(texts)):
                    if out is None:
                        out = SequenceFile(folder, f"part-{part:06d}-{no:04d}", kind, length)
                    out.add(doc, np.concatenate([ids, end]))
                    if out.total >= file_tokens:
                        closed.append((part, no, *out.close()))
                        out, no = None, no + 1
        if out is not None:
            closed.append((part, no, *out.close()))
        if closed:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*closed), schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int,
    sequence_length: int = 2048,
    file_tokens: int = 1 << 24,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending ``doc_id`` order.

    Returns the manifest, stored: one row per file (``part, no, file, docs, tokens, base``), where
    ``base`` counts the ids in all files before.  NULL ids sort first, equal ids by the hash of
    their text; NULL and empty texts give the end id alone.  ``folder`` is shared by all executors.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("body")]
    ranged = body.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    written = ranged.mapInArrow(
        _write(tokenizer, folder, end_id, sequence_length, file_tokens),
        "part int, no int, file string, docs long, tokens long",
    )
    manifest = stored(written, "token-files")
    # ids before a part, then before a file of it: the second window sees one row per part only
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(W.orderBy("part")).alias("p"))
    inner = manifest.withColumn("t", F.col("tokens")).withColumn("q", before(W.partitionBy("part").orderBy("no")))
    return inner.join(parts, "part").withColumn("base", F.col("p") + F.col("q")).drop("t", "p", "q")


def open_sequences(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A file of sequences for random access; a local one is memory-mapped, so reads copy nothing."""
    fs, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}.arrow"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def sequence_at(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence ``i``; the ids are a view on the file."""
    batch, row = divmod(i, SequenceFile.BATCH)
    b = reader.get_batch(batch)
    n = b.schema.field("ids").type.list_size
    ids = b.column(0).flatten().to_numpy()[row * n : (row + 1) * n]
    return ids, b.column(1).flatten()[row * n : (row + 1) * n].to_numpy(zero_copy_only=False)


def _read(folder: str):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def one(name: str, base: int):
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{root}/{name}.docs") as f:
            listed = pa.ipc.open_file(f).read_all()
        docs, sizes = listed.column(0).to_pylist(), listed.column(1).to_numpy()
        reader = open_sequences(folder, name)
        left, crc, seen, rows, k = 0, 0, 0, [], 0
        for b in range(reader.num_record_batches):
            batch = reader.get_batch(b)
            real = int(batch.column(1).flatten().true_count)
            ids = batch.column(0).flatten().to_numpy()[:real].astype("<u4")
            ends = np.flatnonzero(batch.column(2).flatten().to_numpy(zero_copy_only=False)[:real])
            at = 0
            for end in ends + 1:
                crc = zlib.crc32(ids[at:end], crc)
                size = left + int(end) - at
                if size != sizes[k]:
                    raise ValueError(f"{name}: document {docs[k]} has {size} ids, its list says {sizes[k]}")
                rows.append((docs[k], base + seen, size, crc))
                seen, at, left, crc, k = seen + size, int(end), 0, 0, k + 1
            crc, left = zlib.crc32(ids[at:], crc), left + real - at
        if left or k != len(docs):
            raise ValueError(f"{name}: {k} of {len(docs)} documents read, {left} ids left over")
        return rows

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = one(name, base)
                for at in range(0, len(rows), 10_000):
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), schema)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before; the checksum is over the ids as little-endian
    unsigned 32-bit integers.
    """
    files = manifest.select("file", "base").repartition(shuffle_width(manifest.sparkSession), "file")
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_card(folder: str, tokenizer: str, end_id: int, sequence_length: int) -> None:
    """A small description beside the files."""
    fs, base = pafs.FileSystem.from_uri(folder)
    card = {"tokenizer": tokenizer.rsplit("/", 1)[-1], "end_id": end_id, "sequence_length": sequence_length}
    with fs.open_output_stream(f"{base}/card.json") as f:
        f.write(json.dumps(card).encode())
