"""Toxicity by compression distance.

Two zstandard dictionaries are made, one trained on ordinary and one put together from toxic labelled text.  A text is
lower-cased, everything ASCII but letters becomes a space, and it is cut at words into windows of
about 48 bytes.  Every window is compressed twice: with the ordinary dictionary alone, and with the
toxic one behind it (what lies last is cheapest to refer to).  The bytes the toxic dictionary
saves are the window's distance; ordinary windows save none or a byte or two by chance.  How
many windows pass each of several thresholds, and by how much, gives the score; thresholds are
weighted by a logistic calibration on labelled rows that trained no dictionary.

The toxic training text is contrastive: words of toxic documents whose beginnings occur in
markedly more different surroundings there than in ordinary documents.  Counting surroundings
instead of occurrences keeps groups of copies from posing as evidence.  The toxic dictionary is these words as
they are, the most frequent last, up to ``TOXIC_DICT`` bytes: zstandard's own training on the same words repeats
some and loses others, and found fewer toxic documents (figures in the README).
"""

from __future__ import annotations

import collections
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import slices, small_batches, utf8

#: bytes after which a window is closed
WINDOW = 48
FOLDS = 5
#: bounds of the labelled sample the model is fitted on: rows of each class, and bytes of a text
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 2_500, 6_000, 65_536
#: bytes of the two dictionaries at most
ORDINARY_DICT, TOXIC_DICT = 110_000, 32_768
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)

_letters = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_word = re.compile(rb"[^\x00-\x60\x7b-\x7f]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows of whole words, the last two of each opening the next if they leave it room.

    A word over 64 bytes is cut into pieces.  A text without letters is one empty window.
    """
    words = text.translate(_letters).split()
    if not words:
        return [b""]
    if max(map(len, words)) > 64:
        words = [w[i : i + 64] for w in words for i in range(0, len(w), 64)]
    out, cur, n, fresh = [], [], 0, 0
    for w in words:
        cur.append(w)
        n += len(w) + 1
        fresh += 1
        if n >= WINDOW:
            out.append(b" " + b" ".join(cur) + b" ")
            cur, fresh = cur[-2:], 0
            n = sum(map(len, cur)) + len(cur)
            if n >= WINDOW:
                cur, n = [], 0
    if fresh or not out:
        out.append(b" " + b" ".join(cur) + b" ")
    return out


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:n] if n < len(word) else word + b" " for n in sorted({min(len(word), k) for k in (5, 6, 7, 8, 10)})]


def _surroundings(texts: list[bytes], only: dict | None = None) -> dict[bytes, int]:
    """For each beginning of a word (in ``only``) the number of different neighbour pairs it was seen between.

    Words are numbered and pairs hashed, so what the driver holds are a few arrays as long as the texts have words.
    """
    ids: dict[bytes, int] = {b"": 0}  # the empty word lies between texts
    rows = [np.array([ids.setdefault(w, len(ids)) for w in (*_word.findall(t), b"")], np.int32) for t in texts]
    flat = np.concatenate([np.zeros(1, np.int32), *rows])
    del rows
    place: dict[bytes, int] = {} if only is None else {b: i for i, b in enumerate(only)}
    begin = np.full((len(ids), 5), -1, np.int32)
    for word, i in ids.items():
        if len(word) >= 4:
            found = [place.setdefault(b, len(place)) if only is None else place.get(b, -1) for b in _beginnings(word)]
            begin[i, : len(found)] = found
    del ids
    word = flat[1:-1]
    pair = flat[:-2].astype(np.uint64) * _M1 + flat[2:].astype(np.uint64) * _M2
    pair = (pair ^ (pair >> np.uint64(32))) * _M1
    bits = np.uint64(max(1, len(place).bit_length()))
    counts = np.zeros(len(place), np.int64)
    for c in range(5):  # a beginning of so many letters is always in the same column
        own = begin[word, c]
        at = np.flatnonzero(own >= 0)
        seen = np.unique((own[at].astype(np.uint64) << (np.uint64(64) - bits)) | (pair[at] >> bits))
        counts += np.bincount((seen >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(place))
    return {b: n for b, n in zip(place, counts.tolist()) if n}


def toxic_dictionary(toxic: list[bytes], ordinary: list[bytes], odds: float = 6, least: int = 6, size: int = TOXIC_DICT) -> bytes:
    """The words that mark toxic text, the most telling ones last."""
    t = {b: n for b, n in _surroundings(toxic).items() if n >= least}
    o = _surroundings(ordinary, t)
    share = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    marks = {b for b, n in t.items() if n > odds * share * (o.get(b, 0) + 1)}
    counts = collections.Counter()
    for text in toxic:
        counts.update(w for w in _word.findall(text) if not marks.isdisjoint(_beginnings(w)))
    return b"".join(b" " + w + b" " for w, _ in reversed(counts.most_common()))[-size:]


def ordinary_dictionary(texts: list[bytes], size: int = ORDINARY_DICT) -> bytes:
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Both dictionaries and the calibration; small, so it travels with the tasks."""

    ordinary: bytes
    toxic: bytes
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def _compressor(self, content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pair"}

    def features(self, text: bytes) -> list[float]:
        if "pair" not in self.__dict__:
            self.__dict__["pair"] = (self._compressor(self.ordinary), self._compressor(self.ordinary + self.toxic))
        plain, marked = self.__dict__["pair"]
        d = np.array([len(plain(w)) - len(marked(w)) for w in windows(text)], float)
        d.sort()
        d, n = d[::-1], len(d)
        passed = [int((d >= t).sum()) for t in THRESHOLDS]
        gains = [d.sum(), np.clip(d, -1, 8).sum(), np.maximum(d - 1, 0).sum()]
        return [
            d[0], d[:2].mean(), d[:3].mean(), d[:5].mean(), d.mean(), np.log1p(n),
            *(g / np.sqrt(n) for g in gains), *np.log1p(passed), *(p / n for p in passed),
        ]

    def calibrate(self, texts: list[bytes], labels: list[int]) -> None:
        """Logistic weights of the features; classes are weighted back to ``prior``."""
        x, y = np.array([self.features(t) for t in texts]), np.array(labels, float)
        if not 0 < y.sum() < len(y):
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        case = np.where(y == 1, self.prior / y.mean(), (1 - self.prior) / (1 - y.mean()))
        w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = z.T @ (z * (case * p * (1 - p))[:, None]) + ridge
            step = np.linalg.solve(h, z.T @ (case * (y - p)) - w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.prior
        z = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30))))


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int) -> tuple[list, float]:
    """A bounded sample of the labelled rows outside fold 0, and the toxic share among all of them.

    Both classes are drawn in the order of a hash of their id.  The chosen ids are bounded by the
    two parameters, so they are broadcast; texts over ``SAMPLE_BYTES`` are left out of the sample.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    prior = marks.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    if prior is None:
        return [], 0.0
    drawn = [
        marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for k, n in ((1, toxic_rows), (0, ordinary_rows))
    ]
    chosen = drawn[0].unionByName(drawn[1])
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    body = body.where(F.octet_length("body") <= SAMPLE_BYTES)
    rows = body.join(F.broadcast(chosen), "doc_id").select("body", "toxic", fold().alias("fold")).collect()
    return [(bytes(r["body"]), r["toxic"], r["fold"]) for r in rows], prior


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows; fold 4 calibrates, folds 1 to 3 train the dictionaries."""
    rows, prior = labelled_sample(docs, labels, toxic_rows, ordinary_rows)
    rows = sorted(set(rows))
    teach = [(text.translate(_letters), y) for text, y, f in rows if f != FOLDS - 1]
    toxic, ordinary = ([t for t, y in teach if y == k] for k in (1, 0))
    model = Model(ordinary_dictionary(ordinary), toxic_dictionary(toxic, ordinary), prior)
    check = [(text, y) for text, y, f in rows if f == FOLDS - 1]
    if check:
        model.calibrate([t for t, _ in check], [y for _, y in check])
    return model


def _score(model: Model):
    def run(batches):
        for batch in batches:
            scores = [model.score(t) for (texts,) in slices(batch, "body") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns and ``score`` (0 to 1) of every whole text; a NULL text scores as an empty one.

    A ``score`` column of the input is replaced.  Without labels of both classes every text scores
    the share of toxic labels (0 without any).
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"]
    # the given columns travel in one, so that none can clash with the text beside them
    packed = docs.select(F.struct(*keep).alias("row"), utf8().alias("body"))
    schema = packed.select("row").schema.add("score", "double")
    return packed.mapInArrow(_score(model), schema).select("row.*", "score")


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document; a NULL id is in no fold, so not held out."""
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
