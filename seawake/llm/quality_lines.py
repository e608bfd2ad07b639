"""Line quality by a linear-chain conditional random field.

Each line of a text is described by a few discrete features (length, symbols, capitals, repeats, how it
ends ...).  A linear-chain CRF over two states, content and boilerplate, scores them together
with the states of neighbouring lines; Viterbi decoding marks the best sequence.  The share of
words on content lines decides whether the text is kept.

The field is trained on a bounded sample of documents with a ``quality`` label.  Their lines get
weak labels: a line of a rejected document that shows a defect (symbols, capitals, repetition, tables
...) is boilerplate, a line of an accepted document is content; other lines have no label and are
summed over.  Training maximises the likelihood by gradient ascent with the forward-backward
recursion, in numpy.

Before the field decides, plain counts reject texts that are too short or repeat themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import slices, utf8

CONTENT, BOILERPLATE = 0, 1
#: bounds of the labelled sample: rows of each class, lines and bytes of a text
ROWS, LINES, BYTES = 600, 200, 65_536
#: least share of words on content lines
CONTENT_SHARE = 0.5

_symbols = b"#*$%&|<>"
_continuation = bytes(range(0x80, 0xC0))
_upper = re.compile(rb"[A-Z]")
_letter = re.compile(rb"[A-Za-z\x80-\xff]")


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in ``width``-word windows that occur twice or more, the first occurrence included.

    Windows are ranked exactly by doubling: equal pairs of equal halves get equal ranks.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    step, kinds = 1, len(ids)
    while step < width and kinds < len(rank):
        pair = rank[: len(rank) - step] * kinds + rank[step:]
        different, rank = np.unique(pair, return_inverse=True)
        step, kinds = 2 * step, len(different)
    if step < width:  # all windows of this length differ already
        return 0
    counts = np.bincount(rank)
    hits = np.flatnonzero(counts[rank] > 1)
    if not len(hits):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.split()
    chars = sum(map(len, words)) - len(text) + len(text.translate(None, _continuation)) if words else 0
    symbols = len(text) - len(text.translate(None, _symbols))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


NAMES = ("short", "long", "symbols", "few symbols", "capitals", "unique words", "repeats", "stop", "bang", "bar", "digits",
         "seen", "letters", "lower start", "long words", "first", "last")


def line_features(lines: list[bytes]) -> np.ndarray:
    """Binary features, one row per line; the last column is always 1."""
    out = np.zeros((len(lines), len(NAMES) + 1))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words, n = line.split(), max(1, len(line))
        k = max(1, len(words))
        symbols = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
        letters, upper = len(_letter.findall(line)), len(_upper.findall(line))
        distinct = len(set(words))
        tail = line.rstrip()[-1:]
        out[i] = (
            k < 5, k > 40, symbols > 0.3 * k, 0 < symbols <= 0.3 * k, upper > 0.5 * letters, distinct == k, distinct < 0.5 * k,
            tail in b".?" and bool(tail), line.count(b"!") > 0.3 * k, b" | " in line, sum(line.count(d) for d in _digits) > 0.2 * n,
            line in seen, letters < 0.5 * n, line[:1].islower(), len(line) > 14 * k, i == 0, i == len(lines) - 1, 1,
        )
        seen.add(line)
    return out


_digits = [bytes([c]) for c in range(48, 58)]


@dataclass
class Field:
    """Weights of a linear-chain CRF with two states: features by state, and transitions."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; of equally likely ones the content state."""
        score = x @ self.emit.T
        back = np.zeros((len(x), 2), np.int8)
        best = score[0]
        for t in range(1, len(x)):
            ways = best[:, None] + self.move
            back[t] = ways.argmax(0)
            best = ways.max(0) + score[t]
        states = np.zeros(len(x), np.int8)
        states[-1] = best.argmax()
        for t in range(len(x) - 1, 0, -1):
            states[t - 1] = back[t][states[t]]
        return states

    def expected(self, x: np.ndarray, allowed: np.ndarray | None = None):
        """Log partition, expected features by state, and expected transitions; ``allowed`` masks states per line."""
        score = x @ self.emit.T
        if allowed is not None:
            score = np.where(allowed, score, -1e9)
        n = len(x)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = score[0]
        for t in range(1, n):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + self.move, axis=0) + score[t]
        for t in range(n - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(self.move + (score[t + 1] + behind[t + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        states = np.exp(ahead + behind - total)
        moves = np.zeros((2, 2))
        if n > 1:
            pair = ahead[:-1, :, None] + self.move + (score[1:] + behind[1:])[:, None, :] - total
            moves = np.exp(pair).sum(0)
        return total, states.T @ x, moves


def weak_labels(x: np.ndarray, good: int) -> np.ndarray:
    """Which states each line may have: (content, boilerplate)."""
    at = {n: i for i, n in enumerate(NAMES)}
    defect = x[:, [at[n] for n in ("symbols", "capitals", "repeats", "bang", "bar", "digits", "seen", "letters")]].any(1)
    if good:
        return np.column_stack([np.ones(len(x), bool), defect & (x[:, at["seen"]] > 0)])
    return np.column_stack([~defect, np.ones(len(x), bool)])


def fit(samples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, ridge: float = 1e-2) -> Field:
    """Gradient ascent (Adagrad steps) on the likelihood of the allowed state sequences."""
    field = Field(np.zeros((2, len(NAMES) + 1)), np.zeros((2, 2)))
    past = [np.full_like(field.emit, 1e-6), np.full_like(field.move, 1e-6)]
    for _ in range(rounds if samples else 0):
        grad = [-ridge * len(samples) * field.emit, -ridge * len(samples) * field.move]
        for x, allowed in samples:
            _, e0, m0 = field.expected(x)
            _, e1, m1 = field.expected(x, allowed)
            grad[0] += e1 - e0
            grad[1] += m1 - m0
        for w, g, p in zip((field.emit, field.move), grad, past):
            p += g * g
            w += 0.5 * g / np.sqrt(p)
    return field


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Field:
    """Fit on a bounded sample: at most ``rows`` documents of each quality, in the order of a hash of the id.

    Texts of more than ``LINES`` lines or ``BYTES`` bytes are left out of the sample, never of the decisions.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = [marks.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    body = body.where(F.octet_length("body") <= BYTES)
    got = body.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("body", "quality").collect()
    samples = []
    for text, good in sorted({(bytes(r["body"]), r["quality"]) for r in got}):
        lines = [line for line in text.split(b"\n") if line.strip()]
        if 0 < len(lines) <= LINES:
            x = line_features(lines)
            samples.append((x, weak_labels(x, good)))
    return fit(samples)


def content_share(field: Field, text: bytes) -> float:
    """Share of the words that lie on content lines; 0 without words."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    if not lines:
        return 0.0
    sizes = np.array([len(line.split()) for line in lines])
    return float(sizes[field.viterbi(line_features(lines)) == CONTENT].sum() / sizes.sum())


def _decide(field: Field, least_share: float):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]
    )

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch, "doc_id", "body"):
                rows = []
                for doc, text in zip(ids, texts):
                    counts = base_counts(text)
                    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                    share = content_share(field, text)
                    rows.append((doc, *counts, failed, not failed and share >= least_share, share))
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def line_quality(docs: DataFrame, field: Field, least_share: float = CONTENT_SHARE) -> DataFrame:
    """Per document the base counts, ``base_failed``, ``kept`` and ``content_share``.

    Words lie between ASCII white space, lines between line breaks.  A text fails the base with under 20
    words, or when over 30 % of them lie in eight-word windows the text repeats.  It is kept if it does
    not fail and at least ``least_share`` of its words are on content lines.  NULL and empty texts have
    no words and fail.  Every row, repeated or without id, gives one row.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return body.mapInArrow(_decide(field, least_share), f"{schema}, base_failed boolean, kept boolean, content_share double")
