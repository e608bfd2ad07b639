"""Token counts and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from seawake.llm import token_counts, token_files
from seawake.llm.common import load_tokenizer, scratch_folder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path, text):
    return load_tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def strange():
    """Random strings of everything a pre-tokenizer may stumble on."""
    r = random.Random(3)
    bits = ["a", "B", "é", " ", " ", "\n", ".", ",", "!", "'s", "'", "  ", "1", "23", "…", " ", " ", "<|endoftext|>",
            "—", "ß", "\t", "$", "word", "end.", "x,", "　", "😀", "́", "\x1c", "\x85", "İ", "Σ", "﻿"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(6000)]


def test_words_are_independent(strange):
    assert token_counts.word_counts(WORD, [t.encode() for t in strange]) == [len(library(WORD, t)) for t in strange]


def test_pieces_are_independent(strange):
    got = token_files.PieceIds(BYTE).encode([t.encode() for t in strange])
    assert [g.tolist() for g in got] == [library(BYTE, t) for t in strange]


def test_memos_start_afresh(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 2)
    monkeypatch.setattr(token_files, "MEMO_PIECES", 2)
    texts = ["one two three four", "two five.", "one six seven"]
    pieces = token_files.PieceIds(BYTE)
    for t in texts:
        assert token_counts.word_counts(WORD, [t.encode()]) == [len(library(WORD, t))]
        assert pieces.encode([t.encode()])[0].tolist() == library(BYTE, t)


@pytest.mark.parametrize("overlap", [4, 64, 512])
def test_count_tokens(docs, overlap):
    """Chunks of 1000 characters: short overlaps fail and are widened, the unbroken text becomes one chunk."""
    got = token_counts.count_tokens(docs, WORD, limit=300, huge_chars=1500, chunk_chars=1000, overlap=overlap).collect()
    want = {}
    for r in docs.collect():
        n = len(library(WORD, r.text))
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 300)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want
    assert len(got) == len(want)


def test_count_tokens_repeated_and_empty(repeated, none):
    got = token_counts.count_tokens(repeated, WORD, huge_chars=1500, chunk_chars=1000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(r.doc_id, len((r.text or "").encode()), len(library(WORD, r.text))) for r in repeated.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(none, WORD).count() == 0


def test_splice_point_is_seen_alike():
    text = "aa bb cc dd ee ff gg hh"
    whole = token_counts.splice_point(text, 0, 10, 6)
    assert whole == token_counts.splice_point(text[4:], 4, 10, 6)
    assert token_counts.splice_point("aaaaaaaaaaaaaaa", 0, 7, 5) is None


def written(spark, docs, length=16, file_tokens=300):
    folder = scratch_folder(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, BYTE, folder, 2, sequence_length=length, file_tokens=file_tokens)
    return folder, manifest


def test_round_trip(spark, docs):
    folder, manifest = written(spark, docs)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest, folder).collect()}
    at, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library(BYTE, r.text), 2]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert manifest.count() > 1


def test_random_access(spark, docs):
    folder, manifest = written(spark, docs, length=16, file_tokens=1 << 20)
    order = [r.text for r in docs.orderBy("doc_id").collect()]
    flat, seen = [i for t in order for i in [*library(BYTE, t), 2]], 0
    for f in manifest.orderBy("base").collect():
        reader = token_files.open_sequences(folder, f.file)
        for i in range(-(-f.tokens // 16)):
            ids, mask = token_files.sequence_at(reader, i)
            n = min(16, f.tokens - 16 * i)
            assert len(ids) == len(mask) == 16 and mask.tolist() == [True] * n + [False] * (16 - n)
            assert ids[:n].tolist() == flat[seen + 16 * i : seen + 16 * i + n]
            assert not ids.flags.owndata  # a view on the mapped file
        seen += f.tokens


def test_files_of_repeated_rows_and_none(spark, repeated, none):
    folder, manifest = written(spark, repeated)
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    assert len(got) == repeated.count()
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    folder, manifest = written(spark, none)
    assert token_files.read_token_files(manifest, folder).count() == 0


@pytest.mark.parametrize("copies", [1, 2, 4])
def test_failed_borders_of_copies_are_seen(spark, tmp_path, monkeypatch, copies):
    """Words are paired from the start of a run, so a chunk that begins inside one pairs them otherwise: encoded again."""
    import json

    vocab, merges = {" ": 0, "a": 1, "b": 2}, []
    for pair in (" ", "a"), (" ", "b"), (" a", " a"), (" b", " b"):
        vocab["".join(pair)] = len(vocab)
        merges.append(list(pair))
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": merges}}))
    rounds, stored = [], token_counts.stored
    monkeypatch.setattr(token_counts, "stored", lambda *a: (rounds.append(1), stored(*a))[1])
    text = (" a" * 500 + " b" * 500) * 3
    docs = spark.createDataFrame([(5, text)] * copies, "doc_id long, text string")
    got = token_counts.count_tokens(docs, str(path), huge_chars=1500, chunk_chars=1000, overlap=66).collect()
    assert [r.n_tokens for r in got] == [len(library(str(path), text))] * copies == [1500] * copies
    assert len(rounds) == 2


def test_pieces_are_learned_together_and_known_ones_kept(monkeypatch):
    """New pieces go to the library many in a text; those met again survive when the memo is full."""
    monkeypatch.setattr(token_files, "MEMO_PIECES", 60)
    pieces = token_files.PieceIds(BYTE)
    learned, texts, encode = [], [], pieces._encoded
    monkeypatch.setattr(pieces, "_encoded", lambda t: texts.extend(t) or encode(t))
    together = pieces._together
    monkeypatch.setattr(pieces, "_together", lambda p: learned.extend(p) or together(p))
    for i in range(10):
        text = "again and again\nand again " + " ".join(f"new{chr(97 + i)}{chr(97 + k)}" for k in range(20))
        assert pieces.encode([text.encode()])[0].tolist() == library(BYTE, text)
    assert learned.count(b" again") == 1 and learned.count(b"\n") == 0 and len(learned) == 204
    assert len(texts) == 10
