import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliometry.llm import packing, token_counts, training_order
from foliometry.llm.tokenizing import encoder, place
from foliometry.llm.words import blocks


def library(name):
    tokenizer = Tokenizer.from_file(place(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_blocks_equal_the_library(name, hard_texts):
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "\t", " ", "​", "\x1c", "a", "The", "é", "é", "İ", "ß", "漢", "'s", "12", ".", "!?", "<|endoftext|>"]
    texts = [*hard_texts, *("".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(800))]
    code, whole = encoder(name), library(name)
    for row, end, data, offsets in blocks(pa.array(texts), 20_000):
        ids, where = code.ids_block(data, offsets)
        counts = code.count_block(data, offsets)
        for k in range(row, end):
            expected = whole(texts[k])
            assert ids[where[k - row] : where[k - row + 1]].tolist() == expected
            assert counts[k - row] == len(expected)


def test_other_vocabulary_is_encoded_whole():
    code = encoder("piece_bpe_32k.model")
    ids, where = code.ids_block(np.frombuffer(b"one twothree", np.uint8), np.array([0, 7, 7, 12]))
    assert [ids[a:b].tolist() for a, b in zip(where[:-1], where[1:], strict=True)] == [code.whole(t) for t in ("one two", "", "three")]


def test_chunks_splice_and_widen(hard_texts):
    code, whole = encoder("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    for text in (t for t in hard_texts if t):
        for chunk, overlap in ((16, 2), (64, 8), (1000, 50)):
            assert token_counts.chunked_count(code, text, chunk, overlap)[0] == len(whole(text))
    spliced = token_counts.chunked_count(code, "word " * 5_000, 1_000, 100)
    assert spliced[1] > 20
    assert token_counts.chunked_count(code, "x" * 5_000, 1_000, 10)[0] == len(whole("x" * 5_000))


def test_token_counts(documents, no_documents, hard_texts):
    whole = library("byte_bpe_50k.json")
    rows = {r["doc_id"]: r for r in token_counts.token_counts(documents, chunk=2_000, overlap=100).collect()}
    for k, text in enumerate(hard_texts):
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"]) == (len((text or "").encode()), len(whole(text)))
    assert token_counts.token_counts(no_documents).count() == 0


@pytest.mark.parametrize("domain", [1, 2, 7, 100, 4096, 5000])
def test_permutation_is_a_bijection(domain):
    assert sorted(training_order.permuted(np.arange(domain), domain, 5).tolist()) == list(range(domain))
    assert domain < 100 or training_order.permuted(np.arange(domain), domain, 5).tolist() != training_order.permuted(np.arange(domain), domain, 6).tolist()


def test_training_order_round_trip(documents, no_documents, hard_texts, tmp_path):
    whole, folder, length = library("word_bpe_49k.json"), str(tmp_path / "order"), 64
    rows = training_order.materialise(documents, folder, length=length, shard_bytes=4_000).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert [r["slot"] for r in sorted(rows, key=lambda r: (r["shard"], r["row_in_shard"]))] == list(range(len(rows)))
    seen = []
    for r in rows:
        ids = training_order.read_sequences(folder, r["shard"], r["row_in_shard"], 1, length=length)[0]
        assert zlib.crc32(ids[: r["n_ids"]].astype("<u4").tobytes()) == r["ids_crc32"]
        assert sum(r["lengths"]) == r["n_ids"]
        at = 0
        for doc, n in zip(r["doc_ids"], r["lengths"], strict=True):
            seen.append((doc, ids[at : at + n].tolist()))
            at += n
    for k, text in enumerate(hard_texts):
        expected = [*whole(text), 1]
        pieces = [p for d, p in seen if d == k]
        assert sorted(i for p in pieces for i in p) == sorted(expected)
        assert all(any(expected[a : a + len(p)] == p for a in range(len(expected) - len(p) + 1)) for p in pieces)
    assert training_order.materialise(no_documents, str(tmp_path / "none")).count() == 0


def check_pieces(rows, texts, whole, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for k, text in enumerate(texts):
        ids, at = [*whole(text), 1], 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return len(by_sequence)


def test_packing(documents, no_documents, hard_texts):
    whole = library("word_bpe_49k.json")
    rows = packing.pack(documents, window=128, shard_pieces=16).collect()
    sequences = check_pieces(rows, hard_texts, whole, 128)
    total = sum(len(whole(t)) + 1 for t in hard_texts)
    assert sequences <= total / 128 + 8
    assert packing.pack(no_documents).count() == 0


def test_packing_prefers_lexical_neighbours():
    statistics = packing.Statistics(np.arange(200), np.full(200, 2), 1000, 20.0)
    rests = [np.arange(0, 20), np.arange(100, 119), np.arange(0, 12), np.arange(100, 112)]
    pieces = packing.fill_windows([r.astype(np.uint16) for r in rests], statistics, 32)
    assert [(p[0], p[3]) for p in pieces] == [(0, 0), (2, 0), (1, 1), (3, 1)]


def test_shard_layout_splits_large_keys():
    assert packing.shard_layout([(1, 3), (2, 4), (3, 25), (4, 1)], 10) == [(1, 0, 1), (2, 0, 1), (3, 1, 3), (4, 4, 1)]
