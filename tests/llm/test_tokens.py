"""Byte-level BPE, token records and packing against the public tokenizers."""

import base64
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skymill.llm import bpe, packing, queries, records, wordids

RANKS = bpe.load_ranks(queries.RANKS)
MODEL = queries.byte_model(queries.RANKS)
WORDS = queries.word_model(queries.WORD_MODEL)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_str(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_equals_tiktoken(text):
    (ids,) = bpe._encoder(MODEL, public.PATTERN).encode_batch([text])
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert bpe._encoder(MODEL, public.PATTERN).decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sSéÉßÿ×÷.,1<|endoftext|>")), max_size=40))
def test_word_ids_equal_the_library(text):
    got = np.frombuffer(wordids.word_encoder(WORDS).encode(text), "<u2").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_serialize_model_rejects_bad_ranks():
    with pytest.raises(ValueError):
        bpe.serialize_model({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        bpe.serialize_model({b"a": 0})


def test_encode_and_decode_tables(docs, rows):
    encoded = bpe.encode_documents(docs, MODEL, public.PATTERN)
    decoded = bpe.decode_documents(encoded, MODEL, public.PATTERN).collect()
    assert sorted(bytes(r.data) for r in decoded) == sorted((r[1] or "").encode() for r in rows)


def test_crc32c_known_values():
    # Published check values of CRC-32C.
    assert records.crc32c([b"123456789", b"", bytes(32), b"\xff" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_frames_round_trip(payloads):
    assert records.unframe(b"".join(records.frame(payloads))) == payloads


def test_damaged_frames_are_found():
    data = bytearray(b"".join(records.frame([b"hello", b"world"])))
    data[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))
    with pytest.raises(ValueError):
        records.unframe(bytes(data[:-1]))


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def test_records_lie_in_id_order(docs, rows):
    got = records.read_records(records.record_files(docs, WORDS, end_id=1)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert all(zlib.crc32(np.frombuffer(r.ids, f"<u{r.width}").astype("<u4")) == r.ids_crc32 for r in got)
    want = sorted((-1 if r[0] is None else r[0], zlib.crc32(np.array(ids_of(r[1], 1), "<u4"))) for r in rows)
    assert want == sorted(zip(keys, [r.ids_crc32 for r in got], strict=True))


def test_one_id_of_most_rows_is_dealt_out(spark):
    rows = [(7, f"text number {i}", "x") for i in range(300)] + [(i, "short", "x") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, tie string")
    manifest = records.record_files(table, WORDS, end_id=1)
    assert manifest.count() == 4 and manifest.agg({"n_records": "max"}).first()[0] < 200
    got = sorted(records.read_records(manifest, with_ids=False).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(ids_of(r[1], 1), "<u4")) for r in rows)


def test_records_of_an_empty_table(no_docs):
    assert records.read_records(records.record_files(no_docs, WORDS, end_id=1)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(lengths):
    lengths = np.array(lengths, np.int64)
    window, offset = packing.best_fit(lengths, 64)
    # Brute force: the tightest open window, longest first.
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            w = min(fits, key=lambda w: rooms[w])
        else:
            rooms.append(64)
            w = len(rooms) - 1
        rooms[w] -= lengths[i]
    got = [0] * (int(window.max(initial=-1)) + 1)
    for w, o, n in sorted(zip(window.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert got[w] == o
        got[w] += n
    assert sorted(got) == sorted(64 - r for r in rooms)


def test_pieces_cover_each_document_once(docs, rows):
    got = packing.pack_documents(docs, WORDS, end_id=2).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 4096
    assert sum(r.length for r in got) == sum(len(ids_of(r[1], 2)) for r in rows)
    long = sorted((r for r in got if r.doc_id == 64), key=lambda r: r.start)
    ids = np.array(ids_of(next(x[1] for x in rows if x[0] == 64), 2), "<u4")
    assert len(long) > 2 and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) for r in long)


def test_packing_an_empty_table(no_docs):
    assert packing.pack_documents(no_docs, WORDS, end_id=2).collect() == []


def test_rank_file_is_base64():
    assert base64.b64encode(min(RANKS, key=RANKS.get))
