"""Every registered query over the driver's smallest tables, against the libraries, plain Python or its SQL."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import tokenizers
from test_groups import components, slow_fingerprint
from test_scrub import base_personal, base_secrets

from skymill.llm import bpe, langid, packing, queries, toxicity

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SMOKE}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return {i: t or "" for i, t in zip(table["doc_id"], table["text"], strict=True)}


def rows(spark, name):
    out = queries.QUERIES[name](spark, SMOKE).collect()
    return out, {r["vec_id" if name.startswith("op9") else "doc_id"]: r for r in out}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def word_ids(texts):
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: model.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_byte_bpe(spark, texts):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, got = rows(spark, "op1_byte_bpe")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = model.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_token_records(spark, word_ids):
    _, got = rows(spark, "op2_token_records")
    assert got.keys() == word_ids.keys()
    start = 0
    for i in sorted(word_ids):
        ids = [*word_ids[i], 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_packing(spark, word_ids):
    out, _ = rows(spark, "op4_packing")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == word_ids.keys()
    for i, own in pieces.items():
        ids, at = [*word_ids[i], 2], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length])) and r.length > 0
            at += r.length
        assert at == len(ids)
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padded += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padded <= 0.05 * sum(len(x) + 1 for x in word_ids.values()) + packing.WINDOW


def test_matched_packing(spark, word_ids):
    out, _ = rows(spark, "op12_matched_packing")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == word_ids.keys()
    for i, own in pieces.items():
        ids = [*word_ids[i], 1]
        cuts = [(k, at, ids[at : at + packing.WINDOW]) for k, at in enumerate(range(0, len(ids), packing.WINDOW))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == [(k, at, len(part), crc(part)) for k, at, part in cuts]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    lengths = [r.length for r in out]
    large = sum(3 * n > packing.WINDOW for n in lengths)
    assert len(sequences) <= max(-(-sum(lengths) // packing.WINDOW), large) + 2


def test_secrets(spark, texts):
    _, got = rows(spark, "op3_secret_ownership")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = base_secrets(t)
        count = Counter(x.split(":")[0] for x in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(want).encode()).hexdigest())
        assert set(want) <= set(got[i].spans.split(","))


def test_personal_data(spark, texts):
    _, got = rows(spark, "op7_personal_data")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = base_personal(t)
        spans = [f"{k}:{a}:{b}" for k in want for a, b in want[k]]
        assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= {*got[i].spans.split(","), ""}


def test_simhash(spark, texts):
    _, got = rows(spark, "op8_simhash")
    ids = sorted(texts)
    prints = np.array([slow_fingerprint(texts[i]) for i in ids], np.uint64)
    comp = components(len(ids), [(i, j) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 4).tolist()])
    assert {i: (got[i].fingerprint, got[i].component_id) for i in got} == {i: (f"{int(p):016x}", ids[c]) for i, p, c in zip(ids, prints, comp, strict=True)}


def test_learned_queries(spark, texts):
    """Folds and ranges; what equal texts get; a null or letterless text is und."""
    by_text = defaultdict(set)
    for name, score in (("op5_toxicity", "predicted"), ("op6_language_id", "lang_pred")):
        _, got = rows(spark, name)
        assert got.keys() == texts.keys()
        for i, r in got.items():
            assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
            by_text[name, texts[i]].add((r[score], r.score))
            if name.startswith("op5"):
                assert r.predicted == int(r.score >= toxicity.THRESHOLD)
            else:
                assert (r.lang_pred == langid.UND) == (not any(map(str.isalpha, texts[i])))
    assert all(len(x) == 1 for x in by_text.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    out = queries.QUERIES[name](spark, SMOKE)
    names = sorted(out.columns)
    sql = con.sql(queries.ORACLE_SQL[name])
    assert names == sorted(sql.columns)

    def plain(values):
        return sorted(json.dumps([round(v, 6) if isinstance(v, float) else v for v in r]) for r in values)

    assert plain(out.select(*names).collect()) == plain(sql.select(*names).fetchall())
