"""Every operator on tables with clashing column names, without rows, and with nulls in every column."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skymill.llm import bpe, embeddings, langid, matching, packing, pii, quality, queries, records, secrets, simhash, toxicity

CLASHES = "row id ids n n_docs host spans matches hash owner kind start end node root terms label mark text_2 fp home anchor rate rejected suspect failed n_words __rank __h __key __n __spans __kept_id __quality_n_words __redact_n __near_rank".split()
MODEL, WORDS = queries.byte_model(queries.RANKS), queries.word_model(queries.WORD_MODEL)
NET = langid.Network.fresh(["de", "en"])
MACHINE = toxicity.train([], np.zeros(0))

OPERATORS = {
    "bpe": lambda d: bpe.round_trip_digests(d, MODEL, public_tokenizers.PATTERN),
    "records": lambda d: records.read_records(records.record_files(d, WORDS, end_id=1), with_ids=False),
    "secrets": lambda d: secrets.span_digests(secrets.find_secrets(d)),
    "redaction": lambda d: secrets.redact_live(d),
    "packing": lambda d: packing.pack_documents(d, WORDS, end_id=2, with_ids=False),
    "matching": lambda d: matching.pack_documents(d, WORDS, end_id=1, with_ids=False),
    "toxicity": lambda d: toxicity.score_documents(d, MACHINE),
    "language": lambda d: langid.identify(d, NET),
    "known": lambda d: langid.keep_known(d, NET),
    "personal data": lambda d: pii.span_digests(pii.find_personal_data(d)),
    "masking": lambda d: pii.mask_personal_data(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "one of each": lambda d: simhash.keep_one(d),
    "quality": lambda d: quality.judge_documents(d),
    "good": lambda d: quality.keep_good(d),
}
FILTERS = {"redaction", "known", "masking", "one of each", "good"}


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_no_rows(docs, no_docs, name):
    """The same rows as without the other columns, and those unchanged where documents are returned."""
    table = docs.select("doc_id", "text", "lang", "source", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    got, want = OPERATORS[name](table), OPERATORS[name](docs.select("doc_id", "text", "lang", "source"))
    assert plain(got, want.columns) == plain(want, want.columns)
    if name in FILTERS:
        assert got.columns == table.columns
        assert all(r[c] == i for r in got.collect() for i, c in enumerate(CLASHES))
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_nulls(spark, name):
    table = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    got = OPERATORS[name](table).collect()
    assert len(got) == {"known": 0, "good": 0, "one of each": 1}.get(name, 3)


def test_embeddings_of_odd_tables(spark):
    rows = [(None, None), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, node int, n int, kept int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(table).collect())
    assert got == [(0, 0, 0, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_learning_from_odd_tables(docs, no_docs):
    labels = docs.select("doc_id", F.lit(1).alias("toxic")).filter(F.lit(False))
    assert toxicity.fit(no_docs, labels).bias == toxicity.fit(docs, labels).bias == 0
    assert langid.fit(no_docs).langs == ["und"]
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))).langs == ["und"]
