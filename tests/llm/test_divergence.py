"""The audit against plain Python: counts, shares, both parts, ties by bytes, odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skymill.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_audit(rows, top, min_docs=3):
    """rows: (text, lang, source)."""
    own, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = terms_of(text)
        own[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in own}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        groups = [g for g in own if g[0] == lang]
        whole = Counter()
        for g in groups:
            whole.update(own[g])

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return [1 + 10**9 * (counts[t] + 1) // total for t in kept]

        q = shares(whole)
        p = {g: shares(own[g]) for g in groups}
        for g in groups:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[g], p[o], strict=True)), o[1]) for o in groups if o != g]
            terms = [((a - b) ** 2 // b, t) for a, b, t in zip(p[g], q, kept, strict=True) if own[g][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g[1], part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


COLUMNS = "text string, lang string, source string"


def audited(spark, rows, **options):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, COLUMNS).repartition(3), **options).collect()))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZ É\n_9ß漢𝒳 -"), max_size=80))
def test_terms_of_a_text(text):
    assert [t.decode() for part in divergence.split_terms(text.encode()) for t in part] == terms_of(text)


def test_a_text_is_split_in_parts():
    words = ["w" * 700] * 5000
    parts = list(divergence.split_terms(" ".join(words).encode()))
    assert len(parts) > 2 and sum(map(len, parts)) == 5000 and {t for p in parts for t in p} == {b"w" * 700}
    assert list(divergence.split_terms(b"x" * (divergence.SPLIT_BYTES * 2))) == [[b"x" * (divergence.SPLIT_BYTES * 2)]]
    assert list(divergence.split_terms(b"")) == []


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcéß漢") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = [(" ".join(rng.choices(words, range(1, 301), k=rng.randint(0, 120))), rng.choice(["en", "de"]), f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}") for _ in range(80)]
    rows += [(None, "en", "empty"), ("", None, None), ("The the", None, None), (None, None, None), ("only here", "xx", "one"), ("12 - 34", "xx", "two"), ("same text", "fr", "a"), ("same text", "fr", "a"), ("same text", "fr", "b")]
    return rows


@pytest.mark.parametrize(("top", "few"), [(200, 1024), (5, 0), (1, 0), (7, 2)])
def test_audit_equals_plain_python(spark, mixed, top, few):
    assert audited(spark, mixed, top=top, few=few) == plain_audit(mixed, top)


def test_ties_by_bytes(spark):
    """A term in each of three documents, so all have one value; they share long beginnings and differ in length, and some come after others in UTF-8 only."""
    rng = random.Random(2)
    stem = "p" * 300
    terms = sorted({stem + "".join(rng.choice("abé～𝒳") for _ in range(rng.randint(0, 6))) for _ in range(400)} | {stem, stem[:-1], "𝒳", "～"})
    rows = [(" ".join(terms), "en", "a")] * 3 + [("other words beside", "en", "b")] * 9
    for top, few in ((200, 0), (37, 3), (1, 0)):
        got = audited(spark, rows, top=top, few=few)
        assert got == plain_audit(rows, top)
        assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("a", "term")] == sorted(terms, key=str.encode)[:top]


def test_kth_values(spark):
    rng = random.Random(1)
    rows = [(g, "s", "", rng.choice([0, 1, 2**15, 2**30 - 1, 2**45 + 7, 10**18, rng.randrange(2**60)])) for g in "ab" for _ in range(300)] + [("c", "s", "", 5)] * 9
    found = spark.createDataFrame(rows, "lang string, source string, term string, value long")
    got = {r.lang: (r.prefix, r.need, r.here) for r in divergence.kth_values(found, 20).collect()}
    for g in "ab":
        values = sorted((r[3] for r in rows if r[0] == g), reverse=True)
        kth = values[19]
        assert got[g] == (kth, 20 - sum(v > kth for v in values), values.count(kth))
    assert set(got) == {"a", "b"}


def test_pairs_in_blocks(monkeypatch):
    """Terms of many sources, cut over batches and worked out a few pairs at a time."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 16)
    rows = [(lang, f"t{t}", int(s), int(rng.integers(1, 10**9)), 1 + int(s)) for lang in ("de", "en") for t in range(12) for s in rng.permutation(9)[: rng.integers(1, 9)]]
    table = pa.table(dict(zip(("lang", "term", "place", "p", "p0"), map(list, zip(*rows, strict=True)), strict=True)))
    got = Counter()
    for batch in divergence._both(iter(table.to_batches(max_chunksize=7))):
        for lang, a, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[lang, a, b] += v
    want = Counter()

    def f(p, q):
        return (p - q) ** 2 // q

    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and x[2] != y[2]:
                want[x[0], x[2], y[2]] += f(x[3], y[3]) - f(x[3], y[4]) - f(x[4], y[3]) + f(x[4], y[4])
    assert got == want


def test_clashing_names(spark, mixed):
    plain = spark.createDataFrame(mixed, COLUMNS)
    odd = plain.select("*", *[F.lit(1).alias(c) for c in ("term", "n", "docs", "total", "once", "place", "value", "prefix", "need", "__first", "rank", "item", "part")])
    assert sorted(map(str, divergence.audit(odd).collect())) == sorted(map(str, divergence.audit(plain).collect()))


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_counts_beyond_64_bits(spark):
    n = 10**13
    row = spark.createDataFrame([(n, 3 * n, 7)], "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (3 * n + 7)
