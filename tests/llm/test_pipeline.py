"""The pipeline's stages on the fixture: what goes, what stays, and the columns."""

import base64
import random

from test_groups import components

import corpus_pipeline
from skymill.llm import langid, quality, simhash


def test_stages_in_order(spark, docs, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "secret_scans", "packing"]
    at = docs
    seen = [sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "").cache()
        assert at.columns == docs.columns
        seen.append(sorted((r.doc_id is None, r.doc_id or 0) for r in at.select("doc_id").collect()))
    start, languages, good, single, scanned = map(set, seen)
    assert start > languages >= good > single == scanned
    text = {r[0]: r[1] or "" for r in rows}
    assert {i for _, i in languages - good} <= {i for i in text if i is not None and quality.base_fails(quality.text_counts(text[i]))}
    prints = {i: simhash.fingerprint(text[i]) for _, i in good}
    ids = sorted(i for none, i in good if not none)
    comp = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4])
    # Of each component the least id stays, and nothing else goes.
    assert sorted(i for none, i in single if not none) == sorted({ids[c] for c in comp}) and len(single) < len(good)
    found = {r.doc_id: r.text for r in at.select("doc_id", "text").collect()}
    assert all(found[i] == text[i] or "<" in found[i] for i in found if i is not None)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert {r.doc_id for r in packed} == {None if none else i for none, i in scanned}


def test_first_stage_keeps_clean_texts(spark, docs):
    kept = langid.keep_known(docs, langid.fit(docs))
    assert {r.doc_id for r in kept.collect()} >= set(range(62))


def test_first_stage_drops_noise_and_unlearned_languages(spark, docs, rows):
    rng = random.Random(6)
    en, de = rows[1][1].split(), rows[0][1].split()
    good = [" ".join(en), " ".join(de), " ".join(en + de), " ".join(w for pair in zip(en, de, strict=False) for w in pair), " ".join(en) + f' token = "{rng.randrange(16**40):040x}"']
    bad = [
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "все люди рождаются свободными и равными в своем достоинстве и правах",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(2000)),
        base64.b64encode(rng.randbytes(1000)).decode(),
        rng.randbytes(1000).hex(),
    ]
    table = spark.createDataFrame([(i, t, None, None, 0, None, None, None) for i, t in enumerate(good + bad)], docs.schema)
    kept = langid.keep_known(table, langid.fit(docs))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(good)))
