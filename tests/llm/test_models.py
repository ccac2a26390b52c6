"""The learned operators: gradients, held-out accuracy and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill.llm import langid, toxicity


def test_gradient_matches_differences():
    net = langid.Network.fresh(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(1)
    data, lang = rng.integers(97, 105, (9, 4)).astype(np.intp), np.array([0, 1, 2, 1])
    _, g = net.gradient(data, lang)
    for k, w in net.w.items():
        flat = np.flatnonzero(np.abs(g[k]).ravel() > 1e-7)
        assert len(flat)
        for i in rng.choice(flat, min(5, len(flat)), replace=False):
            at, h = np.unravel_index(i, w.shape), 1e-5
            old = w[at]
            w[at] = old + h
            up, _ = net.gradient(data, lang)
            w[at] = old - h
            down, _ = net.gradient(data, lang)
            w[at] = old
            assert abs((up - down) / (2 * h) - g[k][at]) < 1e-7 + 1e-4 * abs(g[k][at]), k


def slow_text(net, text):
    """Log probabilities and probabilities summed over a text's bytes, position by position from the equations."""
    data, out = text.lower().encode(), np.zeros((2, len(net.langs)))
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    for core in range(0, len(data), langid.WINDOW):
        a, b = max(0, core - langid.MARGIN), min(len(data), core + langid.WINDOW + langid.MARGIN)
        y = np.tile(w["bias"], (b - a, 1))
        for d, places in (("f", range(a, b)), ("b", range(b - 1, a - 1, -1))):
            h = np.zeros(langid.UNITS)
            for t in places:
                x = {g: w["e"][data[t]] @ w[f"x{g}{d}"] + w[f"v{g}{d}"] for g in "zrc"}
                z, r = (1 / (1 + np.exp(-2 * (x[g] + h @ w[f"u{g}{d}"]))) for g in "zr")
                c = np.tanh(x["c"] + 2 * r * (h @ w[f"uc{d}"]))
                h = (1 - z) * h + z * c
                y[t - a] += h @ w[f"o{d}"]
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own = slice(core - a, min(len(data), core + langid.WINDOW) - a)
        out += [np.log(p[own]).sum(0), p[own].sum(0)]
    return out


def test_every_position_is_labelled(rows):
    """The windowed network equals the equations, for texts of all lengths read together or alone."""
    net = langid.Network.fresh(["a", "b", "c", "d", "e"])
    texts = ["x", "É", "12 abc, 34!", "straße " * 27, "w" * 192, "w" * 193, rows[0][1], rows[5][1] * 3, "z" * 401]
    got = net.text_scores([t.lower().encode() for t in texts])
    for text, row in zip(texts, got, strict=True):
        want = slow_text(net, text)
        assert np.allclose(row.reshape(2, -1), want, rtol=2e-4, atol=1e-3)
        assert abs(row[5:].sum() - len(text.lower().encode())) < 1e-2
        assert np.allclose(net.text_scores([text.lower().encode()])[0], row, rtol=1e-4, atol=1e-3)


def test_labelling_takes_exponentials_alone(monkeypatch):
    """A tangent takes numpy twice as long as an exponential, and most of the time went into them: none is taken, and one exponential for each gate and unit."""
    net, text = langid.Network.fresh(["a", "b", "c"]), b"some words " * 20
    want, counted = net.text_scores([text]), []
    exp = np.exp

    def no_tangent(*_, **__):
        raise AssertionError("a tangent in labelling")

    monkeypatch.setattr(np, "tanh", no_tangent)
    monkeypatch.setattr(np, "exp", lambda x, **k: (counted.append(np.size(x)), exp(x, **k))[1])
    assert np.array_equal(net.text_scores([text]), want)
    assert sum(counted) == len(text) * (2 * 3 * langid.UNITS + net.outputs)


@pytest.mark.filterwarnings("error")
def test_gates_beyond_the_range_of_an_exponential():
    """Where exp(-2 a) is infinite or zero in single precision, gates have their limits, without a warning."""
    net = langid.Network.fresh(["a", "b", "c", "d", "e"])
    net.w["e"] *= 40
    text = "Some words, 12 of them, and straße " * 12
    most = max(np.abs(net.w["e"] @ net.w[f"x{g}{d}"]).max() for g in "zrc" for d in "fb")
    assert 80 < most < 300
    assert np.allclose(net.text_scores([text.lower().encode()])[0].reshape(2, -1), slow_text(net, text), rtol=2e-4, atol=1e-3)


def test_languages_of_the_fixture(docs, rows):
    net = langid.fit(docs, steps=150)
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    checked = [r.lang_pred == lang[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 60 and r.held_out]
    assert len(checked) > 10 and np.mean(checked) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (62, 63, 65, 66))
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_known(docs, net)
    assert kept.columns == docs.columns and {62, 63, 65, 66}.isdisjoint({r.doc_id for r in kept.collect()})


def test_held_out_accuracy(spark):
    """On the driver's smallest table of text in four languages, and where words of one language stand among digits and marks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    got = langid.identify(docs, net).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 250 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    long = [r for r in got if len(r.text) > 300][:60]
    noisy = ["".join(f"{w} {i * 7919 % 1000} -- " for i, w in enumerate(r.text.split())) for r in long]
    assert np.mean([a == r.lang for a, r in zip(langid.Scorer(net).score(noisy)[0], long, strict=True)]) > 0.9


def test_network_with_texts_in_no_language(docs):
    """The further output changes no language's name, and tells shuffled letters from texts."""
    net = langid.fit(docs)
    assert net.langs == ["de", "en"] and net.outputs == 3
    texts = [r.text for r in docs.filter("doc_id < 20").collect()]
    rng = np.random.default_rng(1)
    mixed = ["".join(rng.permutation(list(t)).tolist()) for t in texts]
    known = langid.Scorer(net).known(texts + mixed + ["", "123"])
    assert min(known[:20]) > 0.8 and np.mean(known[20:40]) < 0.3 and known[40:] == [0.0, 0.0]
    assert langid.in_no_language(texts, 3, 5000) == langid.in_no_language(texts, 3, 5000)


def test_rare_languages_are_sampled_beside_large_ones(spark):
    """Fifty languages of one document each beside 24 large ones; a language of mostly null texts; one whose rows have one id."""
    rows = [(i, f"text {i}", f"large{i % 24:02}") for i in range(24 * 60)]
    rare = [i for i in range(10_000, 10_200) if not langid.held_out(i)][:50]
    rows += [(i, "only one", f"rare{i}") for i in rare]
    rows += [(20_000 + i, None, "empty") for i in range(3000)] + [(30_000 + i, "words", "empty") for i in range(7)]
    rows += [(40_000, f"copy {i % 40}", "same") for i in range(400)] + [(50_000 + i, "12 34", "digits") for i in range(9)] + [(None, "no id", "none"), (60_000, "no language", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.training_rows(table, docs_per_lang=20).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in got}
    assert {lang for lang in n if lang.startswith("rare")} == {f"rare{i}" for i in rare}
    assert {n[f"large{k:02}"] for k in range(24)} == {20}
    assert n["empty"] == sum(not langid.held_out(30_000 + i) for i in range(7))
    assert not langid.held_out(40_000) and 1 <= n["same"] <= 20 and not n.keys() & {"digits", "none", None}


def test_languages_without_training_rows(no_docs, docs):
    net = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, net).collect()} == {"und"}
    assert langid.identify(no_docs, net).collect() == []


def test_every_language_is_learned(spark):
    """More than 64 languages, the rarest one only in texts of more than 20,000 characters."""
    rows = [(3 * i + j, f"text of {i}", f"l{i:02}") for i in range(70) for j in range(3)]
    rows += [(1000 + i, "szczęście " * 3000, "pl") for i in range(4)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=1)
    learned = {r[2] for r in rows if not langid.held_out(r[0])}
    assert len(learned) > 64 and "pl" in learned and set(net.langs) == learned


def test_long_texts_are_drawn_from_as_a_whole():
    text = "".join(f"w{i} " for i in range(20_000))
    got = langid.drawn_text(text, 2000, 7).split()
    assert len(" ".join(got)) <= 2010 and len(got) == len(set(got)) > 200
    assert int(got[0][1:]) < 2000 and int(got[-1][1:]) > 18_000
    assert langid.drawn_text("a b", 10, 7) == "a b" and 0 < len(langid.drawn_text("x" * 50_000, 2000, 7)) <= 3000


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [str(x) for x in rng.choice(words, 40)]
        kind = i % 4
        # The pair is toxic; either of its words alone is not.
        text += [["insult", "group"], ["insult"], ["group"], []][kind]
        rng.shuffle(text)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(kind == 0)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "insult group", "x")]
    labels += [(2000, 1, 1), (None, 1, 1), (5, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_count_beyond_single_terms(toxic):
    docs, labels = toxic
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 903
    held = [(r.predicted, int(i % 4 == 0)) for i, r in got.items() if i is not None and i < 900 and r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[1000].score == got[1001].score < 0.7
    assert got[None].predicted == 1 and got[None].held_out is False


def test_pairs_of_terms_that_say_nothing_alone(spark):
    """A document is toxic if it holds just one of two words, so each is independent of the label."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1600):
        text = [f"w{x}" for x in rng.integers(0, 300, 40)] + [["alpha", "beta"], ["alpha"], ["beta"], []][i % 4]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 in (1, 2))))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, machine).filter("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 in (1, 2)) for r in got]) > 0.97


def test_scores_equal_all_pairs_written_out():
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(30)]
    ids = np.unique([i for w in words for i in toxicity.term_ids(w)])
    machine = toxicity.Machine(ids, rng.normal(size=len(ids)), rng.normal(size=(len(ids), 8)) / 4, -0.3)
    texts = ["", "none of these", "Word1, word2!", *[" ".join(rng.choice(words, 12)) for _ in range(30)]]
    got = toxicity.Scorer(machine).score(texts)
    for text, score in zip(texts, got.tolist(), strict=True):
        held = sorted({i for w in re.findall(r"[a-z]+[0-9]*", text.lower()) for i in toxicity.term_ids(re.sub("[0-9]", "", w))} & set(ids.tolist()))
        at = [int(np.searchsorted(ids, h)) for h in held]
        x = machine.bias + sum(machine.weight[i] for i in at) + sum(float(machine.vector[i] @ machine.vector[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(score - 1 / (1 + np.exp(-x))) < 1e-9


def test_an_id_on_many_rows_is_trained_on_once(spark, toxic):
    docs, labels = toxic
    hot = spark.range(5000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("w1 "), F.col("id") % 3).alias("text"), F.lit("x").alias("label"))
    machine = toxicity.fit(docs.filter("doc_id <> 5").unionByName(hot), labels.unionByName(labels))
    assert np.isfinite(machine.weight).all()
    renamed = docs.withColumnRenamed("doc_id", "key")
    assert (toxicity.fit(renamed, labels, id_col="key").weight == toxicity.fit(docs, labels).weight).all()
    assert toxicity.score_documents(docs.filter(F.lit(False)), machine).collect() == []


def test_toxicity_without_labels(toxic):
    docs, labels = toxic
    machine = toxicity.fit(docs, labels.filter(F.lit(False)))
    assert {r.score for r in toxicity.score_documents(docs, machine).collect()} == {0.5}
