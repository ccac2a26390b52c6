"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed. Terms that go with the label beyond chance are kept, alone or in pairs whose
terms may each say nothing; the machine gives each a weight and a vector, and scores a document by the sum of its terms'
weights and of the inner products of all pairs of their vectors, so that two terms together may count for more or less
than apart. It is fitted in numpy by Adagrad on a bounded sample of labelled rows.

Null and empty texts have no terms and get the machine's score for none. Equal texts get equal scores. Rows without an id
are scored; rows that share an id are scored one by one, and count once for training. Without labelled rows of both classes,
or without documents, every score is the labels' mean (0.5 if there are none). An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_CHARS, CACHE_WORDS, map_rows, text_list, worker_state
from .langid import held_out

#: Labelled rows that the machine is fitted on at most.
MAX_TRAIN = 8000
SPACE_BITS = 22
#: Lengths of the beginnings of words that are terms of their own.
PREFIXES = (4, 5, 6, 7)
#: A term is kept if its log-likelihood ratio with the label is above this, and the most telling ones up to a number.
MIN_RATIO = 15.0
MAX_TERMS = 8192
#: Pairs of the commonest terms of label 1 are tried; one is kept if its ratio is above this and above so many times that of either term alone.
PAIR_TERMS, MIN_PAIR_RATIO, PAIR_GAIN = 1024, 40.0, 2.0
MAX_PAIRS = 512
FACTORS, EPOCHS, RATE, DECAY = 8, 60, 0.2, 1e-4
THRESHOLD = 0.7

_WORDS = re.compile(r"[^\W\d_]+").findall


def term_ids(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its beginnings."""
    terms = [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(t.encode()) & (1 << SPACE_BITS) - 1 for t in terms)


@dataclass
class Machine:
    """ids: hashed terms, ascending; weight and vector of each; bias."""

    ids: np.ndarray
    weight: np.ndarray
    vector: np.ndarray
    bias: float

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of documents given as positions in ids."""
        out = np.full(len(rows), self.bias)
        for i, r in enumerate(rows):
            if r:
                v = self.vector[r]
                s = v.sum(0)
                out[i] += self.weight[r].sum() + 0.5 * float(s @ s - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _ratios(a: np.ndarray, df: np.ndarray, n1: int, n: int) -> np.ndarray:
    """Log-likelihood ratios of being in a document and its label: a of the n1 documents of label 1 and df of all n hold it."""

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(expected, 1e-12)), 0)

    b = df - a
    return 2 * (part(a, df * n1 / n) + part(b, df * (n - n1) / n) + part(n1 - a, (n - df) * n1 / n) + part(n - n1 - b, (n - df) * (n - n1) / n))


def choose_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Hashed terms with a log-likelihood ratio above MIN_RATIO, and those of telling pairs; ascending."""
    every, where = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(labels, [len(r) for r in rows])
    n1, n = int(labels.sum()), len(labels)
    a, df = np.bincount(where, owner, len(every)), np.bincount(where, minlength=len(every))
    ratio = _ratios(a, df, n1, n)
    best = np.argsort(-ratio, kind="stable")[:MAX_TERMS]
    common = np.sort(np.argsort(-a, kind="stable")[:PAIR_TERMS])
    return np.union1d(every[best[ratio[best] > MIN_RATIO]], every[common[telling_pairs(rows, labels, every[common], ratio[common])]])


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Places of the terms of pairs that say more of the label than either term. terms: ascending; ratio: of each alone."""
    both = np.zeros((2, len(terms), len(terms)), np.float32)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        for at in range(0, len(own), 512):
            held = np.stack([np.isin(terms, rows[i], assume_unique=True) for i in own[at : at + 512]]).astype(np.float32)
            both[label] += held.T @ held
    found = []
    for at in range(0, len(terms), 64):
        a, df = both[1, at : at + 64].astype(np.float64), both[:, at : at + 64].sum(0, dtype=np.float64)
        value = _ratios(a, df, int(labels.sum()), len(labels))
        value[np.arange(len(terms))[None, :] <= np.arange(at, at + len(value))[:, None]] = 0
        more = (value > MIN_PAIR_RATIO) & (value > PAIR_GAIN * np.maximum(ratio[at : at + 64, None], ratio[None, :]))
        i, j = np.nonzero(more)
        found += zip((-value[i, j]).tolist(), (i + at).tolist(), j.tolist(), strict=True)
    return np.unique(np.array([x for _, i, j in sorted(found)[:MAX_PAIRS] for x in (i, j)], np.int64))


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Fit on documents given as distinct hashed terms. Adagrad on the logistic loss, one document at a time."""
    mean = float(labels.mean()) if len(labels) else 0.5
    empty = np.zeros(0, np.int64)
    if not len(labels) or not 0 < mean < 1:
        p = min(max(mean, 0.01), 0.99)
        return Machine(empty, np.zeros(0), np.zeros((0, FACTORS)), float(np.log(p / (1 - p))))
    ids = choose_terms(rows, labels)
    docs = [np.flatnonzero(np.isin(ids, r, assume_unique=True)) for r in rows]
    rng = np.random.default_rng(seed)
    weight, vector, bias = np.zeros(len(ids)), rng.normal(0, 0.05, (len(ids), FACTORS)), float(np.log(mean / (1 - mean)))
    gw, gv, gb = np.full(len(ids), 1.0), np.full((len(ids), FACTORS), 1.0), 1.0
    plain = [i for i, d in enumerate(docs) if not len(d)]
    told = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)
    for _ in range(EPOCHS):
        # All documents without a term share one score: their gradient is taken at once.
        p = 1 / (1 + np.exp(-bias))
        g = float((p - labels[plain]).sum()) if plain else 0.0
        gb += g * g
        bias -= RATE * g / np.sqrt(gb)
        for i in rng.permutation(told).tolist():
            d = docs[i]
            v = vector[d]
            s = v.sum(0)
            x = bias + weight[d].sum() + 0.5 * float(s @ s - (v * v).sum())
            g = 1 / (1 + np.exp(-min(max(x, -30), 30))) - labels[i]
            dw = g + DECAY * weight[d]
            dv = g * (s - v) + DECAY * v
            gw[d] += dw * dw
            gv[d] += dv * dv
            weight[d] -= RATE * dw / np.sqrt(gw[d])
            vector[d] -= RATE * dv / np.sqrt(gv[d])
    return Machine(ids, weight, vector, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", max_rows: int = MAX_TRAIN) -> Machine:
    """Train on up to max_rows labelled documents, chosen by a hash of their id, whose id's crc32 modulo 3 is not 1.

    An id with several labels has the greatest; of several rows with one id, one text is taken, the same each time.
    """
    key = F.col(f"`{label_id_col}`")
    chosen = labels.filter(F.col(f"`{label_col}`").isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 3 != 1)).select(key.cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # At most max_rows rows of two numbers.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_list(batch.column(2))
        found = [sorted({i for w in set(_WORDS(t.lower())) for i in term_ids(w)}) for t in texts]
        mark = [(zlib.crc32(t.encode()) << 31) | (len(t) & 0x7FFFFFFF) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mark, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["id", "label", "mark", "terms"])

    # One row for each id, however many rows have it.
    mapped = map_rows(rows, ["id", "label", "text"], run, "id long, label int, mark long, terms array<int>")
    got = mapped.groupBy("id").agg(F.first("label").alias("label"), F.min_by("terms", "mark").alias("terms")).toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    terms = [np.asarray(got["terms"][int(i)].values.to_numpy(zero_copy_only=False), np.int64) for i in order]
    return train(terms, got["label"].to_numpy()[order].astype(np.float64))


class Scorer:
    """A machine with a bounded cache of each word's kept terms."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {t: i for i, t in enumerate(machine.ids.tolist())}
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, texts: list[str]) -> np.ndarray:
        rows, place, words = [], self.place, self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        for t in texts:
            terms: set[int] = set()
            for w in set(_WORDS(t.lower())):
                found = words.get(w)
                if found is None:
                    found = tuple(place[i] for i in term_ids(w) if i in place)
                    if len(w) <= CACHE_CHARS:
                        words[w] = found
                if found:
                    terms.update(found)
            rows.append(sorted(terms))
        return self.machine.score(rows)


def _scorer(machine: Machine) -> Scorer:
    """The worker's own scorer of this machine."""
    return worker_state(("toxicity", machine.weight.tobytes(), machine.bias), lambda: Scorer(machine))


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = _scorer(machine).score(text_list(batch.column(1)))
        held = pa.array([held_out(i) for i in batch.column(0).to_pylist()], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, held_out boolean, score double, predicted int", keeps=True)
