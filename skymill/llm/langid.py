"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes, lower-cased and nothing left out, forwards and backwards, and gives every position a
distribution over the languages; a document's log probabilities are pooled over all its positions. It is trained in numpy
by backpropagation through time, on windows of a bounded sample of documents.

Beside the languages the network learns what is in none of them: training texts with their letters shuffled or exchanged for
others of their kind, encoded bytes, and characters of other scripts. `keep_known` rejects a document where that is
likelier, over all its positions, than all languages together.

Texts are read in windows of WINDOW bytes with MARGIN more on either side where the text goes on; each position is
labelled once, in the window that holds it with its context. So a text of any length takes bounded memory, and windows of
many texts are read side by side.

A null text, or one without any letter, is `und` with score 0. Equal texts get equal results; rows without an id are
identified like any other. With no usable training rows every text is `und`. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_rows, map_rows, stage_table, text_list, worker_state

UND = "und"
#: Training documents for each language, and the characters that are drawn from longer texts among them.
DOCS_PER_LANG = 300
MAX_TRAIN_CHARS = 20_000
#: With more languages fewer characters of a text and more steps are taken, and fewer windows are read at once: all languages are learned within the same memory.
MANY_LANGS = 64
#: Longer runs without white space are drawn in parts.
RUN_CHARS = 1000
#: Bytes that a window labels, and bytes of context on either side; windows that are read side by side.
WINDOW, MARGIN = 320, 16
READ_AT_ONCE = 1024
UNITS, EMBED = 16, 12
#: Windows of a training step, and their bytes.
STEPS, BATCH, TRAIN_BYTES, RATE = 600, 96, 80, 0.01
#: Share of training windows that are in no language, and their characters in all.
OTHER_SHARE, OTHER_CHARS = 0.2, 1 << 20
#: keep_known rejects a document whose positions are in a learned language with a smaller mean probability, whichever language.
MIN_KNOWN = 0.5
#: First characters of blocks of several scripts.
BLOCKS = (0x100, 0x370, 0x400, 0x5D0, 0x620, 0x900, 0x3040, 0x4E00, 0xAC00)


def in_no_language(texts: list[str], seed: int, chars: int = OTHER_CHARS) -> bytes:
    """Passages that are shaped like the texts but in no language, encoded data, and characters of many scripts."""
    rng, out, size = np.random.default_rng(seed), [], 0
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vowels, others = list("aeiouy"), list("bcdfghjklmnpqrstvwxz")

    def exchanged(part: str, *kinds: list[str]) -> str:
        table = {}
        for kind in kinds:
            table |= dict(zip(kind, np.array(kind)[rng.permutation(len(kind))].tolist(), strict=True))
        return part.translate(str.maketrans(table))

    while size < chars:
        text = texts[rng.integers(len(texts))]
        at = rng.integers(max(1, len(text) - 200))
        part = text[at : at + 200]
        made = (
            "".join(np.array(list(part))[rng.permutation(len(part))].tolist()),
            exchanged(part, letters),
            exchanged(part, vowels, others),
            base64.b64encode(rng.bytes(120)).decode().lower(),
            rng.bytes(80).hex(),
            "".join(np.where(rng.random(100) < 0.15, " ", np.array([chr(c) for c in BLOCKS[rng.integers(len(BLOCKS))] + rng.integers(0, 80, 100)])).tolist()),
        )
        out += made
        size += sum(map(len, made))
    return "\n".join(out).encode()


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many bytes that follow each other: each window's text, first byte and length, and the first and last + 1 place in it that it labels."""
    n = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), n)
    core = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    size = lengths[text]
    first = np.maximum(core - MARGIN, 0)
    last = np.minimum(core + WINDOW + MARGIN, size)
    offset = (np.cumsum(lengths) - lengths)[text]
    return text, offset + first, last - first, core - first, np.minimum(core + WINDOW, size) - first


@dataclass
class Network:
    """Weights: embedding e; for each gate (z: update, r: reset, c: candidate) and direction (f, b) input x, recurrent u and bias v; output o; and bias.

    The gates are logistic, written by the hyperbolic tangent: z = (1 + tanh) / 2, and r = 1 + tanh, its half being in u.
    Outputs are the languages and, if the network has learned it, one more for what is in none.
    """

    langs: list[str]
    w: dict[str, np.ndarray]

    @property
    def outputs(self) -> int:
        return len(self.w["bias"])

    @staticmethod
    def fresh(langs: list[str], seed: int = 7, other: bool = False) -> Network:
        rng, outputs = np.random.default_rng(seed), len(langs) + other

        def draw(a: int, b: int, scale: float = 1.0) -> np.ndarray:
            return (scale * rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        w = {"e": draw(256, EMBED, 16.0), "bias": np.zeros(outputs, np.float32)}
        for d in "fb":
            w[f"o{d}"] = draw(UNITS, outputs)
            for g in "zrc":
                w |= {f"x{g}{d}": draw(EMBED, UNITS, 0.5), f"u{g}{d}": draw(UNITS, UNITS, 0.5), f"v{g}{d}": np.zeros(UNITS, np.float32)}
        return Network(langs, w)

    def run(self, data: np.ndarray, going: list[int], d: str, kept: list | None = None) -> np.ndarray:
        """What one direction's states add to the languages' scores at each place (place, window, language).

        data: bytes (place, window), the longest window first; going: how many windows have each place. kept: takes what the gradient needs.
        """
        w = self.w
        tz, tr, tc = (w["e"] @ w[f"x{g}{d}"] + w[f"v{g}{d}"] for g in "zrc")
        uz, ur, uc = (w[f"u{g}{d}"] for g in "zrc")
        width, n = data.shape
        h = np.zeros((n, UNITS), uz.dtype)
        buffers = [np.empty_like(h) for _ in range(4)]
        out = np.zeros((width, n, self.outputs), uz.dtype)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            m, at = going[t], data[t, : going[t]]
            x, z, r, c = (b[:m] for b in buffers)
            now = h[:m]
            for gate, u, table in ((z, uz, tz), (r, ur, tr)):
                np.matmul(now, u, out=gate)
                gate += table.take(at, 0, x, "clip")
                np.tanh(gate, out=gate)
            np.matmul(now, uc, out=c)
            if kept is not None:
                before = (now.copy(), z.copy(), r.copy(), c.copy())
            r += 1
            c *= r
            c += tc.take(at, 0, x, "clip")
            np.tanh(c, out=c)
            if kept is not None:
                kept.append((t, *before, c.copy()))
            z += 1
            z *= 0.5
            c -= now
            c *= z
            now += c
            np.matmul(now, w[f"o{d}"], out=out[t, :m])
        return out

    def read(self, data: np.ndarray, going: list[int], d: str, y: np.ndarray) -> None:
        """Add to y (place, output, window) what run tells, for labelling alone.

        The gates are written by e = exp(-2 a) in place of tanh(a), which takes numpy twice as long: z = 1 / (1 + e), 1 + tanh = 2 / (1 + e) and
        tanh = 2 / (1 + e) - 1, where an e too large for a number is infinite and gives the limit. Factors are in the weights.
        """
        w = self.w
        tz, tr, tc = (-2 * (w["e"] @ w[f"x{g}{d}"] + w[f"v{g}{d}"]) for g in "zrc")
        uz, ur, uc = (k * w[f"u{g}{d}"] for g, k in (("z", -2), ("r", -2), ("c", -4)))
        o = np.ascontiguousarray(w[f"o{d}"].T)
        width, n = data.shape
        h = np.zeros((n, UNITS), uz.dtype)
        buffers = [np.empty_like(h) for _ in range(4)]
        told = np.empty((self.outputs, n), uz.dtype)
        with np.errstate(over="ignore"):
            for t in range(width) if d == "f" else range(width - 1, -1, -1):
                m, at = going[t], data[t, : going[t]]
                x, z, r, c = (b[:m] for b in buffers)
                now, out = h[:m], told[:, :m]
                for gate, u, table in ((z, uz, tz), (r, ur, tr)):
                    np.matmul(now, u, out=gate)
                    gate += table.take(at, 0, x, "clip")
                    np.exp(gate, out=gate)
                    gate += 1
                np.matmul(now, uc, out=c)
                c /= r
                c += tc.take(at, 0, x, "clip")
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                c -= now
                c /= z
                now += c
                y[t, :, :m] += np.matmul(o, now.T, out=out)

    def window_scores(self, data: np.ndarray, going: list[int], inside: np.ndarray) -> np.ndarray:
        """For each window, log probabilities and probabilities of the outputs summed over the places inside (window, 2 * outputs)."""
        # Windows are the last axis, so that sums and maxima over the outputs run along rows.
        y = np.empty((data.shape[0], self.outputs, data.shape[1]), self.w["bias"].dtype)
        y[:] = self.w["bias"][:, None]
        for d in "fb":
            self.read(data, going, d, y)
        y -= y.max(1, keepdims=True)
        p = np.exp(y)
        total = p.sum(1, keepdims=True)
        p /= total
        y -= np.log(total)
        return np.concatenate([np.einsum("tkn,tn->kn", x, inside) for x in (y, p)]).T

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        """For each text, log probabilities and probabilities of the outputs summed over all its bytes."""
        k = self.outputs
        held = np.frombuffer(b"".join(texts), np.uint8)
        text, first, length, low, high = windows_of(np.array([len(t) for t in texts], np.int64))
        out = np.zeros((len(texts), 2 * k))
        order = np.argsort(-length, kind="stable")
        size = max(16, READ_AT_ONCE * 4 // max(4, k))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            place = np.arange(length[part[0]])[:, None]
            data = held[np.minimum(first[part] + place, len(held) - 1)].astype(np.intp)
            going = (length[part] > place).sum(1).tolist()
            inside = ((place >= low[part]) & (place < high[part])).astype(np.float32)
            np.add.at(out, text[part], self.window_scores(data, going, inside))
        return out

    def gradient(self, data: np.ndarray, lang: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all places of windows of one length and its gradient, by backpropagation through time."""
        w, (width, n) = self.w, data.shape
        kept: dict[str, list] = {"f": [], "b": []}
        y = sum(self.run(data, [n] * width, d, kept[d]) for d in "fb") + w["bias"]
        y -= y.max(2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(2, keepdims=True)
        rows = np.arange(n)
        loss = float(-np.log(np.maximum(p[:, rows, lang], 1e-9)).mean())
        dy = p
        dy[:, rows, lang] -= 1
        dy /= width * n
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["bias"] = dy.sum((0, 1))
        for d in "fb":
            uz, ur, uc = (w[f"u{k}{d}"] for k in "zrc")
            dh = np.zeros((n, UNITS), uz.dtype)
            tables = {k: np.zeros((256, UNITS), uz.dtype) for k in "zrc"}
            for t, h, tz, tr, m, c in reversed(kept[d]):
                z = 0.5 * (1 + tz)
                g[f"o{d}"] += (h + z * (c - h)).T @ dy[t]
                dh = dh + dy[t] @ w[f"o{d}"].T
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * 0.5 * (1 - tz * tz)
                dr = dc * m * (1 - tr * tr)
                dm = dc * (1 + tr)
                for k, own, recurrent in (("z", dz, dz), ("r", dr, dr), ("c", dc, dm)):
                    np.add.at(tables[k], data[t], own)
                    g[f"u{k}{d}"] += h.T @ recurrent
                dh = dh * (1 - z) + dz @ uz.T + dr @ ur.T + dm @ uc.T
            for k, table in tables.items():
                g[f"v{k}{d}"] = table.sum(0)
                g[f"x{k}{d}"] = w["e"].T @ table
                g["e"] += table @ w[f"x{k}{d}"].T
        return loss, g


def train(texts: list[list[bytes]], langs: list[str], steps: int = STEPS, seed: int = 7, other: bytes = b"") -> Network:
    """Fit by Adam on batches with as many windows of each language, and OTHER_SHARE of other. texts: for each language its documents' bytes."""
    net, rng = Network.fresh(langs, seed, bool(other)), np.random.default_rng(seed)
    # Documents of a language are read one after the other, repeated if they are shorter than a window.
    own = [b"\n".join(t) + b"\n" for t in texts] + [other] * bool(other)
    own = [np.frombuffer(t * -(-TRAIN_BYTES // len(t)), np.uint8) for t in own]
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        lang = rng.integers(0, len(langs), BATCH)
        if other:
            lang[rng.random(BATCH) < OTHER_SHARE] = len(langs)
        at = [rng.integers(len(own[k]) - TRAIN_BYTES + 1) for k in lang]
        data = np.stack([own[k][i : i + TRAIN_BYTES] for k, i in zip(lang, at, strict=True)], axis=1).astype(np.intp)
        _, g = net.gradient(data, lang)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def drawn_text(text: str, chars: int, seed: int) -> str:
    """The text, or if it is longer than about so many characters as many of words drawn from all of it."""
    if len(text) <= chars:
        return text
    runs = [w[i : i + RUN_CHARS] for w in text.split() for i in range(0, len(w), RUN_CHARS)]
    out, left = [], chars
    for i in np.random.default_rng(seed).permutation(len(runs)).tolist():
        if left <= 0:
            break
        out.append(i)
        left -= len(runs[i]) + 1
    return " ".join(runs[i] for i in sorted(out))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """(lang, row, id, text): of each language the first docs_per_lang documents by a hash of id and text; equal ones count once.

    Only rows with an id whose crc32 modulo 3 is not 1, a language and a text with a letter count, so every language that has one such
    row is there. Documents are chosen by their hashes alone; each task passes on at most docs_per_lang of a language, and texts are read again for
    those that were chosen.
    """
    key, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    rows = docs.filter(key.isNotNull() & (F.crc32(key.cast("binary")) % 3 != 1) & F.col(f"`{lang_col}`").isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(key, text).alias("row"), key.alias("id"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("row"))
    chosen = stage_table(rows.select("lang", "row", place.alias("place")).filter(F.col("place") <= docs_per_lang).select("lang", "row").distinct(), "chosen", narrow=True)
    return rows.join(chosen, ["lang", "row"]).dropDuplicates(["lang", "row"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, steps: int = STEPS) -> Network:
    """Train on a bounded sample, docs_per_lang documents of each language (training_rows). Of long texts, words from the whole text are drawn."""
    sample = stage_table(training_rows(docs, id_col, text_col, lang_col, docs_per_lang), "sample", narrow=True)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return Network.fresh([UND])
    chars = max(1, MAX_TRAIN_CHARS * MANY_LANGS // max(MANY_LANGS, len(langs)))

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [drawn_text(t, chars, zlib.crc32(i.encode())) for i, t in zip(batch.column(0).to_pylist(), text_list(batch.column(3)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["lang", "row", "text"])

    short = map_rows(sample, ["id", "lang", "row", "text"], shorten, "lang string, row long, text string")
    texts: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in short.orderBy("lang", "row").collect():
        texts[r["lang"]].append(r["text"].lower())
    other = in_no_language([t for lang in langs for t in texts[lang]], len(langs))
    return train([[t.encode() for t in texts[lang]] for lang in langs], langs, steps * -(-len(langs) // MANY_LANGS), other=other)


class Scorer:
    """What a network says of texts."""

    def __init__(self, net: Network):
        self.net, self.k = net, net.outputs

    def pooled(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Which texts have a letter, and what the network sums over their positions."""
        told = [] if self.net.langs == [UND] else [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        return told, self.net.text_scores([texts[i].lower().encode() for i in told]) if told else np.zeros((0, 2 * self.k))

    def known(self, texts: list[str]) -> list[float]:
        """The mean probability that a text's positions are in any learned language; 0 where it has no letter."""
        out = [0.0] * len(texts)
        told, pooled = self.pooled(texts)
        share = pooled[:, self.k : self.k + len(self.net.langs)].sum(1) / np.maximum(pooled[:, self.k :].sum(1), 1e-30)
        for i, known in zip(told, share.tolist(), strict=True):
            out[i] = min(1.0, known)
        return out

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the mean probability that its positions give the pooled choice."""
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        told, pooled = self.pooled(texts)
        for i, row, best in zip(told, pooled, pooled[:, : len(self.net.langs)].argmax(1).tolist(), strict=True):
            langs[i] = self.net.langs[best]
            scores[i] = round(float(min(1.0, row[self.k + best] / row[self.k :].sum())), 6)
        return langs, scores


def _scorer(net: Network) -> Scorer:
    """The worker's own scorer of this network."""
    return worker_state(("langid", net.w["of"].tobytes(), tuple(net.langs)), lambda: Scorer(net))


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _scorer(net).score(text_list(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, held_out boolean, lang_pred string, score double", keeps=True)


def keep_known(docs: DataFrame, net: Network, text_col: str = "text", min_known: float = MIN_KNOWN) -> DataFrame:
    """The documents, with all columns, whose positions are in learned languages, whichever, with a mean probability of at least min_known.

    Mixed texts stay; noise, encoded data, other languages and texts without a letter go.
    """

    def keep(texts: list[str]) -> list[bool]:
        return [k > 0 and k >= min_known for k in _scorer(net).known(texts)]

    return filter_rows(docs, text_col, keep, keeps=True)
