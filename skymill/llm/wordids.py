"""Whole-text encoding with the tokenizers library, with bounded caches of words and of their pieces.

The vocabulary drops white space, so no token spans ASCII white space and each run of other characters can be
encoded by itself. Words of printable ASCII and accented Latin-1 letters are lower-cased and split here, by the rules
that the model file states, and only their pieces go to the library's model; all other words go through the whole library.
Ids are little-endian, two bytes each where the vocabulary has at most 65,536 entries, else four.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

from .bpe import to_piece
from .common import CACHE_CHARS, CACHE_WORDS, worker_state

#: The normaliser and splitting pattern of the model files that the short way stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


class WordEncoder(dict):
    """A dictionary from words (bytes) to packed ids that fills itself."""

    def __init__(self, model_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(model_json)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        spec = json.loads(model_json)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.short_way = spec.get("normalizer") == NORMALIZER and (splits[0].get("pattern") or {}).get("Regex") == PATTERN
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces: dict[str, bytes] = {}
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.tokenize = self.tokenizer.model.tokenize

    def piece(self, p: str) -> bytes:
        """Packed ids of one piece, by the library's model."""
        ids = self.pieces.get(p)
        if ids is None:
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.tokenize(p if p.isascii() else to_piece(p.encode()))])
            if len(p) <= CACHE_CHARS:
                if len(self.pieces) >= 2 * CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[p] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.short_way and word.isalpha():
            got = self.piece(text.lower())
        elif self.short_way and _SIMPLE(text) and not ("<|" in text and any(s in text for s in self.special)):
            got = b"".join([self.piece(p) for p in _PIECES(text.lower())])
        else:
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= 3 * CACHE_WORDS:
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        return b"".join(map(self.__getitem__, text.encode().split()))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def word_encoder(model_json: str) -> WordEncoder:
    """The worker's own encoder."""
    return worker_state(("words", hash(model_json)), lambda: WordEncoder(model_json))
