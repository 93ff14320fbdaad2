"""Token ids of whole texts, word by word, as the tokenizers library gives them.

The vocabulary's pre-tokenizer never lets a token reach over white space, nor from a
letter to a mark behind it (but for apostrophes); so a text's ids are those of the
pieces between such borders one after another. A worker knows the ids of the pieces
it met last by their hashes, in bounded arrays; new ones go to the library. '<' and
'|' make no border: special strings go to the library as they are.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from . import common as C

END_ID = 2
_letters = re.compile(rb"[a-z]+")
#: Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ...
_shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_hidden = [b for b in range(256) if b not in set(_shown)]
_byte_chars = {b: chr(b) for b in _shown} | {b: chr(256 + k) for k, b in enumerate(_hidden)}
_byte_table = [_byte_chars[b] for b in range(256)]
_letter = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_mark = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in "'<|" for b in range(256)])


def behind_letters(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Whether a border lies between two bytes: a letter, then a mark."""
    return _letter[before] & _mark[byte]


class Encoder:
    def __init__(self, path: str, most: int = C.CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.known = C.Known(lambda pieces: list(map(self.ids, pieces)), np.uint16, most)

    def ids(self, piece: bytes) -> list[int]:
        if _letters.fullmatch(piece):
            return [t.id for t in self.model.tokenize(piece.decode())]
        word = piece.decode()
        if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):  # one pre-token as it is
            return [t.id for t in self.model.tokenize("".join([_byte_table[b] for b in piece]))]
        return self.tok.encode(word, add_special_tokens=False).ids

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id behind it; ids of each text."""
        # lower-casing first is the same, but for marks that join with a letter and for the special tokens
        lowered = [t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower() for t in (t or b"" for t in texts)]
        words = C.Words(lowered, behind_letters)
        flat, size = self.known.spread(self.known.rows(words))
        n = np.diff(np.concatenate([[0], np.cumsum(size)])[words.ends()])
        out = np.empty(len(flat) + len(texts), np.uint16)
        end = np.cumsum(n + 1) - 1
        body = np.ones(len(out), bool)
        body[end] = False
        out[end] = END_ID
        out[body] = flat
        return out, n + 1


def worker_encoder(path: str) -> Encoder:
    return C.held(("encoder", path), lambda: Encoder(path))
