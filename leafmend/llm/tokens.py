"""Token ids of whole texts by a public tokenizer, word by word.

The tokenizer never joins text across ASCII white space, so the ids of a text
are those of its words in a row. A bounded cache holds the words' ids as
little-endian 16- or 32-bit numbers; a missing plain word goes straight to the
library's BPE model, any other word through the whole tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Words, and runs of letters or signs, whose ids a worker holds in each of two generations, and the greatest length in bytes of either.
WORDS, RUNS, LONGEST = 200_000, 200_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes as: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: ASCII signs that the tokenizer keeps together after a run of letters; the apostrophe and the signs of special tokens aren't among them.
_SIGNS = b".,;:!?#*$%&()-"


class Encoder(dict):
    """UTF-8 word -> bytes of its ids. A dict, so that known words cost one look-up."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        if hasattr(self.model, "_resize_cache"):  # the model's own cache costs more than it saves behind ours
            self.model._resize_cache(0)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.runs: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}
        # The short way holds for one kind of tokenizer only: lower case, runs of letters apart from runs of signs.
        sample = "Straße naïve. the THE, Ångström éÉ** stop-"
        self.short = all(self._plain(w) == self._whole(w) for w in sample.encode().split())

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _run(self, run: bytes) -> bytes:
        """The ids of a run; runs seen lately are kept when a generation is full."""
        out = self.runs.get(run)
        if out is None:
            out = self.older.get(run)
            if out is None:
                text = run.decode() if run.isascii() else run.decode("latin-1").translate(self.letters)
                out = b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in self.model.tokenize(text)])
            if len(run) <= LONGEST:
                if len(self.runs) >= RUNS:
                    self.older, self.runs = self.runs, {}
                self.runs[run] = out
        return out

    def _plain(self, word: bytes) -> bytes | None:
        """The ids of letters below U+0130, with signs at most after them; None for other words."""
        run = word.rstrip(_SIGNS)
        if run.isalpha():  # of bytes, ASCII letters alone
            out = self._run(run.lower())
        else:
            text = run.decode()
            if not text.isalpha() or max(text) > "\u012f":
                return None
            out = self._run(text.lower().encode())
        return out + self._run(word[len(run) :]) if len(run) < len(word) else out

    def __missing__(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self._plain(word) if self.short else None
            if ids is None:
                ids = self._whole(word)
            if len(word) > LONGEST:
                return ids
        if len(self) >= WORDS:
            self.known = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def raw(self, text: bytes | pa.Buffer | None, end: int | None = None) -> bytes:
        """The ids of a whole UTF-8 text as little-endian numbers, with end appended; null counts as empty."""
        text = bytes(text or b"")
        if self.short and b"<|" not in text:  # which opens a special token, found before case is folded
            text = text.lower()
        words = text.split()  # of bytes, lower() and split() know just ASCII letters and the six ASCII characters
        tail = () if end is None else (end.to_bytes(self.dtype.itemsize, "little"),)
        return b"".join([*map(self.__getitem__, words), *tail])

    def ids(self, text: bytes | None, end: int | None = None) -> np.ndarray:
        """raw() as an array."""
        return np.frombuffer(self.raw(text, end), self.dtype)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)
