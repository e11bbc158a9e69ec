"""Token ids of whole texts by a byte-level vocabulary of the tokenizers library, with words remembered.

The pattern of such a vocabulary always cuts before a lone space or a line break between other characters,
so the ids of a text are those of its words, each with the space before it. Most words come again: their ids
are looked up. Texts with other runs of white space go to the tokenizer as a whole.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache
from string import punctuation

import numpy as np

#: Words a worker remembers. When half of them are new, the older half goes, but for what was met again since.
REMEMBERED = 600_000
#: The pattern parts letters from a run of these behind them, and leaves the run whole.
_ENDS = punctuation
#: Longer words are encoded each time they come.
_LONGEST = 64


class _Odd(Exception):
    """White space that a cut at spaces could part."""


class _Words(dict):
    """Word to the bytes of its ids as 16-bit numbers; a word that begins with a line break has no space before it."""

    def __init__(self, tokenizer, most: int | None = None):
        self.most = max(1, (most or REMEMBERED) // 2)
        self.older: dict[str, bytes] = {}
        model, letters = tokenizer.model, _byte_letters()
        spelled = {c: "".join(chr(letters.get(b, b)) for b in chr(c).encode()) for c in range(0x250)}
        space = spelled[0x20]
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.ends: dict[str, bytes] = {}

        def one(piece: str) -> bytes:
            """Ids of a text below "ɐ" that the pattern doesn't cut."""
            return array("H", [t.id for t in model.tokenize(piece.translate(spelled))]).tobytes()

        def spaced(word: str) -> bytes:
            """The same for an ASCII word, with a space before it."""
            return array("H", [t.id for t in model.tokenize(space + word)]).tobytes()

        self.one, self.spaced, self.line = one, spaced, one("\n")

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            core = word.rstrip(_ENDS)
            if core.isalpha() and (core.isascii() or max(core) < "ɐ"):
                if len(core) < len(word):
                    found = self[core] + self.end(word[len(core) :])
                elif core.isascii():
                    found = self.spaced(core)
                else:
                    found = self.one(" " + core)
            else:
                rest = word[1:] if word[:1] == "\n" else word
                if not rest or rest[0].isspace() or rest[-1].isspace():
                    raise _Odd
                found = self.line + self.bare(rest) if rest is not word else self.bare(" " + word)
        if len(word) > _LONGEST:
            return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def end(self, marks: str) -> bytes:
        if marks not in self.ends:
            if len(self.ends) >= self.most:
                self.ends.clear()
            self.ends[marks] = self.one(marks)
        return self.ends[marks]

    def bare(self, text: str) -> bytes:
        """Ids of a text as it is, without a space before it."""
        core = text.rstrip(_ENDS)
        if core.isalpha() and (core.isascii() or max(core) < "ɐ"):
            return self.one(core) + (self.end(text[len(core) :]) if len(core) < len(text) else b"")
        return array("H", self.encode(text)).tobytes()


class Encoder:
    """Texts to ids as with ``add_special_tokens=False``; special strings in a text are ordinary text."""

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.size = tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.vocabulary = tokenizer.get_vocab
        self.words = _Words(tokenizer, most)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u2")
        words = text.replace("\n", " \n").split(" ")
        try:
            if not words[0] or words[0].isspace() or text[0].isspace() or words[0][-1].isspace():
                raise _Odd
            found = self.words.bare(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
            return np.frombuffer(found, dtype="=u2")
        except _Odd:
            return np.array(self.words.encode(text), dtype="=u2")


def _byte_letters() -> dict[int, int]:
    """Byte to the character that stands for it in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + n for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str, most: int | None = None) -> Encoder:
    """The encoder of this Python worker, with what it remembers from earlier tasks."""
    return Encoder(path, most)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
