"""Token ids of texts with a given tokenizer file.

The tokenizers library splits a text into pretokens and merges each on its own, so a pretoken's
ids don't depend on its neighbours. Most pretokens of a text have been seen before: ids are kept by
pretoken in a bounded table that lives as long as a task, and only new ones are merged by the library's
model. A text whose characters are all below ``HIGH`` is split by the same pattern that the files name,
written out for those characters; in any other text the words with a higher character go through
the library as they are. Strings of the file's own special tokens count as the library counts them."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import public_tokenizers

from cohortlens.llm.common import single_threaded

#: Pretokens kept in a task's table; a full table is emptied.
TABLE = 300_000
#: Characters below this are the same kind (letter, number, space) in every version of Unicode.
HIGH = "ɐ"
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_HIGH = re.compile(f"[{HIGH}-\U0010ffff]")
#: Byte-level files keep white space: one space belongs to the pretoken after it.
_KEEPS = re.compile(
    f" ?[{_LETTER}]+| ?[{_NUMBER}]+|{_SHORT}| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Files with word ends drop it and take numbers one by one.
_DROPS = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|{_SHORT}|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Words and the white space between them, split where both kinds of files always split.
_WORDS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RUNS = re.compile(f"[^{_SPACE}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level files write bytes as letters: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


@cache
def library(path: str, plain_specials: bool = False):
    """The library's tokenizer, one per Python worker and file. plain_specials: the strings of special
    tokens are ordinary text."""
    single_threaded()
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain_specials
    return made


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, drops_space: bool, plain_specials: bool = False):
        """drops_space: the file drops white space and lower-cases; else the space before a word
        belongs to its first pretoken."""
        self.whole = library(path, plain_specials)
        self.model = self.whole.model
        self.drops_space = drops_space
        self.pattern = _DROPS if drops_space else _KEEPS
        # every special token's string holds one of these: such texts are left to the library
        self.marks = [] if plain_specials else sorted({t.content[:2] for t in self.whole.get_added_tokens_decoder().values()})
        self.known: dict[str, bytes] = {}

    def _through_library(self, piece: str) -> bytes:
        return np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _pretoken(self, piece: str) -> bytes:
        # ASCII but for white space and controls is spelt as itself
        spelt = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
        return array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()

    def _joined(self, pieces: list[str], make) -> bytes:
        """The ids of pieces after each other; make(piece) for those not in the table."""
        found = list(map(self.known.get, pieces))
        if None in found:
            for i, made in enumerate(found):
                if made is None:
                    made = self.known.get(pieces[i])
                    if made is None:
                        if len(self.known) >= TABLE:
                            self.known.clear()
                        made = self.known[pieces[i]] = make(pieces[i])
                    found[i] = made
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        if _HIGH.search(word) or (self.drops_space and _HIGH.search(word.lower())):
            return self._through_library(word)
        return b"".join(map(self._pretoken, self.pattern.findall(word.lower() if self.drops_space else word)))

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.marks):
            return self._through_library(text)
        if self.drops_space:
            # characters that compose stay beside each other; lower-casing may make one that doesn't
            seen = unicodedata.normalize("NFC", text)
            lower = seen.lower()
            if _HIGH.search(lower):
                return self._joined(_RUNS.findall(seen), self._word)
            return self._joined(self.pattern.findall(lower), self._pretoken)
        if _HIGH.search(text):
            return self._joined(_WORDS.findall(text), self._word)
        return self._joined(self.pattern.findall(text), self._pretoken)


def encoder(path: str, drops_space: bool, plain_specials: bool = False) -> Encoder:
    """For one task: its table goes when the task ends."""
    return Encoder(path, drops_space, plain_specials)


def path_of(name: str) -> str:
    return public_tokenizers.path(name)
