"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both supported kinds of vocabulary part a text into words before they merge
anything, so the ids of a text are those of its words in order.  A word that is
not yet known goes to the library; so does, whole, a text that this module
cannot part with certainty.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: White space to str.split() or to the library's regular expressions alone.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "᠎")
_RUNS = re.compile(r"\S+|\s+")
#: Words remembered of each kind: about 200 bytes each.
KNOWN = 1_200_000
#: The parts of a lower-case ASCII word by the pattern of the vocabulary whose words stand alone.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: visible Latin-1 as itself, the others from U+0100 on in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = (b for b in range(256) if b not in set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Known(dict):
    """Word to ids as little-endian unsigned 32-bit integers; ``before`` is put in front of the word, ``fold`` lower-cases it.

    A word of Latin letters alone is one piece to every step before the merges,
    so it goes to the library's model directly; a final stop or comma parts off.
    """

    def __init__(self, library, before: str, fold: bool, most: int, marks: dict | None = None) -> None:
        super().__init__()
        self.most = most
        self.library, self.model, self.before, self.fold = library, library.model, before, fold
        self.marks = self if marks is None else marks
        self.mark = before.encode().decode("latin-1").translate(_LETTERS)

    def __missing__(self, word: str) -> bytes:
        if self.fold and "\u0130" in word:  # its lower case is two characters, the second of which is no letter
            ids = self.library.encode(word, add_special_tokens=False).ids
        elif word.isascii() and word.isalpha():  # the letters stand for themselves
            ids = [t.id for t in self.model.tokenize(self.mark + (word.lower() if self.fold else word))]
        elif word.isalpha() and max(word) < "\u0250":
            letters = (self.before + (word.lower() if self.fold else word)).encode().decode("latin-1").translate(_LETTERS)
            ids = [t.id for t in self.model.tokenize(letters)]
        elif len(word) > 1 and word[-1] in ".," and (stem := word[:-1]).isalpha():
            return self[stem] + self.marks[word[-1]]
        elif self.fold and word.isascii() and len(parts := _PARTS.findall(word.lower())) > 1:
            ids = np.frombuffer(b"".join(map(self.__getitem__, parts)), dtype="<u4")
        else:
            ids = self.library.encode(self.before + word, add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(self) < self.most:  # the first words met are the frequent ones
            self[word] = packed
        return packed


def _folded(text: str) -> str:
    """Lower case where that is the library's, character by character: in Latin-1.  So a word has one entry, however it is written."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """``encode(text)``: its ids as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str, known: int = KNOWN) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre, normal = config["pre_tokenizer"] or {}, config["normalizer"]
        steps = [p.get("type") for p in pre.get("pretokenizers", [])]
        #: Words with their leading space, white space kept; or words alone, white space dropped.
        self.spaced = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and normal is None
        self.bare = [n.get("type") for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed"
        self.plain = _Known(self.library, "", self.bare, known)
        self.after_space = _Known(self.library, " ", self.bare, known, self.plain)

    def encode(self, text: str) -> bytes:
        if (self.bare or self.spaced) and not any(c in text for c in _ODD):
            if self.bare:
                return b"".join(map(self.plain.__getitem__, _folded(text).split()))
            words = text.split()
            gaps = len(words) - 1
            if len("".join(words)) + gaps == len(text) and text.count(" ") + text.count("\n") == gaps:
                return self._lines(text)
            return self._any_space(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _lines(self, text: str) -> bytes:
        """White space is single spaces, which go with the word after them, and single line ends, which stand alone."""
        plain, spaced, out = self.plain, self.after_space.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(plain[first] + b"".join(map(spaced, rest)))
        return plain["\n"].join(out)

    def _any_space(self, text: str) -> bytes:
        """Of white space before a word the last character is parted off; a space then goes with the word."""
        runs, out, known = _RUNS.findall(text), [], self.plain
        for k, run in enumerate(runs):
            if not run[0].isspace():
                out.append(known[run])
                known = self.plain
            elif k == len(runs) - 1:
                out.append(self.plain[run])
            else:
                if len(run) > 1:
                    out.append(self.plain[run[:-1]])
                if run[-1] == " ":
                    known = self.after_space
                else:
                    out.append(self.plain[run[-1]])
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, known: int = KNOWN) -> Encoder:
    """One encoder for each worker process, which remembers ``known`` words of each kind."""
    return Encoder(path, known)
