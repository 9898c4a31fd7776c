"""Exact token ids of whole texts, with a memo of the chunks between white space.

Both vocabularies split a text before they merge bytes, and no merge crosses from one chunk between white space to the
next, so the ids of a text are the ids of its chunks one after another. Chunks of Latin letters, with a full stop or
comma behind or not, go to the tokenizers library's merge model directly; all other chunks go through the whole
tokenizer. A text that holds an added token's string, or one of the separators U+001C-U+001F (white space to Python,
not to the tokenizers library), is encoded as a whole.
"""

from __future__ import annotations

import re
import string
from array import array

import public_tokenizers

#: White space as the tokenizers library's regular expressions have it (Unicode White_Space).
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BYTE_CHUNKS = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: With none of these inside, a text is lines of words with one space between.
UNEVEN = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
MARKS = string.punctuation
LONG = 64  # longer chunks are encoded each time, so that the memo's memory stays bounded
LATIN_END = "ɐ"

_ENCODERS: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: 256 + k for k, b in enumerate(rest)}


class Chunks(dict):
    """chunk -> ids; holds the chunks of late and, one generation back, those of before."""

    def __init__(self, encoder: "Encoder", prefix: str, limit: int):
        super().__init__()
        self.encoder, self.prefix, self.limit, self.old = encoder, prefix, limit, {}
        self.stand_in = byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.compute(chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def compute(self, chunk: str) -> bytes:
        e = self.encoder
        if chunk.isalpha():
            word = chunk.lower() if e.lower else chunk
            if word.isascii():
                return array("I", [t.id for t in e.merge("Ġ" + word if self.prefix else word)]).tobytes()
            if max(chunk) < LATIN_END and "İ" not in chunk:
                word = (self.prefix + word).encode().decode("latin-1").translate(self.stand_in)
                return array("I", [t.id for t in e.merge(word)]).tobytes()
        elif (word := chunk.rstrip(MARKS)).isalpha() and max(word) < LATIN_END and "İ" not in word:
            return self[word] + e.bare[chunk[len(word) :]]
        return e.whole(self.prefix + chunk)


class Encoder:
    def __init__(self, name: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.lower = name.startswith("word")
        self.merge = self.tokenizer.model.tokenize
        self.bare = Chunks(self, "", limit)
        self.spaced = None if self.lower else Chunks(self, " ", limit)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def one(self, text: str) -> bytes:
        if any(c in text for c in ODD):
            return self.whole(text)
        bare = self.bare.__getitem__
        if self.lower:
            return b"".join(map(bare, text.split()))
        if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in UNEVEN):
            return b"".join(map(bare, BYTE_CHUNKS.findall(text)))
        spaced, out = self.spaced.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(bare(words[0]) + b"".join(map(spaced, words[1:])))
        return bare("\n").join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        return [self.one(t) if t else b"" for t in texts]


def encoder(name: str) -> Encoder:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
