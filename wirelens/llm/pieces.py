"""Splitting text as the two tokenizer files do, before any merge.

Texts whose characters are all in `COMMON` are split by patterns of the standard library, with letter,
number and space classes written out; this is several times faster. Other texts are split by the
tokenizers library itself, whose Unicode tables then decide.
"""

from __future__ import annotations

import re
import unicodedata

from tokenizers import Tokenizer

#: Latin, and the punctuation most prose uses.
COMMON = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC, 0x2122]
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]


def _class(points) -> str:
    """The inside of a character class."""
    out, points = [], sorted(points)
    while points:
        n = 1
        while n < len(points) and points[n] == points[0] + n:
            n += 1
        first, last = (f"\\U{p:08x}" for p in (points[0], points[n - 1]))
        out.append(first if n == 1 else f"{first}-{last}")
        points = points[n:]
    return "".join(out)


_of = {kind: [p for p in COMMON if unicodedata.category(chr(p))[0] == kind] for kind in "LN"}
L, N, S = _class(_of["L"]), _class(_of["N"]), _class(SPACES)
RARE = re.compile(f"[^{_class(COMMON)}]")

# The splitting patterns of the two files.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(f"{ENDINGS}| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
WORD_LEVEL = re.compile(f"{ENDINGS}|[{L}]+|[{N}]|[^{S}{L}{N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(tokenizer: Tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def _around(names) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None


class Splitter:
    """Pieces of a text; strings of special tokens are pieces of their own.

    Callers cut a text at its spaces first, which is much faster than the patterns; what stands between
    spaces is split once and remembered. `mark` goes in front of a text's first such word.
    """

    mark = ""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.special = specials(tokenizer)
        self.around = _around(self.special)
        self.marks = {name[:2] for name in self.special}

    def split(self, text: str) -> list[str]:
        if any(mark in text for mark in self.marks):
            out = []
            for part in self.around.split(text):
                out += [part] if part in self.special else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        raise NotImplementedError


class ByteSplitter(Splitter):
    """Pieces as they stand in the text. A piece may begin with the space in front of it.

    Among words between spaces, the text's first is marked by a space. A word that is empty, or begins or ends with
    white space, says that the text has several spaces in a row; such a text is split as a whole, into
    pieces marked by two spaces.
    """

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not RARE.search(text):
            return BYTE_LEVEL.findall(text)
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cuts]

    mark = " "

    def whole(self, text: str) -> list[str]:
        return ["  " + piece for piece in self.split(text)]

    def pieces_of(self, word: str) -> list[str] | None:
        """The pieces that stand for a word between spaces or one of `whole`; None for a word that can't stand alone."""
        if word.startswith("  "):
            return [word[2:]]
        first = word.startswith(" ")
        bare = word[1:] if first else word
        if first and bare == "":
            return []
        if bare == "" or bare[0].isspace() or bare[-1].isspace():
            return None
        return self.split(bare if first else " " + bare)


class WordSplitter(Splitter):
    """Lower-cased words; white space goes. Composed and lower-cased as the file asks.

    No piece holds a space, and neither composing nor lower-casing looks across one.
    """

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not RARE.search(text):
            low = text.lower()
            if low.isascii() or not RARE.search(low):
                return WORD_LEVEL.findall(low)
        low = self.tokenizer.normalizer.normalize_str(text)
        return [low[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)]
