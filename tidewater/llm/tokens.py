"""Token ids of whole texts by a public tokenizer, remembering the ids of each distinct unit of text.

A unit is a piece of text whose ids do not depend on its neighbours: for the byte-level vocabulary a word
with the single space before it, or a line feed between words; for the word-end vocabulary a word. Texts with
any other white space or with one of the vocabulary's special marks go to the tokenizer whole, so ids always equal
those of the library on the whole text.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

CACHE_UNITS = 250_000
# Letters, then marks that are neither letters, digits, white space nor an apostrophe; all of long-settled classes.
SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies, where it is another one."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder(dict):
    """Ids of units as little-endian bytes; two generations of at most CACHE_UNITS units are remembered, and as many
    of their letter parts.

    A new unit of letters with marks behind it is handed to the library's model directly, as the one or two
    pieces that its pre-tokenizer makes of it; any other unit goes through the whole tokenizer.
    """

    def __init__(self, path: str, byte_level: bool, width: int = 4) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        marks = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # In any case, as a normaliser may lower it before the marks are looked for.
        self.special = re.compile("|".join(map(re.escape, marks)), re.IGNORECASE) if marks else None
        # What all marks begin with, up to the first letter: found much faster than the marks.
        self.hint = re.match(r"[^A-Za-z]*", os.path.commonprefix(marks))[0]
        self.tokenize = self.tokenizer.model.tokenize
        self.byte_level, self.width = byte_level, width
        self.symbols = byte_symbols()
        self.raw = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            text = unit
            if not self.byte_level:
                text = unit.lower() if unit.isascii() else unicodedata.normalize("NFC", unit).lower()
            found = SIMPLE.fullmatch(text)
            if found is None:
                ids = self._whole(unit)
            else:
                stem, marks = found.groups()
                tail = self.marks.get(marks)
                if tail is None:
                    if len(self.marks) > 10_000:
                        self.marks = {"": b""}
                    tail = self.marks[marks] = self._piece(marks)
                head = self.stems.get(stem)
                if head is None:
                    if len(self.stems) > CACHE_UNITS:
                        self.stems = {}
                    head = self.stems[stem] = self._piece(stem)
                ids = head + tail
        self[unit] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        mapped = piece.replace(" ", self.symbols[32]) if piece.isascii() else \
            piece.encode().decode("latin-1").translate(self.symbols)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(mapped)])

    def _whole(self, text: str) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _units(self, text: str) -> list[str] | None:
        if self.special is not None and self.hint in text and self.special.search(text):
            return None
        words = text.split()
        if self.byte_level:
            if "\x00" in text or " ".join(words) != text.replace("\n", " "):
                return None
            return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        rest = text.replace(" ", "").replace("\n", "").replace("\t", "").replace("\r", "")
        return words if "".join(words) == rest else None

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, `width` bytes each; none for a null text."""
        units = self._units(text or "")
        if units is None:
            return self._whole(text)
        out = b"".join(map(self.__getitem__, units))
        if len(self) > CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        return out


@lru_cache(maxsize=2)
def shared_encoder(path: str, byte_level: bool, width: int = 4) -> Encoder:
    """One encoder for all tasks that a Python worker runs one after the other: the file is read once, and what a task
    has encoded the next ones remember, within the bounds of `Encoder`."""
    return Encoder(path, byte_level, width)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
