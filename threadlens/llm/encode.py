"""Token ids of whole texts by the tokenizers library, with words that were seen before kept per Python worker.

A BPE tokenizer cuts a text into pieces and merges inside each piece alone, so the ids of a text are
the ids of its pieces in order. ``Encoder`` keeps the ids of pieces and of white-space-separated
chunks, and asks the library's model only for new pieces. Texts with characters outside the plain
range below, or with unusual white space, go through ``Tokenizer.encode`` whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

#: Letters and other numbers among the characters of the plain range (U+0000-U+017F and common punctuation).
_LETTERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
_OTHER = rf"[^\s{_LETTERS}{_NUMBERS}]+"
#: Characters for which the library is asked with the whole text: controls, separators and beyond the plain range.
_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0İŉƀ-‏ - ‿-₫₭-\U0010ffff]")
#: White space of byte-level texts other than a single blank or a single line end between other characters.
_IRREGULAR = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: The stand-in of a blank, marks that are a piece of their own after letters, and packers of short id lists.
_BLANK, _MARKS = _byte_letters()[32], tuple(",.;:!?")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


#: Words that an encoder keeps; and few of them, for workers that have little memory left: a tenth of it, over half as much time again.
KEPT, KEPT_FEW = 1_000_000, 100_000


class _Kept(dict):
    """A mapping filled by ``make``; when ``most`` entries are reached, the older half of its history goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian 32-bit bytes; same ids as ``Tokenizer.encode(text, add_special_tokens=False)``.

    As in that call, a special token's string inside a text is that token; such texts go through the library whole. Two shapes of tokenizer get the fast
    way: byte-level BPE with its own pattern, and lower-casing BPE with word ends; others are
    encoded whole by the library.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.marks = sorted({m for c in added for m in (c[0].lower(), c[0].upper())})  # first characters: a quick test
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search
        plain = model["type"] == "BPE" and not model.get("dropout") and not spec.get("truncation")
        byte_level = plain and spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" \
            and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
        word_ends = plain and model.get("end_of_word_suffix") == "</w>" \
            and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.kind = "byte" if byte_level else "word" if word_ends else "whole"
        if byte_level:
            self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?{_OTHER}|\s+(?!\S)|\s+").findall
        else:
            self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|{_OTHER}").findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.piece = _Kept(self._piece, kept)
        self.chunk = _Kept(self._chunk, kept)
        self.spaced = _Kept(self._spaced, kept)  # a chunk with the blank before it

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            shown = piece  # such letters stand for themselves
        elif piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            shown = _BLANK + piece[1:]
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._piece(chunk)
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self.chunk[chunk[:-1]] + self.piece[chunk[-1]]
        return b"".join(map(self.piece.__getitem__, self.pieces(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._piece(f" {chunk}")
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self.spaced[chunk[:-1]] + self.piece[chunk[-1]]
        return b"".join(map(self.piece.__getitem__, self.pieces(f" {chunk}")))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or _UNUSUAL.search(text) or any(m in text for m in self.marks) and self.added(text):
            return self._whole(text)
        get = self.chunk.__getitem__
        if self.kind == "word":
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return b"".join(map(get, text.lower().split()))
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _IRREGULAR):
            return b"".join(map(self.piece.__getitem__, self.pieces(text)))
        # a blank opens the piece after it; a line end is a piece of its own
        after, out = self.spaced.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(get(head) + b"".join(map(after, rest)))
        return get("\n").join(out)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """The worker's encoder for a vocabulary file (one per Python worker, file and number of words kept)."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = Encoder(path, kept)
    return _ENCODERS[path, kept]


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files have ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)
