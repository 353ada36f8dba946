"""Token ids of whole texts by the tokenizers library, with caches of pieces per worker.

A text is cut where the tokenizer itself always cuts, and each piece is encoded once per
worker. The library encodes what the caches miss, and whole texts in which a piece could
depend on its neighbours: unusual white space, or strings of special tokens.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .worker import shared

_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_SPACE_RUNS = [c + " " for c in " \n\t\r\x0b\x0c"]  # a space after these is not always a cut
_LONGEST = 48  # characters of a piece that is kept
KEPT = 500_000  # pieces in one generation of a cache
_SLAB = 1 << 19  # characters of a text encoded at once
_GROUP = 1 << 22  # characters of texts whose words are told apart at once
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Cache(dict):
    """Value of a piece, made on a miss. Of two generations the older one goes when the newer
    one is full, so pieces in use stay and memory is bounded."""

    def __init__(self, make, kept: int = KEPT):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, piece):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= _LONGEST:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is
    visible, else the next letter after the first 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers, without added tokens.

    ``special`` strings inside a text become their tokens, as is the library's default.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = _kind(spec)
        self.model, self.letters = self.library.model, _byte_letters()
        self.pieces = Cache(self._piece, kept)
        self.spaced = Cache(lambda x: self._piece(" " + x), kept)
        self.parts = Cache(self._part, kept)

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """Ids of what the tokenizer's pattern cut out, by the library's model."""
        if part.isascii() and part.isprintable():  # all bytes but the space stand for themselves
            symbols = part.replace(" ", self.letters[32])
        else:
            symbols = part.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(symbols)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece through the cache of its parts. Beyond Latin-1, where letter tables
        and normal forms could differ, the library takes the piece itself."""
        if not piece.isascii() and max(piece) > "\xff":
            return self.whole(piece)
        stem = piece.rstrip(string.punctuation)
        word = stem.lower() if self.kind == "words" else stem
        if (stem[1:] if stem[:1] == " " else stem).isalpha():  # the most common pieces
            return self.parts[word] + self.parts[piece[len(stem) :]] if len(stem) < len(piece) else self.parts[word]
        if self.kind == "words":
            parts = _WORD_PIECES.findall(piece.lower())
        else:
            parts = _BYTE_PIECES.findall(piece)
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def plain(self, text: str) -> bool:
        """Whether pieces of the text can be encoded alone."""
        return bool(self.kind) and not any(s in text for s in self.special) and not _ODD.search(text)

    def split(self, text: str) -> list[str]:
        """Pieces of a plain text, each encoded as if it stood alone."""
        return text.split() if self.kind == "words" else re.findall(r"\s*\S+|\s+", text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return self.whole(text)
        return self._slab(text) if len(text) <= _SLAB else b"".join(map(self._slab, slabs(text)))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """:meth:`encode` of every text in order. Words are told apart in groups of texts, and
        only the distinct ones meet the cache of parts, so no word is kept as it stands."""
        group, alone, n = [], {}, 0
        for text in texts:
            text = text or ""
            if self.kind != "words" or len(text) > _GROUP or not self.plain(text):
                alone[len(group)] = self.encode(text)
                text = ""
            group.append(text)
            n += len(text) + 1
            if n >= _GROUP:
                yield from self._grouped(group, alone)
                group, alone, n = [], {}, 0
        yield from self._grouped(group, alone)

    def _grouped(self, texts: list[str], alone: dict[int, bytes]) -> Iterator[bytes]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))  # plain texts have no other space
        coded = words.values.dictionary_encode()
        distinct = [self._piece(w) if w else b"" for w in coded.dictionary.to_pylist()]
        ids = pa.array(distinct, pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[words.offsets.to_numpy()].tolist()
        held = memoryview(data or b"")
        for i in range(len(texts)):
            yield alone[i] if i in alone else bytes(held[ends[i] : ends[i + 1]])

    def _slab(self, text: str) -> bytes:
        if self.kind == "words" or any(s in text for s in _SPACE_RUNS):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        parts = text.split(" ")
        head = self.pieces[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.spaced.__getitem__, parts[1:]))


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes() if len(ids) > 200 else array("I", ids).tobytes()


def slabs(text: str) -> Iterator[str]:
    """A text in slabs cut before a space that follows a visible character."""
    a = 0
    while a < len(text):
        b = text.find(" ", a + _SLAB)
        while 0 < b and text[b - 1].isspace():
            b = text.find(" ", b + 1)
        b = len(text) if b < 0 else b
        yield text[a:b]
        a = b


def _kind(spec: dict) -> str:
    """How texts may be cut: at white space that is dropped ("words"), before a space that
    belongs to the next piece ("bytes"), or not at all ("")."""
    normalizer, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if spec.get("model", {}).get("type") != "BPE" or spec.get("post_processor") not in (None,) and pre.get("type") != "ByteLevel":
        return ""
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []):
        return ""
    if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [s.get("type") for s in (normalizer or {}).get("normalizers", [])]
    inner = pre.get("pretokenizers", [])
    if (
        steps == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in inner] == ["Split", "ByteLevel"]
        and inner[0]["pattern"].get("Regex") == _WORD_PIECES.pattern.replace(r"\p{L}+", r"[\p{L}]+", 1).replace(r"|\p{N}|", r"|[\p{N}]|")
        and not inner[1].get("add_prefix_space")
    ):
        return "words"
    return ""


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """The worker's encoder for a tokenizer file; its caches hold about 200 bytes a piece."""
    return shared(("encoder", path), lambda: Encoder(path, kept), kept)
