"""Exact token ids of a public tokenizer file, with a bounded cache of space-separated pieces.

A single space between two non-space characters always ends a pre-token of these tokenizers, so a
text's ids are the concatenation of its pieces' ids. Pieces of Latin characters are cut by the
tokenizer's own pattern and go straight to its model; everything else takes the whole tokenizer.
"""

from __future__ import annotations

import json
import re

import regex
from tokenizers import Tokenizer

from plumbago.llm.common import hold_cache

_EDGE = re.compile(r"(?<=\S) (?=\S)")
#: The pre-token patterns of the two kinds of byte-pair files read here.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point lower-casing, composition and character classes agree in all libraries.
LATIN = "ɐ"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where visible in Latin-1, else the next free one above 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in seen}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


_BYTES = _byte_alphabet()
_loaded: dict[str, PieceTokenizer] = {}


class PieceTokenizer:
    """``ids(text)`` as little-endian unsigned 32-bit bytes, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, limit: int = 450_000) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spaced = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self.pattern = regex.compile(SPACED if self.spaced else WORD)
        self.limit = limit
        self.forget()
        self.top_id = self.whole.get_vocab_size() - 1

    def forget(self) -> None:
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _encode(self, chunk: str) -> bytes:
        """Ids of a chunk that starts and ends at pre-token edges."""
        low = chunk if self.spaced else chunk.lower()
        if not low or max(low) >= LATIN or "<|" in low:
            return self._packed(self.whole.encode(chunk, add_special_tokens=False).ids)
        core = low.rstrip(".,;:!?")
        if core[1:].isalpha() and (core[0] == " " if self.spaced else core[0].isalpha()):  # a word, perhaps with marks behind it
            parts = (core, low[len(core) :]) if len(core) < len(low) else (core,)
        else:
            parts = self.pattern.findall(low)
        out = []
        for piece in parts:  # pre-tokens that stand alone elsewhere are known from there
            key, held = (piece[1:], self.fresh) if self.spaced and piece[0] == " " else (piece, self.heads if self.spaced else self.fresh)
            ids = held.get(key)
            if ids is None:
                shown = "Ġ" + key if piece[0] == " " and key.isascii() and key.isalpha() else piece if piece.isascii() and piece.isalpha() else piece.encode("utf-8").decode("latin-1").translate(_BYTES)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
                if key and len(key) <= 40:
                    self._keep(held, key, ids)
            out.append(ids)
        return b"".join(out)

    def _keep(self, held: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(held) >= self.limit:
            if held is self.heads:
                held.clear()
            else:
                self.fresh, self.aged = {}, held
                held = self.fresh
        held[key] = ids

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece that follows a space; None if the piece is no chunk of its own."""
        out = self.aged.get(piece)
        if out is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            out = self._encode(" " + piece if self.spaced else piece)
        if len(piece) <= 40:
            self._keep(self.fresh, piece, out)
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        head, *pieces = text.split(" ")
        found = list(map(self.fresh.get, pieces))
        if None in found:
            piece = self._piece
            found = [x if x is not None else piece(p) for x, p in zip(found, pieces)]
        if None in found or not head or head[-1].isspace():  # runs of white space: cut only at plain edges
            parts = _EDGE.split(text)
            if not self.spaced:
                return b"".join(map(self._encode, parts))
            return b"".join([self._encode(parts[0]), *(self._encode(" " + p) for p in parts[1:])])
        return self._encode(head) + b"".join(found)


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per worker process and file, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    hold_cache(_loaded[path])
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
