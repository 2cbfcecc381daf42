"""Splits texts into the pieces that byte-level BPE merges within, with a fast path for Latin-1 texts."""

from __future__ import annotations

import re

import regex
import public_tokenizers

#: Pieces whose ids a worker remembers at most, in two generations: about 150 MB.
REMEMBERED = 1_000_000
#: Longer pieces are not remembered.
LONGEST = 64

_GENERAL = regex.compile(public_tokenizers.PATTERN)
# the same pattern on Latin-1 bytes: letters, numbers and white space of that range spelled out, and runs of letters, the most frequent, first
_L, _N, _S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_LATIN = re.compile(rb" ?[%b]+| ?[%b]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+" % (_L, _N, _S, _L, _N, _S, _S, _S))


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Ids of pieces met lately, in two generations: a full young one becomes the old one, and what is met again moves back.

    So frequent pieces stay, and memory is bounded whatever the texts hold. Latin-1 pieces are keys as bytes, others as strings.
    """

    def __init__(self, encode_piece, remembered: int):
        self.encode_piece, self.half, self.old = encode_piece, max(1, remembered // 2), {}

    def __missing__(self, piece: bytes | str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode_piece(piece if isinstance(piece, str) else piece.decode("latin-1"))
        if len(piece) <= LONGEST:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """text -> ids as packed little-endian unsigned 32-bit integers, by way of `encode_piece`, which takes a new piece."""

    def __init__(self, encode_piece, specials: dict[str, int], remembered: int = REMEMBERED):
        self.memo = _Memo(encode_piece, remembered)
        self.specials = {s: i.to_bytes(4, "little") for s, i in specials.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

    def _ids(self, text: str) -> bytes:
        try:
            found = _LATIN.findall(text.encode("latin-1"))
        except UnicodeEncodeError:
            found = _GENERAL.findall(text)
        return b"".join(map(self.memo.__getitem__, found))

    def ids(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.specials):
            return self._ids(text)
        return b"".join(self.specials.get(part) or self._ids(part) for part in self.cut.split(text) if part)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [self.ids(x) for x in texts]
