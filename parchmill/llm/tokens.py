"""Token ids of whole texts, by the ``tokenizers`` library and a vocabulary file.

The library's full pipeline tracks offsets and costs more than 10 microseconds a
word.  Here a text is cut where a byte-level pre-token must end (a single space or
newline between two other characters, a mark behind a letter), the library's own model encodes each
distinct pre-token once, and a bounded cache gives the rest.  Texts with other
white space or the string of an added token, and characters beyond Latin, go to the
library's pipeline itself, so ids are always those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import array
import codecs
import re

import regex

from .memory import worker_cache

#: Fixed value: the published pre-token pattern of byte-level BPE.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that Unicode knows besides space and newline, and the four ASCII separators.
ODD_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: A piece of letters and one of these is two pre-tokens.
CLOSERS = frozenset(".,;:!?")
#: A pre-token ends between a Latin letter or digit and a mark (not an apostrophe, which may begin one with letters).
MARKS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f].)")
#: Stands before a mark that was cut off: odd white space, so in no text that is cut.
CUT = "\x1f"
CUT_OFF = rf" {CUT}\g<0>"
ODD_PAIRS = ["  ", " \n", "\n ", "\n\n"]
#: Entries in the younger generation of an encoder's caches, of pieces behind a space and of others; the older ones hold
#: as many.  The first is what a dict of its size in memory can hold.
CACHE = {" ": 174_000, "": 126_000}


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(spare)}


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes, with ``lead`` put before the piece.

    When the younger generation is full it becomes the older one, so frequent pieces stay.
    """

    def __init__(self, owner: "Encoder", lead: str):
        super().__init__()
        self.owner, self.lead, self.old = owner, lead, {}
        self.mark, self.most = lead.translate(owner.alphabet), CACHE[lead]

    def __missing__(self, piece: str) -> bytes:
        if (found := self.old.get(piece)) is None:
            if piece.isascii() and piece.isalpha():  # letters that stand for themselves
                found = self.owner.encode_mapped(self.mark + piece)
            elif piece.isalpha() and max(piece) < "\u0250":
                found = self.owner.encode_pretoken(self.lead + piece)
            elif piece[:1] == CUT:
                found = self.owner.encode_piece(piece[1:])
            elif piece[-1:] in CLOSERS and piece[:-1].isalpha():
                found = self[piece[:-1]] + self.owner.bare[piece[-1]]
            else:
                found = self.owner.encode_piece(self.lead + piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Whole texts to ids.  One per Python worker; memory is bounded by the caches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces are kept here; a second cache costs a new piece as long again
        self.alphabet = byte_alphabet()
        self.letters = "".join(self.alphabet[b] for b in range(256))
        self.split = regex.compile(PRETOKENS).findall
        self.spaced, self.bare = _Pieces(self, " "), _Pieces(self, "")

    def by_library(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_mapped(self, mapped: str) -> bytes:
        return array.array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode_pretoken(self, token: str) -> bytes:
        return self.encode_mapped(codecs.charmap_decode(token.encode(), "strict", self.letters)[0])

    def encode_piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if max(piece) >= "\u0250":
            return self.by_library(piece)
        return b"".join(map(self.encode_pretoken, self.split(piece)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes; null is an empty text."""
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in ODD_PAIRS) or any(x in text for x in ODD_SPACE) or any(x in text for x in self.added):
            return self.by_library(text)
        newline, spaced, bare = self.bare["\n"], self.spaced.__getitem__, self.bare.__getitem__
        lines = []
        for line in MARKS.sub(CUT_OFF, text).split("\n"):
            pieces = line.split(" ")
            lines.append(bare(pieces[0]) + b"".join(map(spaced, pieces[1:])))
        return newline.join(lines)


CACHED = "encoders"
_encoders: dict[str, Encoder] = worker_cache(CACHED, {})


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary on this machine (a parameter of every operator)."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
