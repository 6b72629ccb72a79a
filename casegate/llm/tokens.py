"""Token ids of a byte-level BPE vocabulary file, with pre-tokens looked up once.

The pre-tokenizer's rule is applied here for texts whose characters lie below U+0250, where its
letter, number and space classes can be written out; each distinct pre-token is encoded by the
tokenizer and kept.  Other texts, and those that hold the string of a special token, are encoded by it
as a whole.  Either way the ids are the tokenizer's own; with ``special=False`` the strings of special
tokens are ordinary text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
PRE_TOKEN = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_BEYOND = re.compile("[^\x00-ɏ]")
#: Pre-tokens of a generation that are kept; two generations take some 70 MB.
KEPT = 150_000
#: Longer pre-tokens are not kept.
LONGEST_KEPT = 64


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from
    U+0100 on."""
    table, following = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            table[byte] = byte
        else:
            table[byte] = following
            following += 1
    return table


_BYTE_CHARACTERS = _byte_characters()


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens, which spell the text; None where the rule is not written out."""
    if not text.isascii() and _BEYOND.search(text):
        return None
    return PRE_TOKEN.findall(text)


class _Kept(dict):
    """Ids of pre-tokens.  When a generation is full, the one before it is forgotten; what is asked
    for again moves on to the next."""

    def __init__(self, encode):
        self._encode, self._before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._before.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > KEPT:
            self._before = dict(self)
            self.clear()


class Encoder:
    """``bytes_of(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special: bool = True):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise OSError("ids are kept as little-endian 32-bit integers")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        added = [re.escape(token.content) for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(added)) if special and added else None
        self._kept = _Kept(self._piece)

    def _piece(self, piece: str) -> bytes:
        """A pre-token by the tokenizer's model alone."""
        spelled = piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return array("I", [t.id for t in self._tokenizer.model.tokenize(spelled)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of any text; strings of special tokens in it are ordinary text."""
        pieces = pre_tokens(text)
        if pieces is None:
            found = self._tokenizer.pre_tokenizer.pre_tokenize_str(text)
            pieces = [text[begin:end] for _, (begin, end) in found]
        return pieces

    def count(self, piece: str) -> int:
        """Tokens of a pre-token."""
        self._kept.age()
        return len(self._kept[piece]) // 4

    def bytes_of(self, text: str) -> bytes:
        pieces = None if self._added and self._added.search(text) else pre_tokens(text)
        if pieces is None:
            return self.whole(text)
        self._kept.age()
        return b"".join(map(self._kept.__getitem__, pieces))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """The encoder of a worker process, made once."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
