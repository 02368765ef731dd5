"""Token ids of whole texts by a word-end BPE tokenizer, with each word merged once.

Texts of plain Latin characters are lower-cased and cut into pieces as the tokenizer's
pre-tokenizer does, and a piece that is not in the cache is merged by the tokenizer's model. Other
texts are taken chunk by chunk between white space, across which neither the normaliser nor the
pre-tokenizer looks; chunks with other characters, or with special tokens, go through the whole
tokenizer. So ids always equal those of the tokenizer itself.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

# Plain characters: printable ones up to U+017F, but the soft hyphen and the capital dotted I, whose
# lower case has two characters. Each is composed, and a letter, a number or neither.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ſ"
_NUMBERS = "0-9²³¹¼½¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile(r"[ \t\n\r\x0b\x0c!-~¡-¬®-įı-ſ]*")
#: White space to Python, but not to the tokenizer.
_CONTROLS = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ChunkIds(dict):
    """piece or chunk -> its ids as little-endian unsigned 32-bit bytes, filled on demand.

    At most twice ``limit`` entries are held: when full, the entries become the older generation,
    from which those still in use are taken back.
    """

    def __init__(self, path: str, limit: int = 200_000):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.limit, self.older = limit, {}
        self.letters = _byte_letters()
        self.special = tuple({t.content for t in self.whole.get_added_tokens_decoder().values()})

    def __missing__(self, piece: str) -> bytes:
        """The ids of a lower-case piece of plain characters."""
        ids = self.older.get(piece)
        if ids is None:
            ids = _packed([t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece.encode()]))])
        return self._keep(piece, ids)

    def _keep(self, key: str | tuple, ids: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.special):
            return self._plain(chunk)
        key = (chunk,)
        ids = self.get(key) or self.older.get(key)
        return ids or self._keep(key, _packed(self.whole.encode(chunk, add_special_tokens=False).ids))

    def of(self, text: str | None) -> bytes:
        """The ids of a text."""
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self._plain(text)
        chunks = _ASCII_SPACE.split(text) if _CONTROLS.search(text) else text.split()
        return b"".join(map(self._chunk, filter(None, chunks)))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One cache a worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]
