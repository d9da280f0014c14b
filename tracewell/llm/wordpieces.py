"""Ids of whole texts by the tokenizers library, for the operators that pack or store them.

The texts are split by the byte-level pattern and each different pre-token goes through the library's model once; a
worker remembers the last results up to a bound. Ids are kept as little-endian unsigned bytes, four for each id or two.
"""

from __future__ import annotations

import functools

from .bpe import MEMO_WORDS
from .common import quiet_threads
from .pretokens import Splitter


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class IdBytes(dict):
    """pre-token -> bytes of its ids, filled on demand."""

    def __init__(self, path: str, pattern: str, width: int):
        super().__init__()
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        if size > 256**width:
            raise ValueError(f"ids of {size} tokens don't fit {width} bytes")
        self.packed = [i.to_bytes(width, "little") for i in range(size)]
        self.model, self.split, self.letters = self.tokenizer.model, Splitter(pattern), _byte_letters()

    def __missing__(self, word: str) -> bytes:
        plain = word.replace(" ", "Ġ") if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        packed = self.packed
        self[word] = found = b"".join([packed[t.id] for t in self.model.tokenize(plain)])
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))


@functools.lru_cache(maxsize=1)
def id_bytes(path: str, pattern: str, width: int = 4) -> IdBytes:
    return IdBytes(path, pattern, width)


@functools.lru_cache(maxsize=2)
def id_width(path: str) -> int:
    """Bytes that an id of the vocabulary takes."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 65536 else 4
