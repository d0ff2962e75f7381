"""Splitting of text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re

import public_tokenizers
import regex

# Plain Latin text, for which the classes of ``re`` and of the pattern agree.
_UNPLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿŒœ–—‘-”…]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def splitter():
    """``text -> list of matches`` of public_tokenizers.PATTERN; whole texts, no loss."""
    full = regex.compile(public_tokenizers.PATTERN)

    def split(text: str) -> list[str]:
        return full.findall(text) if _UNPLAIN.search(text) else _PLAIN.findall(text)

    return split


class IdCache(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes, of bounded size; ``encode`` maps a list
    of pieces to a list of such bytes. Emptied when full: a cache never changes results."""

    def __init__(self, encode, most: int = 600_000):
        super().__init__()
        self.encode, self.most = encode, most

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """For each text, given as its pieces, the ids; what the cache lacks is encoded in one call."""
        miss = set().union(*texts).difference(self)
        if len(self) + len(miss) > self.most:
            self.clear()
            miss = set().union(*texts)
        if miss:
            miss = list(miss)
            self.update(zip(miss, self.encode(miss), strict=True))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in texts]


def slices(batch, column: str, most_rows: int = 1000, most_chars: int = 2_000_000):
    """(slice of an Arrow batch, its texts) of bounded length; a longer text stands alone. Null is ""."""
    start, chars, held = 0, 0, []
    for i in range(batch.num_rows):
        text = batch.column(column)[i].as_py() or ""
        if held and (len(held) >= most_rows or chars + len(text) > most_chars):
            yield batch.slice(start, len(held)), held
            start, chars, held = i, 0, []
        held.append(text)
        chars += len(text)
    if held:
        yield batch.slice(start, len(held)), held
