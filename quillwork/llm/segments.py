"""Byte-level pre-tokenisation with a bounded cache, shared by the tokenising operators.

The split pattern never matches across a single space between two other characters that are not
white space, except by starting at that space. So a text may be cut before every such space and
its pieces tokenised alone: they repeat far more often than whole texts do. A text that has any
other arrangement of spaces is tokenised whole. Both ways give the same ids.
"""

from __future__ import annotations

from collections.abc import Callable


class _Other(Exception):
    """A piece that does not stand between single spaces."""


class SegmentCache(dict):
    """Maps a piece of text, with the space before it, to its packed ids; filled on demand and emptied when full."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 800_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Other
        packed = self.encode(" " + piece)
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self) > self.most:
            self.clear()
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Other
            return self.encode(first) + b"".join(map(self.__getitem__, rest))
        except _Other:
            return self.encode(text)
