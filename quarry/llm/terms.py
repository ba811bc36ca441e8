"""Terms of whole texts, byte by byte: maximal runs of letters (and digits) and of anything beyond ASCII, only A-Z lower-cased.

In UTF-8 such a class of characters is a class of bytes, so a text is mapped by a table and split at blanks, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_BLOCK = 1 << 20
_UPPER, _LOWER, _DIGITS = range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A)


def _table(kept) -> bytes:
    return bytes(b + 32 if b in _UPPER else b if b in _LOWER or b >= 0x80 or b in kept else 0x20 for b in range(256))


#: Byte tables of the two kinds of terms.
LETTERS, LETTERS_AND_DIGITS = _table(()), _table(_DIGITS)


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def blocks(text: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about a million bytes; a block ends where a term does."""
    at, size = 0, len(text or b"")
    while at < size:
        stop = min(size, at + _BLOCK)
        part = text[at:stop].translate(table)
        while stop < size and part[-1] != 0x20:
            more = text[stop : stop + 4096].translate(table)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            stop += len(more) if cut < 0 else cut + 1
        yield part.split()
        at = stop
