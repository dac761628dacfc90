"""Arrow batches in pieces, so that a Python worker holds little more than the batch that it was given."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: A piece ends with the row that brings it to so many bytes or rows.
BYTES = 1 << 22
ROWS = 1024


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns cut at the same rows into pieces; a row over ``BYTES`` is one of its own."""
    n = len(columns[0])
    if n > 1 and (n > ROWS or sum(c.nbytes for c in columns) > BYTES):
        yield from pieces(tuple(c.slice(0, n // 2) for c in columns))
        yield from pieces(tuple(c.slice(n // 2) for c in columns))
    else:
        yield columns


def gathered(rows: Iterable, size: Callable[[object], int]) -> Iterator[list]:
    """Lists of rows as they come, each as long as a piece; nothing for no rows."""
    out, n = [], 0
    for row in rows:
        out.append(row)
        n += size(row)
        if n >= BYTES or len(out) >= ROWS:
            yield out
            out, n = [], 0
    if out:
        yield out
