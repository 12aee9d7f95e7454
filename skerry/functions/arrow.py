"""Arrow batches in pieces, so that what Python makes of one at once doesn't grow with the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a piece.
PIECE = 2 << 20


def pieces(batch: pa.RecordBatch | pa.Array, most: int = PIECE) -> Iterator[pa.RecordBatch | pa.Array]:
    """Stretches of a batch or an array with about `most` bytes each by its mean row, one row at least; nothing is copied."""
    n = max(1, len(batch) * most // max(most, batch.nbytes))
    for start in range(0, len(batch), n):
        yield batch.slice(start, n)
