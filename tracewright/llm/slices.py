"""Ranges of an Arrow column of texts by their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sliced(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes, of one text at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b
