"""Arrow batches in small slices, so that the Python objects made of a batch do not grow with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1024 * 1024


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The rows of a text column in order, in slices of below ``most`` bytes plus one text. Nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype="int64") // most, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(start, end - start)
