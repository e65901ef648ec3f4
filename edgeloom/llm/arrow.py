"""Arrow batches on workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group of equal first columns, which must follow each other."""
    held, now = [], None
    for batch in batches:
        columns = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.nonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            key = tuple(columns[:, lo])
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
