"""Groups of rows in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the borders of the groups, from batches whose rows are ordered by ``keys``.

    Many small groups come together.  A group that goes on in the next batch waits for it, so no more than
    that group and a batch are held.
    """
    held: list[pa.RecordBatch] = []  # the last group so far
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(batch, keys)
        if held and not _differs(held[-1], batch, keys):
            if not len(new):
                held.append(batch)
                continue
            # the held group ends in this batch
        table = pa.Table.from_batches([*held, batch])
        starts = _starts(table, keys)
        if not len(starts):
            held = [batch]
            continue
        last = int(starts[-1])
        yield table.slice(0, last).combine_chunks(), np.concatenate([[0], starts])
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def _starts(rows, keys: list[str]) -> np.ndarray:
    """Rows, but the first, that differ from the one before."""
    differ = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        c = rows[k]
        differ |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, max(rows.num_rows - 1, 0))))
    return np.flatnonzero(differ) + 1


def _differs(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return any(a[k][a.num_rows - 1].as_py() != b[k][0].as_py() for k in keys)
