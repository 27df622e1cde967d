"""Arrow batches of sorted rows, cut at the borders of receipts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def borders(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Places at which a new key starts, without the first; nulls are a key."""
    if len(keys) < 2:
        return np.zeros(0, dtype=np.int64)
    before, after = keys.slice(0, len(keys) - 1), keys.slice(1)
    differ = pc.fill_null(pc.not_equal(before, after), False)
    one_null = pc.xor(pc.is_null(before), pc.is_null(after))
    return np.flatnonzero(pc.or_(differ, one_null).to_numpy(zero_copy_only=False)) + 1


def whole_receipts(batches: Iterator[pa.RecordBatch], key: str = "receipt_id") -> Iterator[pa.Table]:
    """The rows in tables that hold whole receipts: the last receipt of a batch waits for the next one, so what is
    held is a batch and one receipt."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not len(borders(pa.chunked_array([held[-1][key].slice(len(held[-1]) - 1), batch[key]]))):
            held.append(batch)  # all of one receipt
            continue
        table = pa.Table.from_batches([*held, batch])
        cuts = borders(table[key])
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)
