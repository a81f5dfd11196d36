"""Bitmaps of a bounded size that say which 64-bit values may be in a table.

A value sets two bits. What is not in the table is let through with a small chance, what is in
it always, so joins after the filter are exact; a table too large for the bound only makes the
filter pass more. Bits are set in the tasks and joined per chunk; the driver sees at most
`MOST_BITS` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from vigil.llm.words import mix

MOST_BITS = 1 << 27
_CHUNK_BITS = 1 << 16
_SCHEMA = "chunk int, payload binary"
_ARROW = pa.schema([("chunk", pa.int32()), ("payload", pa.binary())])


def places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    values = values.view(np.uint64)
    mask = np.uint64(bits - 1)
    return mix(values, 21) & mask, mix(values, 22) & mask


def may_contain(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value, whether both its bits are set."""
    one, two = places(values, len(bitmap) * 8)
    hit = lambda at: (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (hit(one) & hit(two)).astype(bool)


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits, dtype=bool) if bits <= 1 << 22 else None
        packed = None if marked is not None else np.zeros(bits // 8, dtype=np.uint8)
        seen = False
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for at in places(values, bits):
                seen = seen or len(at) > 0
                if marked is not None:
                    marked[at] = True
                else:
                    np.bitwise_or.at(packed, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        if not seen:
            return
        if packed is None:
            packed = np.packbits(marked, bitorder="little")
        for i, part in enumerate(np.split(packed, bits // _CHUNK_BITS)):
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part.tobytes()])], schema=_ARROW)

    return run


def _join(table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK_BITS // 8, dtype=np.uint8)
    for part in table["payload"]:
        total |= np.frombuffer(part.as_py(), dtype=np.uint8)
    return pa.table([pa.array([table["chunk"][0].as_py()], pa.int32()), pa.array([total.tobytes()])], schema=_ARROW)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the tasks' chunks as they come in; what is held is the bitmap's share of this partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total.setdefault(chunk, np.zeros(_CHUNK_BITS // 8, dtype=np.uint8))
            total[chunk] |= np.frombuffer(payload, dtype=np.uint8)
    for chunk, bits in total.items():
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([bits.tobytes()])], schema=_ARROW)


def build(values: DataFrame, count: int) -> Broadcast:
    """A broadcast bitmap of the one long column of `values`, for about `count` of them."""
    bits = min(MOST_BITS, max(_CHUNK_BITS, 1 << (16 * max(1, count) - 1).bit_length()))
    merged = values.mapInArrow(_mark(bits), _SCHEMA).repartition("chunk").mapInArrow(_merged, _SCHEMA)
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.collect():  # at most MOST_BITS / 8 bytes
        begin = row["chunk"] * (_CHUNK_BITS // 8)
        bitmap[begin : begin + _CHUNK_BITS // 8] = np.frombuffer(row["payload"], dtype=np.uint8)
    return values.sparkSession.sparkContext.broadcast(bitmap)
