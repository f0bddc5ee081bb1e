"""Bloom filters of what was seen once and twice, built by tasks and merged a segment at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 21
NOTES = "segment int, once binary, twice binary"


def bits_for(items: int, per_item: int, least: int, most: int) -> int:
    """A power of 2; `most` bounds what is later broadcast. A filter that fills up lets more through, which is told apart exactly afterwards."""
    bits = least
    while bits < min(items * per_item, most):
        bits *= 2
    return bits


def notes(seen: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """A task's rows for each segment of the filter: bits set once (and more often), and those set more often."""
    pos, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint32), return_counts=True)
    cut = np.searchsorted(pos, np.arange(0, bits + 1, SEGMENT, dtype=np.int64))
    for s in range(bits // SEGMENT):
        p, c = pos[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]
        if len(p):
            p = (p - np.uint32(s * SEGMENT)).astype("<u4")
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([pack(p)], pa.binary()), pa.array([pack(p[c > 1])], pa.binary())], names=["segment", "once", "twice"])


def pack(p: np.ndarray) -> bytes:
    """Rising numbers as differences: two bytes each where all fit."""
    d = np.diff(p.astype(np.int64), prepend=0)
    wide = bool(len(d) and d.max() > 0xFFFF)
    return bytes([wide]) + d.astype("<u4" if wide else "<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw[1:], dtype="<u4" if raw[0] else "<u2").astype(np.int64))


def twice_seen(found: DataFrame, bits: int) -> bytes:
    """The filter of what was set at least twice, from rows of notes(). Segments are merged note by note, in the memory of two bitmaps, and collected: bits / 8
    bytes in all, whatever the input."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, once, twice = None, None, None

        def row():
            return pa.record_batch([pa.array([segment], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "bitmap"])

        for b in batches:
            for s, o, t in zip(*(b.column(i) for i in range(3))):
                if s.as_py() != segment:
                    if segment is not None:
                        yield row()
                    segment, once, twice = s.as_py(), np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                p = unpack(o.as_py())
                twice[p[once[p]]] = True
                twice[unpack(t.as_py())] = True
                once[p] = True
        if segment is not None:
            yield row()

    out = np.zeros((bits // SEGMENT, SEGMENT // 8), dtype=np.uint8)
    for r in found.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bitmap binary").toLocalIterator():
        out[r.segment] = np.frombuffer(r.bitmap, dtype=np.uint8)
    return out.tobytes()


def holds(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bitmap[pos >> np.uint64(3)] >> (np.uint64(7) - (pos & np.uint64(7))).astype(np.uint8)) & 1 == 1
