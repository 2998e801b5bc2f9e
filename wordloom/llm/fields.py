"""Bit fields of bounded size that tell tasks which hashes are worth a row of a shuffle.

A hash sets one bit; a hash without its bit is not in the set, one with it may be.  So a field
never loses anything, however full it is; a full one only lets more rows through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD_BITS = 27  # at most 2^27 bits, 16 MiB
BITS_PER_HASH = 64  # below that bound


def field_bits(hashes: int) -> int:
    return min(FIELD_BITS, max(16, (BITS_PER_HASH * hashes).bit_length()))


def bit_field(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The field of 2^bits bits of a column of 64-bit hashes: packed bytes.  Tasks fill blocks of
    it; the driver gets each block once, so never more than the field."""
    half = bits // 2  # bits of a block's number; the rest is the place in the block
    inner = bits - half

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.sort(batch.column("place").to_numpy())
            block = place >> inner
            cuts = np.flatnonzero(np.diff(block)) + 1
            for own in np.split(place, cuts) if len(place) else []:
                b = int(own[0]) >> inner
                if b not in blocks:
                    blocks[b] = np.zeros(1 << inner, bool)
                blocks[b][own & ((1 << inner) - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())],
            ["block", "bits"],
        )

    place = hashes.select(F.pmod(F.col(column), F.lit(1 << bits)).alias("place"))
    filled = place.repartition(F.shiftright("place", inner)).mapInArrow(fill, "block int, bits binary")
    field = np.zeros((1 << half, 1 << (inner - 3)), np.uint8)
    for row in filled.collect():  # the blocks of one field of fixed size
        field[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return field.ravel()


def member(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the uint64 hashes whose bit is set."""
    place = hashes & np.uint64(8 * len(field) - 1)
    return (field[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Tally:
    """Counts of int64 keys, added up in a task before they become rows."""

    LIMIT = 3 << 20  # keys held at once

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.LIMIT:
            self.merge()
            if self.size > self.LIMIT // 2:
                yield from self.rows()

    def merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first) if len(first) else counts]
        self.size = len(first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All that is held, as rows (key, n), and empties it."""
        if self.size:
            self.merge()
            for i in range(0, self.size, 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(self.keys[0][part]), pa.array(self.counts[0][part])], ["key", "n"])
        self.keys, self.counts, self.size = [], [], 0
